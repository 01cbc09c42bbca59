"""Retrieval queries."""

from pyspark.sql import functions as F

from lakeleaf.operators import retrieval as R
from lakeleaf.operators.extract import tokens
from lakeleaf.plans.base import Plans

P = Plans()
TOKENS = "regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\\p{L}\\p{N}_]+')"


def _bm25_sql(terms: list[str], tail: str = "") -> str:
    picks = ", ".join(f"CAST(len(list_filter(t, lambda x: x = '{w}')) AS DOUBLE) AS tf{i}" for i, w in enumerate(terms))
    dfs = ", ".join(f"CAST(sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * words / mean))" for i in range(len(terms)))
    return f"""WITH tok AS (SELECT doc_id, {TOKENS} AS t FROM documents), c AS (SELECT doc_id, CAST(len(t) AS DOUBLE) AS words, {picks} FROM tok),
 s AS (SELECT CAST(count(*) AS DOUBLE) AS docs, avg(words) AS mean, {dfs} FROM c), scored AS (SELECT doc_id AS id, {score} AS score FROM c, s) {tail}"""


@P.add("tokenize_words", f"WITH w AS (SELECT unnest({TOKENS}) AS token FROM documents) SELECT token, count(*) AS n FROM w GROUP BY token")
def _(t):
    return t.documents.select(F.explode(tokens(F.coalesce("text", F.lit("")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@P.add("agg_bm25", _bm25_sql(["and", "of", "the"], "SELECT id, round(score, 6) AS score FROM scored WHERE score > 0"))
def _(t):
    return R.bm25(t.documents, "the of and").select("id", F.round("score", 6).alias("score"))


_VEC = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_reduce(list_transform(e, lambda y: y * y), lambda a, b: a + b))) AS u FROM v)"""
_DOTS = _VEC + """, q AS (SELECT u AS qu FROM n WHERE vec_id = 0), d AS (SELECT vec_id AS id, list_reduce(list_transform(list_zip(u, qu), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score FROM n, q)"""


def _query_vector(t):
    return [float(x) for x in t.embeddings.where("vec_id = 0").select("embedding").first()[0]]


@P.add("vector_normalize", _VEC + " SELECT vec_id, round(list_reduce(list_transform(u, lambda x: x * x), lambda a, b: a + b), 6) AS norm2, round(u[1], 6) AS first FROM n")
def _(t):
    rows = t.embeddings.select("vec_id", R.normalized("embedding").alias("u"))
    return rows.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


@P.add("agg_vector_topk", _DOTS + " SELECT id, round(score, 6) AS score FROM d ORDER BY score DESC, id LIMIT 20")
def _(t):
    return R.vector_scores(t.embeddings, _query_vector(t)).orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 6).alias("score"))


_RANKS = _bm25_sql(["of", "the"]).removesuffix(" ") + ", " + _DOTS.removeprefix("WITH ") + ", r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0 UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM d)"


@P.add("agg_rrf", _RANKS + " SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score FROM r GROUP BY id ORDER BY sum(1.0 / (60 + rank)) DESC, id LIMIT 100")
def _(t):
    return R.hybrid(t.documents, "of the", _query_vector(t), t.embeddings, limit=100).select("id", F.round("score", 6).alias("score"))


@P.add("topk_rrf", _RANKS + " SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score FROM r GROUP BY id ORDER BY sum(1.0 / (60 + rank)) DESC, id LIMIT 20")
def _(t):
    return R.hybrid(t.documents, "of the", _query_vector(t), t.embeddings, limit=20).select("id", F.round("score", 6).alias("score"))


@P.add("win_rank", _bm25_sql(["the"], "SELECT id, CAST(row_number() OVER (ORDER BY score DESC, id) AS BIGINT) AS rank FROM scored WHERE score > 0"))
def _(t):
    return R.ranked(R.bm25(t.documents, "the")).select("id", F.col("rank").cast("long").alias("rank"))


@P.add("set_union_rankings", _RANKS + " SELECT count(DISTINCT id) AS ids, count(*) AS entries FROM r")
def _(t):
    both = R.ranked(R.bm25(t.documents, "of the")).unionByName(R.ranked(R.vector_scores(t.embeddings, _query_vector(t))))
    return both.groupBy("id").agg(F.count("*").alias("k")).agg(F.count("*").alias("ids"), F.sum("k").alias("entries"))


_FTS_TOKENS = "regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}]+')"


def _fts_sql(tail: str) -> str:
    return f"""WITH tok AS (SELECT doc_id, {_FTS_TOKENS} AS t FROM documents),
 c AS (SELECT doc_id, CAST(len(t) AS DOUBLE) AS words, CAST(len(list_filter(t, lambda x: x = 'the')) AS DOUBLE) AS tf0, CAST(len(list_filter(t, lambda x: starts_with(x, 'erth'))) AS DOUBLE) AS tf1, CAST(len(list_filter(t, lambda x: x = 'les')) AS DOUBLE) AS tf2 FROM tok),
 s AS (SELECT CAST(count(*) AS DOUBLE) AS docs, avg(words) AS mean, CAST(count(*) FILTER (tf0 > 0) AS DOUBLE) AS df0, CAST(count(*) FILTER (tf1 > 0) AS DOUBLE) AS df1 FROM c),
 scored AS (SELECT doc_id AS id, greatest(1e-6, ln((docs - df0 + 0.5) / (df0 + 0.5))) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * words / mean)) + greatest(1e-6, ln((docs - df1 + 0.5) / (df1 + 0.5))) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * words / mean)) AS score FROM c, s WHERE tf0 > 0 AND tf1 > 0 AND tf2 = 0) {tail}"""


@P.add("agg_bm25_fts", _fts_sql("SELECT id, round(score, 6) AS score FROM scored"))
def _(t):
    return R.full_text(t.documents, "the erth* NOT les", id_col="doc_id").select("id", F.round("score", 6).alias("score"))


@P.add("topk_fts", _fts_sql("SELECT id, round(score, 6) AS score FROM scored ORDER BY score DESC, id LIMIT 20"))
def _(t):
    return R.full_text(t.documents, "the erth* NOT les", 20, "doc_id").select("id", F.round("score", 6).alias("score"))


_EDGES = "SELECT DISTINCT role AS source, 'turn' || (turn % 4) AS relation, 'conv' || (conv_id % 50) AS target, 'c' || conv_id AS document FROM conversations"


def _edges(t):
    c = t.conversations
    return c.select(F.col("role").alias("source"), F.concat(F.lit("turn"), (F.col("turn") % 4).cast("string")).alias("relation"), F.concat(F.lit("conv"), (F.col("conv_id") % 50).cast("string")).alias("target"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("document")).distinct()


@P.add("join_memory_neighbors", f"WITH e AS ({_EDGES}) SELECT source, relation, target, document FROM e WHERE source = 'conv7' OR target = 'conv7'")
def _(t):
    return R.neighbours(_edges(t), "conv7")


@P.add("memory_put", "WITH l AS (SELECT event_id AS seq, 'm' || user_id AS id, event_type AS text FROM events), w AS (SELECT *, lag(text) OVER (PARTITION BY id ORDER BY seq) AS p FROM l), r AS (SELECT id, max(seq) FILTER (p IS NULL OR p <> text) AS text_since, max(seq) AS last FROM w GROUP BY id) SELECT r.id, l.text, r.text_since FROM r JOIN l ON l.id = r.id AND l.seq = r.last")
def _(t):
    return R.memory_put(_memory_log(t)).select("id", "text", "text_since")


def _memory_log(t):
    return t.events.select(F.col("event_id").alias("seq"), F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("text"), F.lit(None).cast("array<double>").alias("embedding"))


@P.add("memory_relate", "WITH l AS (SELECT event_id AS seq, 'm' || user_id AS id, event_type AS text FROM events), w AS (SELECT *, lag(text) OVER (PARTITION BY id ORDER BY seq) AS p FROM l), r AS (SELECT id, max(seq) FILTER (p IS NULL OR p <> text) AS text_since FROM w GROUP BY id) SELECT DISTINCT e.event_type AS source, 'seen' AS relation, 'u' || (e.user_id % 9) AS target, 'm' || e.user_id AS document FROM events e JOIN r ON r.id = 'm' || e.user_id AND e.event_id >= r.text_since")
def _(t):
    e = t.events
    log = e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("source"), F.lit("seen").alias("relation"), F.concat(F.lit("u"), (F.col("user_id") % 9).cast("string")).alias("target"), F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("document"))
    return R.memory_relate(log, R.memory_put(_memory_log(t)))


QUERIES, ORACLE_SQL = P.queries, P.sql
