"""Lexical, vector and fused retrieval, and a small full-text query language.

A query's terms are few and known on the driver, so term counts are columns of the document scan: nothing is
exploded and no postings are shuffled. Corpus figures (documents, mean length, document frequencies) are one
row of a global aggregate over the written counts, sent to their scoring; the top rows come from a partial top-k in every task.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeleaf.operators.extract import tokens
from lakeleaf.operators.tables import kept

# The ranking constants.
K1, B, RRF = 1.2, 0.75, 60


def _limit_ok(limit, most):
    if type(limit) is not int or not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")


def _query_terms(query: str) -> list[str]:
    return sorted(set(re.findall(r"\w+", query.casefold())))


def term_counts(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, words, tf array) of every document, in one scan."""
    words = docs.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))

    def times(term: str) -> Column:
        return F.size(F.filter("t", lambda x: x == F.lit(term))).cast("double")

    return words.select("id", F.size("t").cast("double").alias("words"), F.array(*map(times, terms)).alias("tf"))


def _corpus(counts: DataFrame, n: int) -> DataFrame:
    return counts.agg(F.count("*").cast("double").alias("docs"), F.avg("words").alias("mean"), F.array(*[F.sum(F.when(F.get("tf", F.lit(i)) > 0, 1.0).otherwise(0.0)) for i in range(n)]).alias("df"))


def bm25(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of documents with a positive score; idf is ln(1 + (N - df + .5) / (df + .5)), query terms count once."""
    terms = _query_terms(query)
    if not terms:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).where("false")
    counts = kept(term_counts(docs, terms, id_col, text_col), "term_counts")  # a few numbers a document: the text is read once
    scored = counts.where(F.exists("tf", lambda x: x > 0)).join(F.broadcast(_corpus(counts, len(terms))))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.get("tf", F.lit(i)), F.get("df", F.lit(i))
        idf = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        mean = F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("words") / mean))
    return scored.select("id", score.alias("score")).where("score > 0")


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalized(vector: str | Column) -> Column:
    """Unit vector, scaled by its largest magnitude first; empty, null-holding, non-finite and zero vectors raise."""
    refused = F.raise_error(F.lit("vector must be finite and nonzero")).cast("array<double>")

    def scaled(v: Column) -> Column:
        largest = F.greatest(F.abs(F.array_max(v)), F.abs(F.array_min(v)))  # not a number is greater than any
        bad = (F.size(v) == 0) | F.exists(v, lambda x: x.isNull()) | F.isnan(largest) | (largest == float("inf")) | (largest == 0)
        return F.when(F.coalesce(bad, F.lit(True)), refused).otherwise(_once(largest, lambda top: F.transform(v, lambda x: x / top)))

    doubles = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    return _once(_once(doubles, scaled), lambda v: _once(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), lambda norm: F.transform(v, lambda x: x / norm)))


def unit(values: list[float]) -> list[float]:
    """The same on the driver, for a query's vector."""
    import math

    if not values or any(isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) for x in values) or not any(values):
        raise ValueError("vector must be finite and nonzero")
    top = max(map(abs, values))
    norm = math.sqrt(sum((x / top) ** 2 for x in values))
    return [x / top / norm for x in values]


def vector_scores(store: DataFrame, query: list[float], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score): dot product with the query, for all rows with a vector, negative ones too. Another dimension raises."""
    q = F.array(*[F.lit(float(x)) for x in unit(query)])
    rows = store.where(F.col(vector_col).isNotNull())
    v = F.when(F.size(vector_col) == len(query), normalized(vector_col)).otherwise(F.raise_error(F.lit("vector dimension mismatch")).cast("array<double>"))
    return rows.select(F.col(id_col).alias("id"), F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x).alias("score"))


def ranked(scores: DataFrame) -> DataFrame:
    """(id, rank) by descending score, then id, numbered over all rows by one distributed sort: sizes of the sorted parts give each part's first rank."""
    from lakeleaf.operators.windows import global_rank

    return global_rank(scores, [F.desc("score"), F.asc("id")]).select("id", "rank")


def fused(rankings: list[DataFrame], limit: int = 10) -> DataFrame:
    """(id, score): sum of 1 / (60 + rank) over the rankings that hold the id."""
    _limit_ok(limit, 1000)
    parts = [r.select("id", (1.0 / (RRF + F.col("rank"))).alias("part")) for r in rankings]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def hybrid(docs: DataFrame, query: str, embedding: list[float] | None = None, store: DataFrame | None = None, limit: int = 10, id_col: str = "doc_id", vector_id: str = "vec_id") -> DataFrame:
    """Fused lexical and vector search; without query terms only vectors rank."""
    lists = []
    if _query_terms(query):
        lists.append(ranked(bm25(docs, query, id_col)))
    if embedding is not None:
        lists.append(ranked(vector_scores(store, embedding, vector_id)))
    if not lists:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).where("false")
    return fused(lists, limit)


def neighbours(edges: DataFrame, entity: str) -> DataFrame:
    """Edges that touch an entity, in order."""
    return edges.where((F.col("source") == entity) | (F.col("target") == entity)).orderBy("source", "relation", "target", "document")


def memory_put(log: DataFrame) -> DataFrame:
    """Current documents from a log (seq, id, text, embedding): the last row of each id; an omitted vector is null. ``text_since``: first row of the present text's run."""
    w = Window.partitionBy("id").orderBy("seq")
    runs = log.withColumn("_new", (~F.lag("text").over(w).eqNullSafe(F.col("text"))) | F.lag("seq").over(w).isNull())
    runs = runs.withColumn("_since", F.max(F.when(F.col("_new"), F.col("seq"))).over(w))
    last = runs.groupBy("id").agg(F.max_by(F.struct("text", "embedding", "_since"), "seq").alias("r"))
    return last.select("id", "r.text", F.when(F.col("r.embedding").isNotNull(), normalized("r.embedding")).alias("embedding"), F.col("r._since").alias("text_since"))


def memory_relate(edge_log: DataFrame, documents: DataFrame) -> DataFrame:
    """Current edges from a log (seq, source, relation, target, document): each once, only with a document whose text has not changed since."""
    bad = F.lit(False)
    for c in ("source", "relation", "target", "document"):
        bad = bad | F.col(c).isNull() | (F.col(c) == "")
    log = edge_log.where(~bad)
    kept = log.join(documents.select(F.col("id").alias("document"), "text_since"), "document").where(F.col("seq") >= F.col("text_since"))
    return kept.select("source", "relation", "target", "document").distinct()


# --- full-text query language ---------------------------------------------------
@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Bool:
    kind: str  # and, or, not
    left: object
    right: object


class QueryError(ValueError):
    pass


@lru_cache
def _folding() -> tuple[str, str]:
    """Letters below U+0250 with a mark, and their bare letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def search_tokens(text: str | Column) -> Column:
    """Tokens of the full-text index: letters and digits, lower case, marks removed."""
    t = F.translate(F.lower(F.col(text) if isinstance(text, str) else text), *_folding())
    return F.regexp_extract_all(t, F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


def parse_query(query: str):
    """Boolean tree of words, "phrases" and prefix*, with AND (also by adjacency), OR, NOT and parentheses, in that order of binding from NOT down to OR."""
    if not isinstance(query, str) or not query.strip() or len(query) > 4096:
        raise QueryError("empty or too long query")
    lexed = re.findall(r'"((?:[^"]|"")*)"\s*(\*?)|([()])|([^\s()"*]+)(\*?)|(\S)', query)
    items = []
    for quoted, star, paren, word, tail, odd in lexed:
        if odd:
            raise QueryError(f"unexpected {odd!r}")
        if paren:
            items.append(paren)
        elif word in ("AND", "OR", "NOT") and not tail:
            items.append(word)
        else:
            if word and (not re.fullmatch(r"[\w\x80-\U0010ffff]+", word) or word == "NEAR"):
                raise QueryError(f"unsupported syntax {word!r}")
            words = tuple(re.findall(r"[^\W_]+", fold_marks(word or quoted)))
            items.append(Phrase(words, bool(star or tail)))
    at = 0

    def peek():
        return items[at] if at < len(items) else None

    def primary():
        nonlocal at
        item = peek()
        at += 1
        if isinstance(item, Phrase):
            return item
        if item != "(":
            raise QueryError("expected a term")
        out = either()
        if peek() != ")":
            raise QueryError("missing )")
        at += 1
        return out

    def adjacent():
        out = primary()
        while isinstance(peek(), Phrase) or peek() == "(":
            out = Bool("and", out, primary())
        return out

    def binary(name, below):
        def run():
            nonlocal at
            out = below()
            while peek() == name.upper():
                at += 1
                out = Bool(name, out, below())
            return out

        return run

    either = binary("or", binary("and", binary("not", adjacent)))
    out = either()
    if at != len(items):
        raise QueryError("unexpected text after the query")
    return out


def _phrases(tree) -> list[Phrase]:
    return [tree] if isinstance(tree, Phrase) else _phrases(tree.left) + _phrases(tree.right)


def _frequency(line: Column, p: Phrase) -> Column:
    """Places of a phrase in tokens joined by single blanks (one at each end); places may overlap."""
    if not p.words:
        return F.lit(0.0)
    # tokens are letters and digits, so the pattern needs no escapes
    return F.regexp_count(line, F.lit(f"(?= {' '.join(p.words)}{'' if p.prefix else ' '})")).cast("double")


def full_text(index: DataFrame, query: str, limit: int | None = None, id_col: str = "derivative_id", text_col: str = "text") -> DataFrame:
    """(id, score) of rows that match a boolean query, best first; idf is ln((N - n + .5) / (n + .5)), 1e-6 at least."""
    tree = parse_query(query)
    if limit is not None:
        _limit_ok(limit, 100)
    phrases = list(dict.fromkeys(_phrases(tree)))
    rows = index.select(F.col(id_col).alias("id"), search_tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    counts = rows.select("id", F.size("t").cast("double").alias("words"), F.array(*[_frequency(F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" ")), p) for p in phrases]).alias("tf"))

    def holds(node) -> Column:
        if isinstance(node, Phrase):
            return F.get("tf", F.lit(phrases.index(node))) > 0
        a, b = holds(node.left), holds(node.right)
        return a & b if node.kind == "and" else a | b if node.kind == "or" else a & ~b

    scored = counts.where(holds(tree)).join(F.broadcast(_corpus(counts, len(phrases))))
    score = F.lit(0.0)
    for p in _phrases(tree):
        i = phrases.index(p)
        tf, df = F.get("tf", F.lit(i)), F.get("df", F.lit(i))
        idf = F.greatest(F.lit(1e-6), F.log((F.col("docs") - df + 0.5) / (df + 0.5)))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("words") / F.col("mean")))
    out = scored.select("id", score.alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)


def embedded(docs: DataFrame, store: DataFrame, id_col: str = "doc_id", vector_id: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, status, vector): unit vectors of documents from a store of precomputed ones; a document without one is ``unsupported``, since no model is run here."""
    found = docs.select(F.col(id_col).alias("id")).join(store.where(F.col(vector_col).isNotNull()).select(F.col(vector_id).alias("id"), vector_col), "id", "left")
    there = F.col(vector_col).isNotNull()
    return found.select("id", F.when(there, "complete").otherwise("unsupported").alias("status"), F.when(there, normalized(vector_col)).alias("vector"))
