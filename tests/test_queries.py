"""Every query with an SQL twin gives the same rows as DuckDB."""

import os

import duckdb
import pytest

from lakeleaf.plans import registry

DATA = os.environ.get("LAKELEAF_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


#: What SQL cannot say is held to vectors by these tests.
HELD = {
    "test_discovery": ("html_discover_links",),
    "test_extract": ("html_visible_text", "udf_extract", "text_unified_diff", "join_compare_derivatives"),
    "test_json": ("canonical_json",),
    "test_sorted_json": ("derivative_json",),
    "test_pacing": ("state_circuit", "state_backoff", "state_telemetry"),
    "test_permission": ("state_token_bucket", "state_acquire"),
}


def test_every_query_is_held_by_sql_or_vectors():
    from tests import test_functions

    named = {q for test, held in HELD.items() if hasattr(test_functions, test) for q in held}
    assert set(registry.queries()) - set(registry.oracle_sql()) == named


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return bytes(v) if isinstance(v, (bytes, bytearray)) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


def test_short_copies_are_not_verified(spark, tmp_path):
    """Damaged later copies of at most 512 bytes, empty ones too, are revisits to the twin of agg_payload_verify."""
    texts = {1: "short", 3: "", 10: "short", 17: "", 24: "x" * 600, 31: "x" * 600, 38: "y" * 512, 45: "y" * 512, 52: None, 59: "other"}
    spark.createDataFrame([(i, x, "s") for i, x in texts.items()], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.target_uri for r in registry.queries()["agg_payload_verify"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0] for r in con.execute(registry.oracle_sql()["agg_payload_verify"]).fetchall()}
    assert got == want == {f"https://example.com/{i}" for i in (3, 24, 38, 59)}


def test_search_has_all_hits(spark, tmp_path):
    """More than 10 000 hits, of which the least document ranks last."""
    ids = [i for i in range(1, 40_000) if i % 4 and i % 9 and i % 10 and i % 13][:10_050]
    spark.createDataFrame([(i, "the x" if i > 1 else "the" + " word" * 50) for i in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(-1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [r.derivative_id for r in registry.queries()["filter_search_args"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == [r[0] for r in con.execute(registry.oracle_sql()["filter_search_args"]).fetchall()] == ["x1"]


@pytest.mark.parametrize("name", ["stream_journal_dedupe", "ext_window_counts", "stream_pacing"])
def test_streams_leave_no_rows_with_the_driver(spark, name):
    """What a stream gives is in files; a table in memory would be a temporary view."""
    before = {x.name for x in spark.catalog.listTables()}
    df = registry.queries()[name](spark, DATA)
    assert {x.name for x in spark.catalog.listTables()} == before and df.inputFiles()
