"""Shared helpers: tables in the shared checkpoint folder, text bytes, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside operators; such a row sorts before every other one.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``; a local one only where that is unset and Spark runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lakeleaf-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lakeleaf/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lakeleaf_path = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    path = getattr(df, "_lakeleaf_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``position``, its gapless rank from 0 in ``order`` (which must tell all rows apart): one range partitioning, written with each row's place in its part; parts' sizes give the offsets."""
    n = shuffle_partitions(df.sparkSession)
    inner = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's place in its partition
    parts = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), inner.alias("_place")), "ranked")
    sizes = sorted((r["_part"], r["n"]) for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect())  # one row for each part
    offsets, at = [], 0
    for part, size in sizes:
        offsets.append((part, at))
        at += size
    table = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    return parts.join(F.broadcast(table), "_part").select(*df.columns, (F.col("_before") + F.col("_place")).alias("position"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text under private names, with a text hash that tells rows sharing a doc_id apart."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.xxhash64(F.col("text")).alias("_h"),
        F.coalesce(F.col("text"), F.lit("")).alias("_text"),
    )


def real_id(name: str = "_id"):
    return F.when(F.col(name) != F.lit(NULL_ID), F.col(name))


def byte_slices(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column without nulls, and where each value starts (one more entry than values)."""
    import pyarrow as pa

    wide = column.cast(pa.large_string())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(wide) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _local_components(batches):
    """Union-find over all edges of one task, linking to the smaller node."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    for lo in range(0, len(nodes), 50_000):
        part = nodes[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["node", "component"])


def connected_components(edges: DataFrame, max_rounds: int = 60, local: int = 1_000_000) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds. Each star is a minimum per node (combined on the map
    side) joined back to the edges, so a node with many links is split by the skew join instead of being
    gathered. Every round's edges are written to the shared folder; only a count of changes reaches the driver.
    Rounds end early once at most ``local`` edges are left: one executor task, whose memory that bound limits,
    then joins them exactly. Both ways give the same components.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        joined = both.join(least, both.u == least.c)
        if large:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if sums.n <= local:
            return now.coalesce(1).mapInArrow(_local_components, "node long, component long")
        if (sums.n, sums.s) == seen:
            break
        seen = (sums.n, sums.s)
        after = written(star(star(now, True), False), "links")
        dropped(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
