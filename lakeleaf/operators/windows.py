"""Ranks, running sums and percentiles over whole tables without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeleaf.operators.tables import kept


def global_rank(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds a gapless number from 1 in the given order (which must tell rows apart): the table is range-partitioned and sorted once and written with each row's part and
    place in it, so that no later evaluation can part it differently; part sizes on the driver (one row a part) give each part's first number."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = kept(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), place.alias("_place")), "ranked")
    before, at = [], 0
    for r in sorted(numbered.groupBy("_part").count().collect()):
        before.append((r["_part"], at + 1))
        at += r["count"]
    firsts = spark.createDataFrame(before, "_part int, _first long")
    return numbered.join(F.broadcast(firsts), "_part").select(*rows.columns, (F.col("_first") + F.col("_place")).alias(name))


def head_before(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds ``before``, the value of the key's row before, and ``content_changed``, null for the key's first row."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("before", before).withColumn("content_changed", F.col("before") != F.col(value))


def ewma(rows: DataFrame, key: str, order: str, value: str, weight: float = 0.2) -> DataFrame:
    """(key, ewma): the exponential average of each key's values in order, rounded half to even at every step; the first value stands for itself."""
    ordered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).cast("double").alias("x")))).alias("s"))
    fold = F.aggregate("s", F.lit(None).cast("double"), lambda a, s: F.when(a.isNull(), s["x"]).otherwise(F.bround(s["x"] * weight + a * (1 - weight), 0)))
    return ordered.select(key, fold.alias("ewma"))


def running_offset(rows: DataFrame, file: str, seq: str, length: str, name: str = "offset") -> DataFrame:
    """Adds the sum of the lengths before each row of its file."""
    w = Window.partitionBy(file).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(length).over(w), F.lit(0)).cast("long"))


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by an aggregate that combines on the map side."""
    rest = [c for c in rows.columns if c not in keys]
    least = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return least.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def floor_percentiles(rows: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each group the element number floor(n * share), from 0, of its sorted values.

    Approximate quantiles bracket each wanted rank; only the values inside a bracket are sorted, and the rows
    below it are counted, so the result is exact and no group is sorted whole.
    """
    eps = 1e-3
    marks = sorted({min(1.0, max(0.0, s + d)) for s in shares.values() for d in (-eps, eps)})
    base = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("_v"))
    head = base.groupBy(*group).agg(F.count("*").alias("_n"), F.percentile_approx("_v", marks, F.lit(20_000)).alias("_q"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    joined = base.join(F.broadcast(head) if not group else head, group) if group else base.crossJoin(F.broadcast(head))
    out = None
    for name, share in shares.items():
        lo = F.when(F.lit(share - eps <= 0), F.col("_min")).otherwise(F.get("_q", F.lit(marks.index(max(0.0, share - eps)))))
        hi = F.when(F.lit(share + eps >= 1), F.col("_max")).otherwise(F.get("_q", F.lit(marks.index(min(1.0, share + eps)))))
        rank = F.floor(F.col("_n") * F.lit(share))
        inside = joined.where((F.col("_v") >= lo) & (F.col("_v") <= hi)).groupBy(*group, "_v").agg(F.count("*").alias("_k"), F.first(rank).alias("_r"))
        below = joined.groupBy(*group).agg(F.count_if(F.col("_v") < lo).alias("_below"))
        w = Window.partitionBy(*group).orderBy("_v") if group else Window.orderBy("_v")
        found = (inside.join(below, group) if group else inside.crossJoin(F.broadcast(below))).withColumn("_upto", F.col("_below") + F.sum("_k").over(w))
        part = found.where((F.col("_upto") > F.col("_r")) & (F.col("_upto") - F.col("_k") <= F.col("_r"))).select(*group, F.col("_v").alias(name))
        out = part if out is None else (out.join(part, group) if group else out.crossJoin(F.broadcast(part)))
    return out
