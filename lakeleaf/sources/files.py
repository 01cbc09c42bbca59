"""Index, manifest, profile, event and robots files as DataFrames with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeleaf.operators.archive import parsed_cdx

EVENT = T.StructType(
    [
        T.StructField("event", T.StringType()),
        T.StructField("ts", T.DoubleType()),
        T.StructField("url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("stage", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("_bad", T.StringType()),
    ]
)
PROFILE = "profile_id string, name string, target struct<base_url:string,allowed_domains:array<string>>, politeness struct<min_delay_ms:long,max_delay_ms:long,max_requests_per_minute:long,burst_limit:long,cooldown_seconds:long,consecutive_error_tripwire:long>, archival struct<max_depth:long,max_pages:long>, taxonomy array<struct<code:string,label:string,keywords:array<string>>>, _bad string"


def cdx(spark: SparkSession, path: str, fields: int = 11) -> DataFrame:
    return parsed_cdx(spark.read.text(path), fields)


def manifest_lines(lines: DataFrame) -> DataFrame:
    """(sha256, path) of ``<digest>  <path>`` lines; ``#`` starts a comment."""
    t = F.trim("value")
    rows = lines.where((t != "") & ~F.startswith(t, F.lit("#")))
    return rows.select(F.lower(F.regexp_extract(t, r"^(\S+)\s+", 1)).alias("sha256"), F.regexp_replace(t, r"^\S+\s+\*?", "").alias("path"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return manifest_lines(spark.read.text(path))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size) of every file below a folder, without dot files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(~F.col("path").rlike(r"/(\.|__pycache__)")).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def manifest_text(files: DataFrame) -> DataFrame:
    return files.select(F.concat_ws("  ", "sha256", "path").alias("value")).orderBy("value")


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles of a folder of JSON files; unreadable files are left out, the schema's own file too."""
    rows = spark.read.schema(PROFILE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.withColumn("file", F.col("_metadata.file_name"))
    return rows.where(F.col("_bad").isNull() & (F.col("file") != "schema.json") & F.col("profile_id").isNotNull()).drop("_bad")


def events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Event logs in JSON lines, as a table or a stream; lines that are no JSON have ``_bad``."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(EVENT).option("columnNameOfCorruptRecord", "_bad").json(path)


def discovered(ids: DataFrame, limit: int = 128) -> DataFrame:
    """The first ``limit`` distinct archive ids in order; the limit is the operator's own."""
    return ids.select("archive_id").where("archive_id is not null").distinct().orderBy("archive_id").limit(limit)
