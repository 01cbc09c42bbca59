"""Corpus preparation: each stage applies one operator to what the stage before kept.

Language ID drops documents that it rejects; SimHash keeps one document of each near-duplicate group;
decontamination drops documents that hold a benchmark item; the secret scan masks what it finds; packing lays
all that is left into sequences.

Defined cases, stage by stage: null texts and texts without a letter are no language and go first, so no later stage
meets a null text; a null or repeated doc_id is a row like any other (of rows that repeat a doc_id one stays, since they are one document to
near-dedup; rows of null doc_id stay unless their texts are near); ties between near duplicates go to the smallest doc_id; columns
beyond those of documents pass through under any name until packing; without labels nothing is learned and every row goes; an empty
table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeleaf.llm import decontaminate, langid, packing, secrets, simhash
from lakeleaf.llm.common import written
from lakeleaf.llm.queries import tokenizer_path


def unused(name: str, taken: list[str]) -> str:
    while name in taken:
        name = "_" + name
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = tuple(unused(n, docs.columns) for n in ("lang_pred", "score", "rejected"))
    scored = langid.predict(docs, langid.fit(docs), names)
    return scored.where(~scored[names[2]]).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Stages beyond SQL: tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
