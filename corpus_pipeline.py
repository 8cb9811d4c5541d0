"""The corpus pipeline: five stages over whole documents, each written as Parquet and read again by the next.

Stages take rows with the columns of documents, read no other column, and return just those (the last one: the mix). Empty tables
give empty ones; repeated rows are rows like others except where a stage says otherwise; texts may have any length. Null ids are
ids like others to the first stage and the last two; what the others do with them they say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklake.llm import decontaminate, language_id, mixing, shingle_dedup, simhash_dedup, substring_dedup
from sparklake.llm._text import input_bytes
from sparklake.session import discard, materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if no language accounts for this share of it.
LEAST_SCORE = 0.4
#: Bytes of documents that a task of the mix's shuffle stands for, about, in large corpora.
FAN_BYTES = 1 << 30


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: those without a letter or without a leading language go."""
    found = language_id.identify(docs, language_id.fit(docs), keep=COLUMNS[1:])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: texts whose SimHashes are near and whose five-word shingles have a Jaccard similarity
    of 0.8 or more. The smallest doc_id stays (ties: the smaller hash of the text; null ids come last), of equal rows one."""
    found = simhash_dedup.near_duplicates(docs, shingle=shingle_dedup.SHINGLE, budget=shingle_dedup.BUDGET, threshold=shingle_dedup.THRESHOLD)
    found = materialise(found.groupBy("doc_id", "text_hash").agg(F.bool_and("first").alias("first"), F.count("*").alias("n")), "groups")
    key = [F.col("k").eqNullSafe(F.col("doc_id")), F.col("h") == F.col("text_hash")]
    rows = docs.select(F.col("doc_id").alias("k"), F.xxhash64("text").alias("h"), *[F.col(c).alias(f"_{c}") for c in COLUMNS])
    left = rows.join(found.where("NOT first"), key, "left_anti")
    if not found.where("first AND n > 1").isEmpty():
        left = left.dropDuplicates(["k", "h"])
    return left.select(*[F.col(f"_{c}").alias(c) for c in COLUMNS])


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages of 20 words or more; documents of which nothing is left go, untouched ones stay as they are. Rows without an id are
    documents of their own, first in the order."""
    found = substring_dedup.dedup_substrings(docs, keep=("lang", "source"), normalise=False)
    left = found.where("n_words = 0 OR n_removed < n_words").withColumnRenamed("kept", "text")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts on either side hold nothing."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is taken, with its shard and its place there."""
    mixed = mixing.mix(docs, keep=COLUMNS[1:])
    return mixing.draw(mixed, fan=max(64, input_bytes(docs) // FAN_BYTES)).select("shard", "order_key", "copy", *COLUMNS, "size")


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing_sources),
]

#: SQL can't express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        if k:
            discard(before)
    return docs
