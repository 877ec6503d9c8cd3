"""Corpus pipeline: five stages from raw documents to token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents.  All but the
last return the columns they were given; rows are dropped or repeated, and only the
third stage changes texts, from which it cuts benchmark passages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortloom.llm import contamination, importance, set_join, source_mix, token_file
from cohortloom.llm.common import BROADCAST_ROWS, word_count
from cohortloom.storage import materialize

#: The stages end in token ids, which SQL cannot express.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that importance resampling towards quality 1 rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = importance.classify(docs, labels, F.col("quality") == 1, keep=docs.columns)
    return judged.where("kept").select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the one with the smallest doc_id.

    Where ids are missing or repeat, rows are judged one by one by a written row
    number: the first row with the smallest id stays, one without id only if no other has one.
    """
    ids = docs.groupBy("doc_id").count()
    if not ids.where("doc_id is null or count > 1").limit(1).count():
        found = materialize(set_join.link_components(docs), "pipeline-components")
        return _without(docs, found, "doc_id")
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.monotonically_increasing_id().alias("row"))
    rows = materialize(docs.select(F.struct(*docs.columns).alias("doc"), "text", place.alias("place")), "pipeline-rows")
    found = materialize(set_join.link_components(rows, "place"), "pipeline-components")
    return _without(rows, found, "place").select("doc.*")


def _without(docs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``docs`` without the keys that are not the first of their component."""
    gone = materialize(found.where(F.col("component_id") != F.col(key)).select(key), "pipeline-gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, key, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents of which at least one word in twenty is benchmark text, cut longer passages from the others."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination.decontaminate(docs, items)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit every document as often as its source's target weight asks for."""
    sized = docs.withColumn("_mix_size", word_count(F.col("text")))
    planned = source_mix.plan_copies(sized, ["doc_id"], size="_mix_size")
    return source_mix.emit(planned).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token file and return each document's place, length and checksum, read back from it."""
    path = token_file.default_path(spark)
    token_file.write(docs, path, "byte_bpe_50k.json")
    return token_file.read(spark, path).withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
