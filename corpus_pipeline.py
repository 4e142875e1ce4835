"""From raw documents to token files, in five stages; each reads its predecessor's table and works on all of it.

Only ids and thresholds travel between a stage's decision and the texts. A stage's columns are those of its input.

Null and empty texts: each stage treats them as its operator does. Rows with a null id are judged as others are, and stay unless their id's
rows all go. Of rows that repeat an id one is left after the second stage. Very long texts are read whole. An empty table leaves no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.llm import decontamination, jaccard, mixing, resampling, shared, token_files


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws. An id goes if none of its rows is drawn."""
    weighed = resampling.weigh(docs, shared.table(spark, sf_dir, "labels"))
    rejected = weighed.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("NOT kept").select("doc_id")
    return shared.by_ids(docs, shared.staged(rejected, "rejected"), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that with the smallest id; of rows that repeat an id, that with the least text."""
    found = shared.staged(jaccard.jaccard_components(docs, count_links=False), "components")
    kept = shared.by_ids(docs, shared.staged(found.where("doc_id != component_id").select("doc_id").distinct(), "copies"), "left_anti")
    if found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    rest = F.struct("text", *[name for name in kept.columns if name not in ("doc_id", "text")])
    one = kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(rest).alias("least")).select("doc_id", "least.*")
    return kept.where("doc_id IS NULL").unionByName(one.select(kept.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = decontamination.find_leaks(docs, shared.table(spark, sf_dir, "benchmark"))
    return shared.by_ids(docs, shared.staged(leaks.select("doc_id").distinct(), "leaks"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    return mixing.apply_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; what they hold for each document."""
    return token_files.write_tokens(docs).digests()


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokenize),
]
#: SQL can express neither the classifier nor the encoding; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.staged(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
