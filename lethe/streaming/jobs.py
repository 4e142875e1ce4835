"""Evaluation jobs that go on where they stopped.

Keys of a job arrive as a stream. Each micro-batch is evaluated by a function of DataFrames and committed under its own number, so a
batch that is run again after a failure replaces what it had written and no other. Keys that have already succeeded are left out, whatever
batch they were in; keys that failed are due again. ``clear`` starts a new attempt: records of earlier ones are kept, but no longer read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

SUCCEEDED, FAILED = "succeeded", "failed"
ATTEMPTS = "job string, attempt int, token string"


class JobStore:
    """Records of jobs below ``path``: key columns, status, error and the evaluation's own columns, as ``schema`` says."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = f"{schema}, status string, error string"
        # so that both tables can be read; an append of no rows harms nobody
        spark.createDataFrame([], ATTEMPTS).coalesce(1).write.mode("append").parquet(f"{self.path}/attempts")
        spark.createDataFrame([], self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/results/job=_/attempt=-1/batch=-1")

    def attempt(self, job: str) -> int:
        found = self.spark.read.schema(ATTEMPTS).parquet(f"{self.path}/attempts").where(F.col("job") == job)
        return found.agg(F.coalesce(F.max("attempt"), F.lit(0))).first()[0]

    def results(self, job: str | None = None) -> DataFrame:
        """Records of the newest attempt of ``job``, or of each job."""
        partitions = ", job string, attempt int, batch long"
        rows = self.spark.read.schema(self.schema + partitions).option("basePath", f"{self.path}/results").parquet(f"{self.path}/results").where("attempt >= 0")
        if job is not None:
            return rows.where((F.col("job") == job) & (F.col("attempt") == self.attempt(job)))
        newest = self.spark.read.schema(ATTEMPTS).parquet(f"{self.path}/attempts").groupBy(F.col("job").alias("_job")).agg(F.max("attempt").alias("_newest"))
        return rows.join(F.broadcast(newest), F.col("job") == F.col("_job"), "left").where("attempt = coalesce(_newest, 0)").drop("_job", "_newest")

    def completed(self, job: str) -> DataFrame:
        """Keys that have succeeded."""
        return self.results(job).where(F.col("status") == SUCCEEDED).select(*self.keys).distinct()

    def clear(self, job: str) -> int:
        """Begins a new attempt; how many records the last one had."""
        gone = self.results(job).count()
        row = [(job, self.attempt(job) + 1, uuid.uuid4().hex)]
        self.spark.createDataFrame(row, ATTEMPTS).coalesce(1).write.mode("append").parquet(f"{self.path}/attempts")
        return gone

    def commit(self, job: str, batch: int, due: DataFrame, evaluate: Callable[[DataFrame], DataFrame]) -> None:
        """Evaluates the keys of one batch that are still due and writes them as that batch, in place of what it held."""
        done = self.results(job).where((F.col("batch") != batch) & (F.col("status") == SUCCEEDED)).select(*self.keys).distinct()
        left = due.dropDuplicates(self.keys).join(done, self.keys, "left_anti")
        columns = self.spark.createDataFrame([], self.schema).columns
        folder = f"{self.path}/results/job={quote(job, safe='')}/attempt={self.attempt(job)}/batch={batch}"
        evaluate(left).select(*columns).write.mode("overwrite").parquet(folder)

    def summary(self) -> DataFrame:
        """job, status, n over the newest attempts; of a key that was evaluated again the last batch counts."""
        last = self.results().groupBy("job", *self.keys).agg(F.max_by("status", "batch").alias("status"))
        return last.groupBy("job", "status").agg(F.count("*").alias("n"))


def judged(evaluated: DataFrame, value: str, why: str = "no value") -> DataFrame:
    """status and error by whether the evaluation gave a value."""
    failed = F.col(value).isNull()
    return evaluated.withColumn("status", F.when(failed, FAILED).otherwise(SUCCEEDED)).withColumn("error", F.when(failed, why))


def run_job(source: DataFrame, store: JobStore, job: str, evaluate: Callable[[DataFrame], DataFrame], rerun: bool = False) -> StreamingQuery:
    """Evaluates all keys that the stream ``source`` holds now; started again, those that have come since.

    The stream's position is kept for each attempt, so ``rerun`` begins with the first key again.
    """
    if rerun:
        store.clear(job)
    checkpoint = f"{store.path}/positions/{quote(job, safe='')}-{store.attempt(job)}"
    writer = source.writeStream.foreachBatch(lambda batch, number: store.commit(job, number, batch, evaluate))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_failed(store: JobStore, job: str, evaluate: Callable[[DataFrame], DataFrame]) -> None:
    """Evaluates once more the keys that have only failed so far, as a batch of their own after all others."""
    done = store.completed(job)
    due = store.results(job).select(*store.keys).distinct().join(done, store.keys, "left_anti")
    # far beyond the numbers of the stream, which go on from its own last one
    latest = store.results(job).agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0]
    store.commit(job, max(latest, 1 << 40) + 1, due, evaluate)
