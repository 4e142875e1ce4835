"""Jobs that go on where they stopped: a batch that dies is run again, and no key is lost or evaluated twice."""

from __future__ import annotations

from collections import Counter

import pytest
from lethe.streaming import jobs
from pyspark.sql import functions as F

KEYS = "fact string, role string"
NAME = "job one/50%"


def arrive(spark, path, rows):
    spark.createDataFrame(rows, KEYS).coalesce(1).write.mode("append").json(path)


def evaluate(batch):
    """Facts of an odd length have no score."""
    return jobs.judged(batch.withColumn("score", F.when(F.length("fact") % 2 == 0, F.length("fact").cast("double"))), "score")


@pytest.fixture
def store(spark, tmp_path):
    return jobs.JobStore(spark, f"{tmp_path}/store", ["fact", "role"], "fact string, role string, score double")


def source(spark, tmp_path):
    return spark.readStream.schema(KEYS).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/keys")


def seen(store):
    return Counter((r.fact, r.role, r.status) for r in store.results(NAME).collect())


def test_a_job_goes_on_after_a_failure(spark, store, tmp_path):
    for k in range(4):
        arrive(spark, f"{tmp_path}/keys", [(f"f{k}", "base"), (f"fact{k}", "base"), (f"f{k}", "tuned")])
    ran = []

    def dies_once(batch):
        ran.append(batch.count())
        if len(ran) == 3:
            # half of the batch is written before the job dies
            evaluate(batch.limit(1)).write.parquet(f"{store.path}/results/job=job%20one%2F50%25/attempt=0/batch=2")
            raise RuntimeError("killed")
        return evaluate(batch)

    with pytest.raises(Exception, match="killed"):
        jobs.run_job(source(spark, tmp_path), store, NAME, dies_once).awaitTermination()
    jobs.run_job(source(spark, tmp_path), store, NAME, dies_once).awaitTermination()
    assert ran == [3, 3, 3, 3, 3]
    found = seen(store)
    assert len(found) == 12 and set(found.values()) == {1}
    assert found[("f1", "base", "succeeded")] == 1 and found[("fact1", "base", "failed")] == 1
    jobs.run_job(source(spark, tmp_path), store, NAME, dies_once).awaitTermination()  # nothing has come since
    assert len(ran) == 5 and seen(store) == found


def test_completed_keys_are_left_out_and_failed_ones_due(spark, store, tmp_path):
    arrive(spark, f"{tmp_path}/keys", [("f1", "base"), ("fact1", "base"), ("f1", "base")])
    jobs.run_job(source(spark, tmp_path), store, NAME, evaluate).awaitTermination()
    arrive(spark, f"{tmp_path}/keys", [("f1", "base"), ("fact1", "base"), ("f2", "base")])
    jobs.run_job(source(spark, tmp_path), store, NAME, evaluate).awaitTermination()
    assert seen(store) == {("f1", "base", "succeeded"): 1, ("fact1", "base", "failed"): 2, ("f2", "base", "succeeded"): 1}
    jobs.retry_failed(store, NAME, lambda batch: jobs.judged(batch.withColumn("score", F.lit(1.0)), "score"))
    assert seen(store)[("fact1", "base", "succeeded")] == 1 and store.completed(NAME).count() == 3
    assert [(r.status, r.n) for r in store.summary().collect()] == [("succeeded", 3)]
    jobs.retry_failed(store, NAME, evaluate)
    assert sum(seen(store).values()) == 5


def test_rerun_clears(spark, store, tmp_path):
    arrive(spark, f"{tmp_path}/keys", [("f1", "base"), ("f2", "base")])
    jobs.run_job(source(spark, tmp_path), store, NAME, evaluate).awaitTermination()
    other = "another job"
    jobs.run_job(source(spark, tmp_path), store, other, evaluate).awaitTermination()
    jobs.run_job(source(spark, tmp_path), store, NAME, lambda batch: jobs.judged(batch.withColumn("score", F.lit(7.0)), "score"), rerun=True).awaitTermination()
    assert {(r.fact, r.score) for r in store.results(NAME).collect()} == {("f1", 7.0), ("f2", 7.0)}
    assert {(r.fact, r.score) for r in store.results(other).collect()} == {("f1", 2.0), ("f2", 2.0)}
    assert store.clear(NAME) == 2 and store.results(NAME).count() == 0
    assert {r.job for r in store.results().collect()} == {"another job"}
