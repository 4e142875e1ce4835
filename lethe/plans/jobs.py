"""A job over orders as they arrive, gone on with and retried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.registry import register
from lethe.sources.tables import table
from lethe.storage import new_folder
from lethe.streaming import jobs


@register(
    "resumable_job",
    """WITH s AS (SELECT o_orderkey AS fact, sum(l_quantity) AS score FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag <> 'R' GROUP BY o_orderkey)
SELECT fact, CASE WHEN score IS NULL THEN 'failed' ELSE 'succeeded' END AS status, score, false AS retried FROM s UNION ALL SELECT fact, 'succeeded', 0.0, true FROM s WHERE score IS NULL""",
)
def resumable_job(spark: SparkSession, folder: str) -> DataFrame:
    """Each order's score once, from a stream of orders; a second run finds nothing new, and orders without a score are retried."""
    store = jobs.JobStore(spark, new_folder(spark, "job"), ["fact"], "fact long, score double")
    lines = table(spark, folder, "lineitem").where("l_returnflag != 'R'").groupBy(F.col("l_orderkey").alias("fact")).agg(F.sum("l_quantity").alias("score"))
    # a stream reads a folder or what a pattern names
    orders = spark.readStream.schema("o_orderkey long").parquet(f"{folder}/order[s].parquet").select(F.col("o_orderkey").alias("fact"))
    for _ in range(2):
        jobs.run_job(orders, store, "orders", lambda due: jobs.judged(due.join(lines, "fact", "left"), "score")).awaitTermination()
    jobs.retry_failed(store, "orders", lambda due: jobs.judged(due.withColumn("score", F.lit(0.0)), "score"))
    return store.results("orders").select("fact", "status", "score", (F.col("batch") > 1 << 40).alias("retried"))
