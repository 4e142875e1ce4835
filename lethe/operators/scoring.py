"""Score roll-ups and comparisons of two score sets.

Scores are rows (fact, family, probe, score) of log probabilities. A fact's score is the mean of its family means, so
families weigh the same whatever their number of probes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero_if_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def family_means(scores: DataFrame, *keys: str) -> DataFrame:
    """fact, family (and keys): mean score and number of probes."""
    return scores.groupBy(*keys, "fact", "family").agg(F.avg("score").alias("score"), F.count("*").alias("n"))


def fact_means(families: DataFrame, *keys: str) -> DataFrame:
    """fact (and keys): unweighted mean over its families."""
    return families.groupBy(*keys, "fact").agg(F.avg("score").alias("score"), F.count("*").alias("n_families"))


def score_levels(scores: DataFrame) -> DataFrame:
    """level, fact, family, score: family rows, fact rows and one overall row."""
    families = family_means(scores)
    facts = fact_means(families)
    overall = facts.agg(F.avg("score").alias("score"))
    rows = families.select(F.lit("family").alias("level"), "fact", "family", "score")
    rows = rows.unionByName(facts.select(F.lit("fact").alias("level"), "fact", "score"), allowMissingColumns=True)
    return rows.unionByName(overall.select(F.lit("epoch").alias("level"), "score"), allowMissingColumns=True)


def drop_retention(baseline: DataFrame, current: DataFrame, targets: Column) -> DataFrame:
    """role, fact, family, drop, log_retention, retention where both sides have the family. ``targets`` is true of target facts."""
    b = family_means(baseline).select("fact", "family", F.col("score").alias("before"))
    c = family_means(current).select("fact", "family", F.col("score").alias("after"))
    log_retention = F.col("after") - F.col("before")
    return b.join(c, ["fact", "family"]).select(
        F.when(targets, "target").otherwise("neighbour").alias("role"), "fact", "family",
        (-log_retention).alias("drop"), log_retention.alias("log_retention"), F.exp(log_retention).alias("retention"),
    )


def neighbour_retention(changes: DataFrame) -> DataFrame:
    """family, target_drop, mean_log_retention and geometric mean retention of the neighbours; 0 and 1 without neighbours."""
    neighbour = F.col("role") == "neighbour"
    mean = zero_if_empty(F.avg(F.when(neighbour, F.col("log_retention"))))
    found = changes.groupBy("family").agg(
        F.avg(F.when(~neighbour, F.col("drop"))).alias("target_drop"), mean.alias("mean_log_retention"), F.count_if(neighbour).alias("n_neighbours")
    )
    return found.withColumn("retention", F.exp("mean_log_retention"))


def log_sum_exp(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, total: ln of the sum of exp, stable for small values; the maximum comes first, so both steps are combined before the shuffle."""
    top = rows.groupBy(key).agg(F.max(value).alias("top"))
    lifted = rows.join(top, key).groupBy(key).agg(F.first("top").alias("top"), F.sum(F.exp(F.col(value) - F.col("top"))).alias("sum"))
    return lifted.select(key, (F.col("top") + F.log("sum")).alias("total"))


def gate_compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Metrics of facts that both sides have; a missing metric counts as 0. Sides: fact, metric, value."""
    pair = left.select("fact", "metric", F.col("value").alias("l")).join(right.select("fact", "metric", F.col("value").alias("r")), ["fact", "metric"])
    return pair.select("fact", "metric", zero_if_empty(F.col("l")).alias("left_value"), zero_if_empty(F.col("r")).alias("right_value")).withColumn(
        "difference", F.col("left_value") - F.col("right_value")
    )


def family_rates(rows: DataFrame, families: DataFrame) -> DataFrame:
    """family, n (distinct cases), n_rows, rate of errors, for each requested family and overall; no rows: n 0 and a null rate."""
    stats = [F.count_distinct("case_id").alias("n"), F.count("case_id").alias("n_rows"), F.avg(F.col("error").cast("double")).alias("rate")]
    wanted = families.select("family").distinct()
    found = wanted.join(rows, "family", "left").groupBy("family").agg(*stats)
    return found.unionByName(rows.agg(*stats).withColumn("family", F.lit("overall")))


def rate(numerator: Column, denominator: Column) -> Column:
    """Null, never 0, where the denominator is 0."""
    return F.try_divide(numerator, denominator)
