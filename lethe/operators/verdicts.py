"""Forgetting certificates: a target's weakest drop against pooled controls, and each neighbour's retention."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.functions.stats import sample_sd, t_critical, t_sf


def pooled_control(cells: DataFrame) -> DataFrame:
    """One row a target: weakest family and drop, pooled mean, sd and number of control cells, statistic.

    cells: target, role, fact, family, pos (order of the families), drop. Equal drops: the first family. sd 0: no statistic.
    """
    weakest = cells.where("role = 'target'").groupBy("target").agg(F.min_by("family", F.struct("drop", "pos")).alias("weakest_family"), F.min("drop").alias("t"))
    control = cells.where("role = 'neighbour'").groupBy("target").agg(F.avg("drop").alias("m"), sample_sd(F.col("drop")).alias("s"), F.count("*").alias("n"))
    found = weakest.join(control, "target")
    statistic = (F.col("t") - F.col("m")) / (F.col("s") * F.sqrt(1 + 1 / F.col("n")))
    return found.withColumn("t_forget", F.when((F.col("s") > 0) & (F.col("n") > 1), statistic))


def retention_tests(cells: DataFrame, kappa: float, alpha: float, n_families: int) -> DataFrame:
    """target, fact, mean, se, statistic, p and lower bound of retention of each neighbour against ln(kappa).

    se 0: the statistic is infinite and p is 0 or 1.
    """
    df = n_families - 1
    critical = t_critical(alpha, df)
    y = cells.where("role = 'neighbour'").groupBy("target", "fact").agg(F.avg("log_retention").alias("y_bar"), (sample_sd(F.col("log_retention")) / math.sqrt(n_families)).alias("se"))
    above = F.col("y_bar") > math.log(kappa)
    statistic = F.when(F.col("se") > 0, (F.col("y_bar") - math.log(kappa)) / F.col("se")).otherwise(F.when(above, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
    tested = y.withColumn("t_retain", statistic).withColumn("lower_bound", F.exp(F.col("y_bar") - critical * F.col("se")))
    return tested.withColumn("p_retain", t_sf(F.col("t_retain"), F.lit(float(df))))


def certificates(cells: DataFrame, alpha: float, kappa: float, n_families: int) -> DataFrame:
    """One row a target with both p-values, the weakest neighbour and the verdict."""
    forget = pooled_control(cells).withColumn("p_forget", t_sf(F.col("t_forget"), (F.col("n") - 1).cast("double")))
    retain = retention_tests(cells, kappa, alpha, n_families)
    worst = retain.groupBy("target").agg(F.max("p_retain").alias("p_retain"), F.max_by("fact", F.struct("p_retain", -F.col("fact"))).alias("weakest_neighbour"))
    both = forget.join(worst, "target", "left")
    forget_ok, retain_ok = F.coalesce(F.col("p_forget") <= alpha, F.lit(False)), F.col("p_retain") <= alpha
    verdict = (
        F.when(F.col("s") == 0, "degenerate_control")
        .when(retain_ok.isNull(), F.when(forget_ok, "forget_shown_retain_untested").otherwise("not_forgotten_retain_untested"))
        .when(forget_ok & retain_ok, "certified")
        .when(retain_ok, "not_forgotten")
        .when(forget_ok, "collateral_damage")
        .otherwise("both_failed")
    )
    return both.withColumn("p", F.when(F.col("p_forget").isNotNull(), F.greatest("p_forget", "p_retain"))).withColumn("verdict", verdict)


#: How far a log retention may be from the negative drop, as a share of the drop.
IDENTITY_TOLERANCE = 1e-9


def cell_faults(cells: DataFrame, families: list[str]) -> DataFrame:
    """target, fault of targets whose cells cannot be certified; the first fault that holds.

    Families are at least two distinct names. A target has one finite drop for each of them and no other; so has each neighbour, with a finite
    log retention that is its negative drop; there is a neighbour at least. cells: target, role, fact, family, drop, log_retention.
    """
    if len(families) < 2 or len(set(families)) != len(families):
        raise ValueError("families must be at least two distinct names")
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    drop, kept = F.col("drop"), F.col("log_retention")
    agrees = F.abs(kept + drop) <= IDENTITY_TOLERANCE * F.greatest(F.lit(1.0), F.abs(drop))
    known = F.coalesce(F.col("family").isin(*families), F.lit(False))
    by_fact = cells.groupBy("target", "role", "fact").agg(
        (F.bool_and(known) & (F.count("*") == len(families)) & (F.count_distinct("family") == len(families))).alias("whole"),
        F.bool_and(finite("drop")).alias("drops"),
        F.bool_and(finite("log_retention")).alias("kept"),
        F.bool_and(F.coalesce(agrees, F.lit(False))).alias("agrees"),
    )
    target, neighbour = F.col("role") == "target", F.col("role") == "neighbour"
    none = lambda of, what: F.count_if(of & ~F.col(what)) > 0
    fault = (
        F.when((F.count_if(target) != 1) | none(target, "whole"), "target needs one value per family")
        .when((F.count_if(neighbour) == 0) | none(neighbour, "whole"), "neighbours need one value per family")
        .when(none(target, "drops"), "target drop not finite")
        .when(none(neighbour, "drops"), "drop not finite")
        .when(none(neighbour, "kept"), "log retention not finite")
        .when(none(neighbour, "agrees"), "log retention is not the negative drop")
    )
    return by_fact.groupBy("target").agg(fault.alias("fault")).where("fault IS NOT NULL")
