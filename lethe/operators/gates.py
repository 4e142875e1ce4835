"""Ordered rules as columns: admission, surfaces, tolerances, channels, responses and evidence. The first that applies decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def admission_reason(resolved: Column, well_formed: Column, readers: Column, verdict: Column) -> Column:
    """Null for a mention that is admitted, else the first reason against it."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(no(resolved), "span_unresolved")
        .when(no(well_formed), "malformed")
        .when(F.coalesce(F.size(F.array_distinct(readers)), F.lit(0)) < 2, "single_reader")
        .when(verdict.isNull(), "pending")
        .when(verdict == "accept", F.lit(None))
        .when(verdict == "reject", "rejected")
        .otherwise("malformed")
    )


def mapped(surfaces: DataFrame, policy: DataFrame) -> DataFrame:
    """``surfaces`` (surface, ...) with status and canonical. policy: surface, canonical, rank; of equal surfaces the lowest rank counts."""
    key = F.lower("surface").alias("_key")
    first = policy.groupBy(key).agg(F.min_by(F.struct("canonical"), "rank").alias("_hit"))
    found = surfaces.withColumn("_key", F.lower("surface")).join(first, "_key", "left")
    status = F.when(F.col("_hit").isNull(), "excluded").when(F.col("_hit.canonical").isNull(), "deferred").otherwise("included")
    return found.withColumn("status", status).withColumn("canonical", F.col("_hit.canonical")).drop("_key", "_hit")


def inside(value: Column, tolerance: float, closed: bool) -> Column:
    """Within a symmetric tolerance; a missing value is not."""
    size = F.abs(value)
    return F.coalesce(size <= tolerance if closed else size < tolerance, F.lit(False))


def first_outside(dimensions: dict[str, tuple[Column, float, bool]]) -> Column:
    """Name of the first dimension (value, tolerance, closed) that is not inside, null if all are."""
    return F.coalesce(*[F.when(~inside(*d), F.lit(name)) for name, d in dimensions.items()])


def split_name(split: Column, known: list[str]) -> Column:
    """A split's own name behind its spellings; null for one that is not known."""
    name = F.replace(F.lower(F.trim(split)), F.lit("-"), F.lit("_"))
    return F.when(name.isin(known), name)


def permitted(channel: Column, samples: int) -> Column:
    """Enabled, able to score, and with as many samples as are required."""
    return F.coalesce(channel["enabled"] & channel["capability"]["scores"] & (channel["capability"]["samples"] >= samples), F.lit(False))


def response_label(text: Column) -> Column:
    lowered = F.lower(text)
    return F.when(lowered.rlike("sorry|cannot"), "refusal").when(lowered.rlike("(^|[^a-z])(not|no|nein|nicht|non)([^a-z]|$)"), "negated").otherwise("plain")


def route_outcome(refused: Column, clean: Column, families: Column) -> Column:
    return F.when(refused, "reject_refusal").when(clean == 0, "reject_clue").when((families >= 2) & (clean >= 2), "confirmed").otherwise("not_confirmed")


def evidence_verdict(evidence: Column) -> Column:
    return (
        F.when(~evidence["complete"], "incomplete")
        .when(~evidence["identified"], "non_identifiable")
        .when(evidence["leaked"], "reject_leak")
        .when(~evidence["witnessed"], "reject_no_witness")
        .otherwise("accept")
    )


def capacity(budget: DataFrame, spent: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total, used, status of each declared budget: within, over or negative. spent: keys, amount."""
    used = spent.groupBy(*keys).agg(F.sum("amount").alias("used"), F.min("amount").alias("_least"))
    found = budget.join(used, keys, "left")
    status = F.when(F.coalesce("_least", F.lit(0)) < 0, "negative").when(F.coalesce("used", F.lit(0)) > F.col("total"), "over").otherwise("within")
    return found.select(*keys, "total", F.coalesce("used", F.lit(0)).alias("used"), status.alias("status"))


def first_match(rows: DataFrame, keys: list[str], preferred: Column, order: str, value: str) -> DataFrame:
    """keys, value: the earliest preferred row of each key, else the earliest one."""
    ranked = Window.partitionBy(*keys).orderBy(F.coalesce(preferred, F.lit(False)).desc(), order)
    return rows.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").select(*keys, value)
