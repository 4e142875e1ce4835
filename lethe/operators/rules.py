"""One rule engine for data validation: rules are named predicates, violations are rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    rule_id: str
    holds: Column  # null counts as broken


def violations(rows: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """key, rule_id for each broken rule, in one pass."""
    broken = F.array(*[F.when(~F.coalesce(r.holds, F.lit(False)), F.lit(r.rule_id)) for r in rules])
    return rows.select(F.col(key).alias("key"), F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule_id"))


def rule_counts(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule_id, n_rows, n_broken for every rule, broken or not."""
    counts = [F.count_if(~F.coalesce(r.holds, F.lit(False))).alias(f"r{i}") for i, r in enumerate(rules)]
    one = rows.agg(F.count("*").alias("n_rows"), *counts)
    each = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"r{i}").alias("n_broken")) for i, r in enumerate(rules)])
    return one.select("n_rows", F.inline(each)).select("rule_id", "n_rows", "n_broken")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_references(rows: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """column, n of values that ``target`` lacks."""
    known = target.select(F.col(key).alias(column)).distinct()
    return rows.join(known, column, "left_anti").where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def group_counts(rows: DataFrame, group: str, holds: dict[str, Column]) -> DataFrame:
    """rule_id, n_groups, n_broken of rules on aggregates of each group, all from one pass over the rows."""
    checks = [F.coalesce(ok, F.lit(False)).alias(f"r{i}") for i, ok in enumerate(holds.values())]
    one = rows.groupBy(group).agg(*checks).agg(F.count("*").alias("n_groups"), *[F.count_if(~F.col(f"r{i}")).alias(f"n{i}") for i in range(len(holds))])
    each = F.array(*[F.struct(F.lit(rule_id).alias("rule_id"), F.col(f"n{i}").alias("n_broken")) for i, rule_id in enumerate(holds)])
    return one.select("n_groups", F.inline(each)).select("rule_id", "n_groups", "n_broken")


def frozen(current: DataFrame, baseline: DataFrame, amended: DataFrame, key: str, content: Column) -> DataFrame:
    """key, status: frozen, amended, changed without amendment, or no baseline. A key's digest is an order-free sum over its rows."""

    def digests(rows: DataFrame, name: str) -> DataFrame:
        part = F.conv(F.substring(F.sha2(F.to_json(content), 256), 1, 15), 16, 10).cast("decimal(38,0)")
        return rows.groupBy(key).agg(F.struct(F.count("*"), F.sum(part)).alias(name))

    both = digests(current, "_now").join(digests(baseline, "_old"), key, "left").join(amended.select(key, F.lit(True).alias("_amended")), key, "left")
    status = F.when(F.col("_old").isNull(), "no baseline").when(F.col("_now") == F.col("_old"), "frozen").when(F.col("_amended"), "amended").otherwise("changed without amendment")
    return both.select(key, status.alias("status"))


def gate(*checks: str) -> Column:
    """pass, or the names of the columns that are not true."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(name, F.lit(False)), F.lit(name)) for name in checks]))
    return F.when(F.size(failed) == 0, "pass").otherwise(F.array_join(failed, "+"))
