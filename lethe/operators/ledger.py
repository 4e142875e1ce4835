"""Append-only tables: latest rows, upserts, supersede chains, lineage, disjointness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.storage import staged


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key; ``order`` must leave no ties."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])))
    return ranked.where("_rank = 1").drop("_rank")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """``current`` with the last change of each key in place of its row."""
    return current.join(changes, keys, "left_anti").unionByName(latest(changes, keys, *order))


def insert_new(current: DataFrame, rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """``current`` and the first of ``rows`` for keys it lacks."""
    ranked = rows.join(current, keys, "left_anti").withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return current.unionByName(ranked.where("_rank = 1").drop("_rank"))


def tips(rows: DataFrame, row_id: str, supersedes: str) -> DataFrame:
    """Rows that no other row supersedes."""
    old = rows.select(F.col(supersedes).alias("_old")).where("_old IS NOT NULL").distinct()
    return rows.join(old, F.col(row_id) == F.col("_old"), "left_anti")


def lineage(rows: DataFrame, row_id: str, parent: str, max_rounds: int = 40) -> DataFrame:
    """row, root, depth: pointer doubling, so a chain of n rows takes log2(n) rounds of one join.

    A cycle never ends and comes out with a null root; so does a chain whose parent is missing.
    """
    at = rows.select(F.col(row_id).alias("row"), F.col(parent).alias("up")).select("row", F.coalesce("up", "row").alias("root"), F.col("up").isNotNull().cast("long").alias("depth"), F.col("up").isNull().alias("done"))
    at = staged(at, "lineage")
    for _ in range(max_rounds):
        if at.where("NOT done").isEmpty():
            break
        above = at.select(F.col("row").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"), F.col("done").alias("end"))
        open_rows = at.where("NOT done").join(above, "root", "left")
        # a parent that does not exist ends the chain without a root
        moved = open_rows.select("row", F.col("next").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("end", F.lit(True)).alias("done"))
        at = staged(at.where("done").unionByName(moved), "lineage")
    return at.select("row", F.when(F.col("done"), F.col("root")).alias("root"), F.when(F.col("done") & F.col("root").isNotNull(), F.col("depth")).alias("depth"))


def overlap(rows: DataFrame, value: str, split: str, left: str, right: str) -> DataFrame:
    """value, n_left, n_right of values that both splits hold."""
    counts = rows.groupBy(value).agg(F.count_if(F.col(split) == left).alias("n_left"), F.count_if(F.col(split) == right).alias("n_right"))
    return counts.where("n_left > 0 AND n_right > 0")


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))
