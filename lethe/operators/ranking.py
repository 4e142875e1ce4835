"""Numbering and running extremes over whole tables without a single task for all rows.

Rows are range-partitioned by their order and written; each partition numbers its own rows, and what the partitions before it
hold (one row each) is added. Groups that lead the order need no partition of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.storage import staged


def ranged(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with _part, the number of the range that holds them in ``order``, and _at, their place in it from 1."""
    parted = staged(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    return parted.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))


def with_numbers(placed: DataFrame) -> DataFrame:
    """What ``ranged`` gives, with number: the place in the whole order from 0."""
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a range
    return placed.join(F.broadcast(before), "_part").withColumn("number", (F.col("_before") + F.col("_at") - 1).cast("long")).drop("_before")


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with number, their place in ``order`` from 0."""
    return with_numbers(ranged(rows, *order)).drop("_part", "_at")


def running(placed: DataFrame, value: Column, extreme: Callable[[Column], Column], of_two: Callable[..., Column], backward: bool = False) -> DataFrame:
    """What ``ranged`` gives, with running: the greatest or least ``value`` up to each row, or from it on."""
    placed = placed.withColumn("_value", value)
    turn = (lambda name: F.col(name).desc()) if backward else F.col
    whole = placed.groupBy("_part").agg(extreme(F.col("_value")).alias("_of_part"))
    earlier = Window.orderBy(turn("_part")).rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("_part", extreme(F.col("_of_part")).over(earlier).alias("_before"))  # a row a range
    own = extreme(F.col("_value")).over(Window.partitionBy("_part").orderBy(turn("_at")).rowsBetween(Window.unboundedPreceding, 0))
    return placed.join(F.broadcast(before), "_part").withColumn("running", of_two(own, F.coalesce("_before", own))).drop("_value", "_before")


def running_sum(rows: DataFrame, value: Column, *order: Column | str) -> DataFrame:
    """``rows`` with running: the sum of ``value`` up to each row in ``order``."""
    placed = ranged(rows.withColumn("_value", value), *order)
    sums = placed.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))  # a row a range
    own = F.sum("_value").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return placed.join(F.broadcast(before), "_part").withColumn("running", own + F.col("_before")).drop("_part", "_at", "_value", "_before")
