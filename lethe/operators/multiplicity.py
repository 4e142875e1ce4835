"""Adjustment of p-values for multiple tests: ranks and running extremes over the sorted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.operators import ranking


EULER = 0.5772156649015329
#: Up to this number harmonic numbers are summed; beyond it Euler and Maclaurin's series is exact to the last digits of a double.
SUMMED = 64


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m at a cost that does not grow with m."""
    few = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(SUMMED)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / i)
    x = m.cast("double")
    return F.when(m <= SUMMED, few).otherwise(F.log(x) + EULER + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4))) - 1 / (252 * F.pow(x, F.lit(6))))


def raised(procedure: str, p: str, rank: Column, m: Column) -> Column:
    """A p-value of this rank among m before it is made monotone."""
    if procedure == "holm":
        return (m - rank + 1) * F.col(p)
    if procedure == "bh":
        return m / rank * F.col(p)
    if procedure == "by":
        return harmonic(m) * m / rank * F.col(p)
    raise ValueError(procedure)


def adjusted(rows: DataFrame, p: str, order: str, procedure: str, *groups: str) -> DataFrame:
    """``rows`` with column ``adjusted`` by holm, bh or by, within ``groups``. ``order`` settles ties and is unique in a group.

    Without groups the whole table is one family, which is ranked range by range.
    """
    extreme = F.max if procedure == "holm" else F.min
    if not groups:
        placed = ranking.with_numbers(ranking.ranged(rows, F.col(p), F.col(order)))
        ranked = placed.join(F.broadcast(placed.agg(F.count("*").alias("_m"))))  # one row
        raw = raised(procedure, p, F.col("number") + 1, F.col("_m"))
        found = ranking.running(ranked, raw, extreme, F.greatest if procedure == "holm" else F.least, backward=procedure != "holm")
        return found.withColumn("adjusted", F.least(F.lit(1.0), "running")).select(*rows.columns, "adjusted")
    whole = Window.partitionBy(*groups)
    rank = F.row_number().over(whole.orderBy(F.col(p), F.col(order)))
    ranked = rows.withColumn("_rank", rank).withColumn("_m", F.count("*").over(whole))
    by = whole.orderBy("_rank" if procedure == "holm" else F.col("_rank").desc())
    value = extreme(raised(procedure, p, F.col("_rank"), F.col("_m"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("adjusted", F.least(F.lit(1.0), value)).drop("_rank", "_m")
