"""Block bootstrap over (checkpoint, fact) blocks.

Multiplicities come from a hash of (seed, replicate, draw), so reruns and other engines agree. Rows are summed by block
first; a replicate is then a weighted sum of blocks, never a copy of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.operators import ranking
from lethe.storage import staged


def draw(seed: int, replicate: Column, number: Column, n: Column, label: str = "") -> Column:
    """A number in [0, n) from 48 bits of MD5."""
    text = F.concat_ws("|", F.lit(f"{label}{seed}"), replicate.cast("string"), number.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % n


def block_sums(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, errors, n. rows: keys, error."""
    return rows.groupBy(*keys).agg(F.sum(F.col("error").cast("long")).alias("errors"), F.count("*").alias("n"))


def multiplicities(blocks: DataFrame, replicates: int, seed: int, label: str = "") -> DataFrame:
    """replicate, number (of a block in their order), times: as many draws as there are blocks. Draws are rows of a range, dealt over all tasks."""
    n = blocks.count()
    draws = blocks.sparkSession.range(replicates * n)
    replicate, number = F.floor(F.col("id") / max(n, 1)), F.col("id") % max(n, 1)
    picked = draws.select(replicate.alias("replicate"), draw(seed, replicate, number, F.lit(max(n, 1)), label).alias("number"))
    return picked.groupBy("replicate", "number").agg(F.count("*").alias("times"))


def nested(rows: DataFrame, keys: list[str], replicates: int, seed: int) -> DataFrame:
    """replicate, errors, n, rate: whole blocks drawn with replacement."""
    blocks = staged(ranking.numbered(block_sums(rows, *keys), *keys), "blocks")
    weighted = multiplicities(blocks, replicates, seed).join(blocks, "number")
    found = weighted.groupBy("replicate").agg(F.sum(F.col("times") * F.col("errors")).alias("errors"), F.sum(F.col("times") * F.col("n")).alias("n"))
    return found.withColumn("rate", F.coalesce(F.try_divide("errors", "n"), F.lit(0.0)))


def crossed(rows: DataFrame, first: str, second: str, replicates: int, seed: int) -> DataFrame:
    """replicate, errors, n, rate: both factors are drawn on their own; a cell counts as often as the product says."""
    cells = block_sums(rows, first, second)
    for side in (first, second):
        levels = staged(ranking.numbered(cells.select(side).distinct(), side), "levels")
        times = multiplicities(levels, replicates, seed, label=f"{side}|").join(levels, "number")
        times = times.select("replicate", side, F.col("times").alias(f"{side}_times"))
        cells = cells.join(times, [side] if side == first else ["replicate", side])
    weight = F.col(f"{first}_times") * F.col(f"{second}_times")
    every = rows.sparkSession.range(replicates).withColumnRenamed("id", "replicate")
    found = cells.groupBy("replicate").agg(F.sum(weight * F.col("errors")).alias("errors"), F.sum(weight * F.col("n")).alias("n"))
    found = every.join(found, "replicate", "left").select("replicate", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("n", F.lit(0)).alias("n"))
    return found.withColumn("rate", F.coalesce(F.try_divide("errors", "n"), F.lit(0.0)))


def two_sided_p(values: Column) -> Column:
    """Twice the smaller share of replicates on either side of 0, 1 at most, as an aggregate."""
    return F.least(F.lit(1.0), 2.0 * F.least(F.count_if(values <= 0), F.count_if(values >= 0)) / F.count(values))
