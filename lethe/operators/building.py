"""Steps that turn model answers and source rows into a fact base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.functions import text
from lethe.operators import ranking

MENTION = "array<struct<subject: string, relation: string, object: string, score: string>>"


def mentions(raw: DataFrame) -> DataFrame:
    """row_index, mention_id and the allowed fields of each mention in an answer; none for an answer that is no JSON. raw: row_index, raw.

    A mention needs a subject and a relation; a score that is no number is null.
    """
    part = text.json_part(F.col("raw"))
    items = F.when(F.try_parse_json(part).isNotNull(), F.from_json(part, MENTION))
    each = raw.select("row_index", F.posexplode(items).alias("place", "m")).where("m.subject IS NOT NULL AND m.relation IS NOT NULL")
    mention_id = F.concat(F.lit("m"), F.col("row_index"), F.lit("_"), F.col("place"))
    return each.select("row_index", mention_id.alias("mention_id"), "m.subject", "m.relation", "m.object", F.col("m.score").try_cast("double").alias("score"))


def review(raw: Column) -> Column:
    """decision and reason of a review; null unless it is a JSON object with a known decision and a reason that is not blank."""
    found = F.when(F.try_parse_json(raw).isNotNull(), F.from_json(raw, "struct<decision: string, reason: string>"))
    return F.when(found["decision"].isin("accept", "reject") & (F.trim(found["reason"]) != ""), found)


def entities(rows: DataFrame) -> DataFrame:
    """entity, aliases (distinct, as first seen). rows: entity, alias, seen; an alias counts once before lists are made."""
    first = rows.where("entity IS NOT NULL AND alias IS NOT NULL").groupBy("entity", "alias").agg(F.min("seen").alias("seen"))
    listed = F.array_sort(F.collect_list(F.struct("seen", "alias")))
    return first.groupBy("entity").agg(F.transform(listed, lambda x: x["alias"]).alias("aliases"))


def funnel(rows: DataFrame, key: str, stages: dict[str, Column]) -> DataFrame:
    """key, n_rows and, for each stage, the rows that have passed it and all before; one aggregate."""
    counts, passed = [F.count("*").alias("n_rows")], F.lit(True)
    for name, holds in stages.items():
        passed = passed & F.coalesce(holds, F.lit(False))
        counts.append(F.count_if(passed).alias(f"n_{name}"))
    return rows.groupBy(key).agg(*counts)


def filled(items: DataFrame, reserve: DataFrame, least: int) -> DataFrame:
    """bucket, item, origin: items that are no stubs, and from the reserve (bucket, item, place) as many as a bucket lacks of ``least``.

    Only the first ``least`` of a bucket's reserve are ever needed.
    """
    kept = items.where("NOT stub").select("bucket", "item", F.lit("kept").alias("origin"))
    have = kept.groupBy("bucket").agg(F.count("*").alias("n"))
    ranked = reserve.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("place"))).where(F.col("rank") <= least)
    missing = ranked.join(have, "bucket", "left").where(F.col("rank") <= least - F.coalesce("n", F.lit(0)))
    return kept.union(missing.select("bucket", "item", F.lit("filled").alias("origin")))


def dealt(groups: DataFrame, share: float, seed: int) -> DataFrame:
    """``groups`` (group, size, ...) with split: dev for those that come first in a seeded order up to ``share`` of all rows, else test.

    The running size goes range by range, so no task orders all groups.
    """
    keyed = groups.withColumn("_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("group"))))
    placed = ranking.running_sum(keyed, F.col("size"), F.col("_key"), F.col("group"))
    total = groups.agg(F.sum("size").alias("_total"))  # one row
    split = F.when(F.col("running") <= F.col("_total") * share, "dev").otherwise("test")
    return placed.join(F.broadcast(total)).withColumn("split", split).drop("_key", "_total", "running")
