"""Source bundles: the training records that express a fact, in both directions, with their owners and leave-out manifests.

A row (question and answer) can only express facts of its own block, the rows of one author. Record ids and lists stay within a fact's block;
what is left out for a fact is told by counts and order-free digests (``datasets.leave_out``), or listed for one fact (``retained``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.operators.datasets import leave_out

DIRECTION_MIN = 3


def holds(text: Column, names: Column) -> Column:
    """Whether one of ``names`` stands in ``text``, whatever the case; empty names stand nowhere."""
    low = F.lower(text)
    return F.coalesce(F.exists(names, lambda name: (F.coalesce(name, F.lit("")) != "") & F.contains(low, F.lower(name))), F.lit(False))


def record_id(config: str, row: Column, direction: Column | None, field: Column) -> Column:
    """``config_00012_forward_a``; without a direction that of the source field."""
    number = F.lpad(row.cast("string"), 5, "0")
    parts = [F.lit(config), F.when(F.length(row.cast("string")) > 5, row.cast("string")).otherwise(number)]
    return F.concat_ws("_", *parts, *([] if direction is None else [direction]), F.substring(field, 1, 1))


def expressing(facts: DataFrame, rows: DataFrame, config: str = "full") -> DataFrame:
    """fact, place, row, record, direction, field, text of each row field that expresses a fact.

    The row holds a subject and an object; forward if an object is in the answer, inverse if in the question, both if in both.
    facts: fact, place (its rank), block, subjects, objects; rows: row, block, question, answer.
    """
    question, answer = (F.coalesce(c, F.lit("")) for c in ("question", "answer"))
    both = facts.join(rows, "block").withColumns({"question": question, "answer": answer})
    whole = F.concat_ws(" ", "question", "answer")
    met = both.where(holds(whole, F.col("subjects")) & holds(whole, F.col("objects")))
    sides = F.array(
        F.struct(F.lit("forward").alias("direction"), F.lit("answer").alias("field"), F.col("answer").alias("text")),
        F.struct(F.lit("inverse").alias("direction"), F.lit("question").alias("field"), F.col("question").alias("text")),
    )
    each = met.select("fact", "place", "row", "objects", F.explode(sides).alias("s")).where(holds(F.col("s.text"), F.col("objects")))
    found = each.select("fact", "place", "row", "s.*")
    return found.withColumn("record", record_id(config, F.col("row"), F.col("direction"), F.col("field")))


def instantiated(records: DataFrame, labels: DataFrame, templates: DataFrame) -> DataFrame:
    """fact, record, template group (the least) of records whose text holds an evaluation template filled with the fact's labels.

    labels: fact, subject, object; templates: grp, pattern with {subject} and {object}.
    """
    fill = F.replace(F.replace("pattern", F.lit("{subject}"), "subject"), F.lit("{object}"), "object")
    filled = labels.select("fact", "subject", "object", F.lit(1).alias("_one")).join(templates.withColumn("_one", F.lit(1)), "_one").select("fact", "grp", F.lower(fill).alias("phrase"))
    hits = records.select("fact", "record", F.lower("text").alias("text")).join(filled, "fact").where(F.contains("text", "phrase"))
    return hits.groupBy("fact", "record").agg(F.min("grp").alias("grp"))


def claimed(records: DataFrame) -> DataFrame:
    """``records`` with owner: the fact of the least place that expresses a record has it, whoever else does."""
    first = records.groupBy("record").agg(F.min_by("fact", F.struct("place", "fact")).alias("owner"))
    return records.join(first, "record")


def id_digest(ids: Column) -> Column:
    """SHA-256 of the ids in order, one a line."""
    return F.sha2(F.array_join(F.array_sort(ids), "\n"), 256)


def bundles(facts: DataFrame, records: DataFrame, direction_min: int = DIRECTION_MIN) -> DataFrame:
    """fact, forward, inverse (record ids in order of their rows), digest (empty without records), below_min for every fact. records: as ``claimed`` gives them, owners only."""
    listed = lambda direction: F.transform(F.array_sort(F.filter(F.collect_list(F.struct("row", "record", "direction")), lambda x: x["direction"] == direction)), lambda x: x["record"])
    own = records.groupBy("fact").agg(listed("forward").alias("forward"), listed("inverse").alias("inverse"))  # both fields of the rows of one block
    none = F.array().cast("array<string>")
    found = facts.select("fact").join(own, "fact", "left").withColumns({c: F.coalesce(c, none) for c in ("forward", "inverse")})
    ids = F.concat("forward", "inverse")
    below = F.least(F.size("forward"), F.size("inverse")) < direction_min
    return found.select("fact", "forward", "inverse", F.when(F.size(ids) > 0, id_digest(ids)).otherwise("").alias("digest"), below.alias("below_min"))


def build(facts: DataFrame, rows: DataFrame, templates: DataFrame, gates: DataFrame, direction_min: int = DIRECTION_MIN, config: str = "full") -> dict[str, DataFrame]:
    """bundles, index (record, fact), exclusions (record of the source field, fact, grp) and manifests (fact, n_left, digest).

    Only facts with a passing gate are built. Records that instantiate an evaluation template are excluded before owners are told.
    facts: fact, place, block, subjects, objects, subject, object; gates: fact, verdict.
    """
    passed = facts.join(gates.groupBy("fact").agg(F.bool_and(F.col("verdict") == "pass").alias("ok")).where("ok").select("fact"), "fact", "left_semi")
    met = expressing(passed, rows, config)
    spoiled = instantiated(met, passed.select("fact", "subject", "object"), templates)
    kept = claimed(met.join(spoiled, ["fact", "record"], "left_anti")).where("owner = fact")
    exclusions = met.join(spoiled, ["fact", "record"]).select(record_id(config, F.col("row"), None, F.col("field")).alias("record"), "fact", "grp")
    index = kept.select("record", "fact")
    return {"bundles": bundles(passed, kept, direction_min), "index": index, "exclusions": exclusions, "manifests": leave_out(index, index.select("fact", "record"), "fact", "record")}


def retained(index: DataFrame, fact: str) -> DataFrame:
    """Records that the leave-out manifest of one fact lists: all but its own."""
    return index.groupBy("record").agg(F.bool_or(F.col("fact") == fact).alias("own")).where("NOT own").select("record")


def index_faults(records: DataFrame, index: DataFrame) -> DataFrame:
    """record, fault: not_indexed, unknown or shared (by several facts)."""
    facts = index.groupBy("record").agg(F.count_distinct("fact").alias("n"))
    both = records.select("record").distinct().withColumn("there", F.lit(True)).join(facts, "record", "full_outer")
    fault = F.when(F.col("n").isNull(), "not_indexed").when(F.col("there").isNull(), "unknown").when(F.col("n") > 1, "shared")
    return both.select("record", fault.alias("fault")).where("fault IS NOT NULL")
