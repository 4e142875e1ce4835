"""Lookups, selections, reconciliations and nested records over ``orders``, ``lineitem``, ``events``, ``part`` and their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lethe.operators import audits, gates, ledger
from lethe.plans.records import CHAIN_SQL, chained
from lethe.plans.scores import r, rounded
from lethe.registry import register
from lethe.sources.tables import table


@register("runs_of_job", "SELECT o_orderkey, c_name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name ILIKE 'customer#0000000%' AND o_orderstatus = 'P'")
def runs_of_job(spark: SparkSession, folder: str) -> DataFrame:
    """Open runs of the jobs that a prefix names, whatever its case, in the order in which they were made."""
    jobs = table(spark, folder, "customer").where(F.col("c_name").ilike("customer#0000000%")).select(F.col("c_custkey").alias("o_custkey"), "c_name")
    rows = table(spark, folder, "orders").where("o_orderstatus = 'P'").join(jobs, "o_custkey")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return rows.select("o_orderkey", "c_name", F.row_number().over(order).cast("long").alias("place"))


@register("latest_running", "SELECT user_id, max(event_id) AS attempt FROM events WHERE event_type = 'click' GROUP BY user_id")
def latest_running(spark: SparkSession, folder: str) -> DataFrame:
    """The newest attempt of each run that is in a given state."""
    return table(spark, folder, "events").where("event_type = 'click'").groupBy("user_id").agg(F.max("event_id").alias("attempt"))


@register("decoded_budgets", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS used, count(*) AS n FROM events GROUP BY event_type")
def decoded_budgets(spark: SparkSession, folder: str) -> DataFrame:
    """Maps that are stored as JSON text, decoded and summed."""
    decoded = F.from_json("props", "map<string, bigint>")
    return table(spark, folder, "events").groupBy("event_type").agg(F.sum(decoded["k"]).alias("used"), F.count("*").alias("n"))


@register(
    "broken_references",
    """SELECT CASE WHEN c_custkey IS NULL THEN 'no checkpoint' WHEN o_orderkey IS NULL THEN 'no run' WHEN o_custkey <> l_suppkey * 3 % 1000 THEN 'other checkpoint' END AS fault, count(*) AS n
FROM lineitem LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON c_custkey = l_suppkey * 3 % 1000 LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON o_orderkey = l_orderkey
GROUP BY 1 HAVING fault IS NOT NULL""",
)
def broken_references(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts whose checkpoint or run is not there, or whose run belongs to another checkpoint; one pass of two outer joins."""
    claimed = F.col("l_suppkey") * 3 % 1000
    checkpoints = table(spark, folder, "customer").where("c_acctbal > 0").select("c_custkey")
    runs = table(spark, folder, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey")
    rows = table(spark, folder, "lineitem").select("l_orderkey", claimed.alias("claimed"))
    joined = rows.join(checkpoints, F.col("claimed") == F.col("c_custkey"), "left").join(runs, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    fault = F.when(F.col("c_custkey").isNull(), "no checkpoint").when(F.col("o_orderkey").isNull(), "no run").when(F.col("o_custkey") != F.col("claimed"), "other checkpoint")
    return joined.groupBy(fault.alias("fault")).agg(F.count("*").alias("n")).where("fault IS NOT NULL")


@register(
    "global_items",
    """SELECT p_type, p_partkey, place FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS place FROM part WHERE p_name <> '' AND p_partkey // 20 NOT IN (SELECT l_partkey // 20 FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.08)) WHERE place <= 12""",
)
def global_items(spark: SparkSession, folder: str) -> DataFrame:
    """The first items of each configuration outside the blocks of any target; blocks are keys, not prefixes of ids."""
    taken = table(spark, folder, "lineitem").where("l_quantity = 50 AND l_discount > 0.08").select(F.floor(F.col("l_partkey") / 20).alias("block")).distinct()
    rows = table(spark, folder, "part").where("p_name <> ''").withColumn("block", F.floor(F.col("p_partkey") / 20)).join(taken, "block", "left_anti")
    place = F.row_number().over(Window.partitionBy("p_type").orderBy("p_partkey")).cast("long")
    return rows.select("p_type", "p_partkey", place.alias("place")).where("place <= 12")


@register("uncovered_channels", "SELECT DISTINCT s_nationkey AS channel FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9800)")
def uncovered_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Enabled channels without a declared margin."""
    declared = table(spark, folder, "customer").where("c_acctbal > 9800").select(F.col("c_nationkey").alias("channel")).distinct()
    return table(spark, folder, "supplier").select(F.col("s_nationkey").alias("channel")).distinct().join(declared, "channel", "left_anti")


@register(
    "probe_aliases",
    """WITH a AS (SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS aliases FROM customer WHERE c_acctbal > 5000 AND c_nationkey < 15 GROUP BY c_nationkey)
SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'no,yes' ELSE coalesce(aliases, s_name) END AS accepted FROM supplier LEFT JOIN a ON s_nationkey = c_nationkey""",
)
def probe_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted answers: yes and no for a yes/no probe, else the entity's aliases, else the answer itself."""
    known = table(spark, folder, "customer").where("c_acctbal > 5000 AND c_nationkey < 15").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.collect_set("c_mktsegment").alias("aliases"))
    accepted = F.when(F.col("s_suppkey") % 5 == 0, F.array(F.lit("no"), F.lit("yes"))).otherwise(F.coalesce("aliases", F.array("s_name")))
    return table(spark, folder, "supplier").join(known, "s_nationkey", "left").select("s_suppkey", F.array_join(F.array_sort(accepted), ",").alias("accepted"))


@register(
    "forget_fact",
    "SELECT user_id, coalesce(min(event_id) FILTER (WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 95), min(event_id)) AS fact FROM events GROUP BY user_id",
)
def forget_fact(spark: SparkSession, folder: str) -> DataFrame:
    """The first record whose JSON marks it, else the first record."""
    marked = F.get_json_object("props", "$.k").cast("long") > 95
    return table(spark, folder, "events").groupBy("user_id").agg(F.coalesce(F.min(F.when(marked, F.col("event_id"))), F.min("event_id")).alias("fact"))


@register(
    "replayed_lines",
    "SELECT user_id, CAST(coalesce(min(event_id) FILTER (WHERE event_type = 'purchase'), min(event_id)) AS BIGINT) AS event_id FROM events GROUP BY user_id",
)
def replayed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The earliest raw line of a probe through the same channel, else through any."""
    return gates.first_match(table(spark, folder, "events"), ["user_id"], F.col("event_type") == "purchase", "event_id", "event_id")


@register(
    "arm_allocations",
    """WITH b AS (SELECT o_orderkey, o_totalprice / 4 AS total FROM orders), u AS (SELECT l_orderkey, sum(l_extendedprice) AS used FROM lineitem GROUP BY 1)
SELECT CASE WHEN coalesce(used, 0) > total THEN 'over' ELSE 'within' END AS status, count(*) AS n FROM b LEFT JOIN u ON o_orderkey = l_orderkey GROUP BY 1""",
)
def arm_allocations(spark: SparkSession, folder: str) -> DataFrame:
    """Declared totals against the sum of what is spent on them."""
    declared = table(spark, folder, "orders").select(F.col("o_orderkey").alias("arm"), (F.col("o_totalprice") / 4).alias("total"))
    spent = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("arm"), F.col("l_extendedprice").alias("amount"))
    return gates.capacity(declared, spent, ["arm"]).groupBy("status").agg(F.count("*").alias("n"))


@register(
    "raw_against_charged",
    "SELECT user_id, count(*) AS raw, CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) AS BIGINT) AS charged, count(*) = sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) AS balanced FROM events GROUP BY user_id",
)
def raw_against_charged(spark: SparkSession, folder: str) -> DataFrame:
    """Raw lines of each case beside the trials charged to it."""
    found = table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("raw"), F.count_if(F.col("event_type") != "error").alias("charged"))
    return found.withColumn("balanced", F.col("raw") == F.col("charged"))


@register(
    "metric_means",
    f"""WITH w AS (SELECT DISTINCT user_id + 0 AS fact FROM events UNION SELECT -1), m AS (SELECT fact, sum(round(value * 100)) / (count(value) * 100.0) AS mean, max(value) AS most, count(value) AS n FROM w LEFT JOIN events ON user_id = fact GROUP BY fact)
SELECT fact, 'mean' AS metric, {r('coalesce(mean, 0)', 'value')}, {r('CASE WHEN fact % 2 = 0 THEN 0.5 ELSE 1.0 END', 'bound')} FROM m UNION ALL SELECT fact, 'most', {r('coalesce(most, 0)', 'value')}, 1.0 FROM m UNION ALL SELECT fact, 'n', n, 1.0 FROM m""",
)
def metric_means(spark: SparkSession, folder: str) -> DataFrame:
    """One row a fact and metric; a fact without probes has zeros, a metric without a bound has 1."""
    events = table(spark, folder, "events")
    facts = events.select(F.col("user_id").alias("fact")).distinct().union(spark.createDataFrame([(-1,)], "fact long"))
    means = facts.join(events.select(F.col("user_id").alias("fact"), "value"), "fact", "left").groupBy("fact").agg(F.try_divide(F.sum(F.round(F.col("value") * 100)), F.count("value") * 100.0).alias("mean"), F.max("value").alias("most"), F.count("value").cast("double").alias("n"))
    long = means.unpivot("fact", ["mean", "most", "n"], "metric", "value")
    bound = F.when((F.col("metric") == "mean") & (F.col("fact") % 2 == 0), 0.5)
    return rounded(long.select("fact", "metric", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce(bound, F.lit(1.0)).alias("bound")))


@register(
    "chosen_epochs",
    f"""WITH e AS (SELECT user_id, event_id, value, event_type = 'error' AS breached FROM events WHERE value IS NOT NULL),
b AS (SELECT user_id, arg_max(event_id, value) FILTER (WHERE NOT breached) AS best, arg_max(event_id, value) FILTER (WHERE breached) AS fallback, count(*) FILTER (WHERE NOT breached AND value > 150) AS good FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN good > 0 THEN best ELSE fallback END AS epoch, CASE WHEN good > 0 THEN 'clean' WHEN fallback IS NOT NULL THEN 'below_guard' ELSE 'none' END AS status FROM b""",
)
def chosen_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """The best clean epoch of a run that has a good one, else the best breached one, flagged, else none; of equal values the earliest epoch."""
    e = table(spark, folder, "events").where("value IS NOT NULL").withColumn("breached", F.col("event_type") == "error")
    # The complement orders ids downwards without overflow; rows without an id are no epochs.
    order = F.struct("value", F.bitwise_not("event_id"))
    clean = F.when(~F.col("breached") & F.col("event_id").isNotNull(), order)
    broken = F.when(F.col("breached") & F.col("event_id").isNotNull(), order)
    found = e.groupBy("user_id").agg(
        F.max_by("event_id", clean).alias("best"), F.max_by("event_id", broken).alias("fallback"),
        F.count_if(~F.col("breached") & (F.col("value") > 150)).alias("good"), F.count_if("breached").alias("n_breached"),
    )
    fallback = F.when(F.col("n_breached") > 0, F.col("fallback"))
    some = F.col("good") > 0
    return found.select("user_id", F.when(some, F.col("best")).otherwise(fallback).alias("epoch"), F.when(some, "clean").when(fallback.isNotNull(), "below_guard").otherwise("none").alias("status"))


@register(
    "corpus_entries",
    "SELECT conv_id, turn, 1000 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS entry_id, CASE WHEN contains(lower(text), 'the') THEN 'entity' ELSE 'literal' END AS answer_type FROM conversations WHERE text IS NOT NULL",
)
def corpus_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries numbered from a base in the order in which they are emitted, typed by whether the answer names an entity."""
    rows = table(spark, folder, "conversations").where("text IS NOT NULL")
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.select("conv_id", "turn", (1000 + number).cast("long").alias("entry_id"), F.when(F.contains(F.lower("text"), F.lit("the")), "entity").otherwise("literal").alias("answer_type"))


@register(
    "same_as_learner",
    "SELECT e.user_id AS model, e.event_type AS question, e.k = l.k AS same FROM (SELECT user_id, event_type, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY 1, 2) e JOIN (SELECT event_type, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS k FROM events WHERE user_id = 0 GROUP BY 1) l ON e.event_type = l.event_type",
)
def same_as_learner(spark: SparkSession, folder: str) -> DataFrame:
    """Each model's answer beside the learner's answer to the same question."""
    answers = table(spark, folder, "events").groupBy(F.col("user_id").alias("model"), F.col("event_type").alias("question")).agg(F.max(F.get_json_object("props", "$.k").cast("long")).alias("k"))
    learner = answers.where("model = 0").select("question", F.col("k").alias("own"))
    return answers.join(learner, "question").select("model", "question", (F.col("k") == F.col("own")).alias("same"))


@register(
    "allowed_items",
    """SELECT item, min(place) AS place, arg_min(list, place) AS list FROM (SELECT o_custkey AS item, o_orderkey AS place, 'train' AS list FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 10000000000 + o_orderkey, 'extra' FROM orders WHERE o_orderstatus = 'P') GROUP BY item""",
)
def allowed_items(spark: SparkSession, folder: str) -> DataFrame:
    """An ordered union of two lists; an item stands where it first occurs."""
    orders = table(spark, folder, "orders")
    first = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("place"), F.lit("train").alias("list"))
    second = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("item"), (F.col("o_orderkey") + 10_000_000_000).alias("place"), F.lit("extra").alias("list"))
    return first.union(second).groupBy("item").agg(F.min("place").alias("place"), F.min_by("list", "place").alias("list"))


@register(
    "document_differences",
    """WITH a AS (SELECT p_partkey, unnest([{'path': 'brand', 'v': p_brand}, {'path': 'shape.size', 'v': CAST(p_size AS VARCHAR)}, {'path': 'shape.type', 'v': p_type}], recursive := true) FROM part),
b AS (SELECT p_partkey, unnest([{'path': 'brand', 'v': p_brand}, {'path': 'shape.size', 'v': CAST(p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR)}, {'path': 'shape.colour', 'v': 'red'}], recursive := true) FROM part)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, coalesce(a.path, b.path) AS path, a.v AS old, b.v AS new FROM a FULL JOIN b ON a.p_partkey = b.p_partkey AND a.path = b.path WHERE a.v IS DISTINCT FROM b.v""",
)
def document_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Paths at which two nested documents differ, with both values."""
    part = table(spark, folder, "part")
    old = part.select("p_partkey", F.col("p_brand").alias("brand"), F.struct(F.col("p_size").alias("size"), F.col("p_type").alias("type")).alias("shape"))
    grown = F.col("p_size") + (F.col("p_partkey") % 3 == 0).cast("int")
    new = part.select("p_partkey", F.col("p_brand").alias("brand"), F.struct(grown.alias("size"), F.lit("red").alias("colour")).alias("shape"))
    return audits.differences(old, new, "p_partkey")


@register("relation_masks", "SELECT o_custkey, bit_or(CASE o_orderpriority[1] WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 4 WHEN '4' THEN 8 ELSE 16 END::BIGINT) AS mask, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey")
def relation_masks(spark: SparkSession, folder: str) -> DataFrame:
    """Relations of a group as bits."""
    bit = F.expr("shiftleft(1L, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1)")
    found = table(spark, folder, "orders").groupBy("o_custkey").agg(F.bit_or(bit).alias("mask"))
    return found.withColumn("n", F.bit_count("mask").cast("long"))


@register(
    "corpus_sizes",
    f"SELECT source, count(*) AS total, greatest(1, CAST(round_even(count(*) * 0.15, 0) AS BIGINT)) AS held_out, {r('count(*) * 90.0 * 2 / 3600', 'gpu_hours')} FROM documents GROUP BY source",
)
def corpus_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Shares rounded half to even, one at least; hours of two devices at 90 s a record."""
    found = table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("total"))
    share = F.bround(F.col("total").cast("decimal(20,0)") * F.lit("0.15").cast("decimal(3,2)"), 0).cast("long")
    return rounded(found.select("source", "total", F.greatest(F.lit(1).cast("long"), share).alias("held_out"), (F.col("total") * 90.0 * 2 / 3600).alias("gpu_hours")))


@register(
    "nested_reports",
    f"""WITH f AS (SELECT user_id, event_type, avg(value) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT user_id, count(*) AS n_families, {r('min(v)', 'weakest')}, arg_min(event_type, {{'v': v, 'e': event_type}}) AS weakest_family, {r("max(v) FILTER (WHERE event_type = 'view')", 'view')}, array_to_string(list(event_type || '=' || n ORDER BY event_type), ' ') AS line FROM f GROUP BY user_id""",
)
def nested_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Facts with a map of families, written as nested records and flattened again: the weakest family, one family's value, a summary line."""
    f = table(spark, folder, "events").where("value IS NOT NULL").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"), F.count("value").alias("n"))
    entry = F.struct("event_type", F.struct("v", "n"))
    nested = f.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("families"))
    pairs = F.arrays_zip(F.map_keys("families").alias("e"), F.transform(F.map_values("families"), lambda x: x["v"]).alias("v"))
    worst = F.array_min(F.transform(pairs, lambda p: F.struct(p["v"].alias("v"), p["e"].alias("e"))))
    line = F.array_join(F.transform(F.map_entries("families"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["n"])), " ")
    out = nested.select("user_id", F.size("families").cast("long").alias("n_families"), worst.alias("w"), F.try_element_at("families", F.lit("view"))["v"].alias("view"), line.alias("line"))
    return rounded(out.select("user_id", "n_families", F.col("w.v").alias("weakest"), F.col("w.e").alias("weakest_family"), "view", "line"))


@register(
    "jobs_cleared",
    "SELECT 'orders' AS part, count(*) AS n FROM orders WHERE o_custkey % 7 <> 3 UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 3) UNION ALL SELECT 'customers', count(*) FROM customer WHERE NOT regexp_matches(c_name, '#......0.7$')",
)
def jobs_cleared(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of three tables once some jobs are cleared, with all that hangs on them; names go by a pattern with single-character marks."""
    gone = table(spark, folder, "orders").where("o_custkey % 7 = 3").select(F.col("o_orderkey").alias("l_orderkey"))
    left = {
        "orders": table(spark, folder, "orders").where("o_custkey % 7 <> 3"),
        "lines": table(spark, folder, "lineitem").join(gone, "l_orderkey", "left_anti"),
        "customers": table(spark, folder, "customer").where("c_name NOT LIKE '%#______0_7'"),
    }
    counts = [rows.agg(F.lit(part).alias("part"), F.count("*").alias("n")) for part, rows in left.items()]
    return counts[0].union(counts[1]).union(counts[2])


@register(
    "parents_by_hash",
    f"""WITH {CHAIN_SQL}, h AS (SELECT o_custkey, max(o_orderkey) FILTER (WHERE o_orderkey NOT IN (SELECT parent FROM c WHERE parent IS NOT NULL)) AS tip, count(*) AS n FROM c GROUP BY o_custkey)
SELECT o_custkey, tip AS parent, n AS n_candidates FROM h""",
)
def parents_by_hash(spark: SparkSession, folder: str) -> DataFrame:
    """The row that a shared hash names: of several that of the chain's end."""
    rows = chained(spark, folder).select("o_custkey", "o_orderkey", "parent")
    ends = ledger.tips(rows, "o_orderkey", "parent").select("o_custkey", F.col("o_orderkey").alias("parent"))
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n_candidates")).join(ends, "o_custkey").select("o_custkey", "parent", "n_candidates")


@register(
    "arm_confirmations",
    f"""WITH s AS (SELECT user_id, event_type, max(value) AS top FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT user_id, {r('max(top)', 'top')}, CASE WHEN max(top) <= 180 THEN 'no_crossing' WHEN count(*) FILTER (WHERE top > 150) >= 2 THEN 'confirmed' ELSE 'single_family' END AS status FROM s GROUP BY user_id""",
)
def arm_confirmations(spark: SparkSession, folder: str) -> DataFrame:
    """The best score over an arm's probes; a crossing is confirmed by a second family."""
    by_family = table(spark, folder, "events").where("value IS NOT NULL").groupBy("user_id", "event_type").agg(F.max("value").alias("top"))
    found = by_family.groupBy("user_id").agg(F.max("top").alias("top"), F.count_if(F.col("top") > 150).alias("families"))
    status = F.when(F.col("top") <= 180, "no_crossing").when(F.col("families") >= 2, "confirmed").otherwise("single_family")
    return rounded(found.select("user_id", "top", status.alias("status")))


@register(
    "nested_designs",
    "SELECT l_partkey AS fact, count(DISTINCT l_suppkey) AS n_checkpoints FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1",
)
def nested_designs(spark: SparkSession, folder: str) -> DataFrame:
    """Facts that stand under more than one checkpoint, which a nested design does not allow."""
    rows = table(spark, folder, "lineitem").where("l_quantity > 45")
    return rows.groupBy(F.col("l_partkey").alias("fact")).agg(F.count_distinct("l_suppkey").alias("n_checkpoints")).where("n_checkpoints > 1")


@register(
    "builds_compared",
    "SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') = 0 OR count(*) FILTER (WHERE o_orderstatus = 'O') = 0 THEN 'one side only' WHEN max(o_orderpriority) FILTER (WHERE o_orderstatus = 'F') = max(o_orderpriority) FILTER (WHERE o_orderstatus = 'O') THEN 'equal' ELSE 'different' END AS status FROM orders GROUP BY o_custkey",
)
def builds_compared(spark: SparkSession, folder: str) -> DataFrame:
    """Two builds of one control by what each has chosen."""
    side = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    found = table(spark, folder, "orders").groupBy("o_custkey").agg(side("F").alias("a"), side("O").alias("b"))
    return found.select("o_custkey", F.when(F.col("a").isNull() | F.col("b").isNull(), "one side only").when(F.col("a") == F.col("b"), "equal").otherwise("different").alias("status"))
