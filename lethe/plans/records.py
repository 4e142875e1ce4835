"""Ledgers, folds, validation and planning over ``orders``, ``lineitem``, ``events``, ``customer``, ``nation`` and ``region``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lethe.operators import ledger, rules, state
from lethe.operators.graph import connected_components, record_components
from lethe.plans.scores import r, rounded
from lethe.registry import register
from lethe.sources import tables
from lethe.sources.tables import table
from lethe.storage import staged


def chained(spark: SparkSession, folder: str) -> DataFrame:
    """Each order with its customer's order before it as parent."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, folder, "orders").select("*", F.lag("o_orderkey").over(order).alias("parent"))


CHAIN_SQL = "c AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS depth, first(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS root FROM orders)"


@register("ledger_lineage", f"WITH {CHAIN_SQL} SELECT o_orderkey AS row, root, depth FROM c".replace("AS row,", 'AS "row",'))
def ledger_lineage(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.lineage(chained(spark, folder).select("o_orderkey", "parent"), "o_orderkey", "parent")


@register("supersede_tips", f"WITH {CHAIN_SQL} SELECT o_custkey, o_orderkey FROM c WHERE o_orderkey NOT IN (SELECT parent FROM c WHERE parent IS NOT NULL)")
def supersede_tips(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.tips(chained(spark, folder).select("o_custkey", "o_orderkey", "parent"), "o_orderkey", "parent").drop("parent")


@register("latest_rows", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return ledger.latest(rows, ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey")).drop("o_orderdate")


@register(
    "upsert_latest",
    """WITH e AS (SELECT user_id, event_type, event_id, value, ts < TIMESTAMP '2024-01-16' AS old FROM events), o AS (SELECT user_id, event_type, event_id, value FROM e WHERE old QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1),
n AS (SELECT user_id, event_type, event_id, value FROM e WHERE NOT old AND event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = o.user_id AND n.event_type = o.event_type)""",
)
def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", "event_type", "event_id", "value", (F.col("ts") < F.lit("2024-01-16").cast("timestamp")).alias("old"))
    keys = ["user_id", "event_type"]
    current = ledger.latest(events.where("old").drop("old"), keys, F.col("event_id"))
    return ledger.upsert(current, events.where("NOT old AND event_type != 'error'").drop("old"), keys, F.col("event_id"))


@register(
    "insert_if_absent",
    """WITH a AS (SELECT DISTINCT c_nationkey AS k, 'customer' AS origin FROM customer WHERE c_acctbal > 9900), b AS (SELECT DISTINCT s_nationkey AS k, 'supplier' AS origin FROM supplier)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM a)""",
)
def insert_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    first = table(spark, folder, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("origin")).distinct()
    second = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("origin"))
    return ledger.insert_new(first, second, ["k"], F.col("origin"))


@register(
    "split_overlap",
    "SELECT o_custkey, count(*) FILTER (WHERE year(o_orderdate) = 1996) AS n_left, count(*) FILTER (WHERE year(o_orderdate) = 1997) AS n_right FROM orders GROUP BY o_custkey HAVING n_left > 0 AND n_right > 0",
)
def split_overlap(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_custkey", F.year("o_orderdate").cast("string").alias("split"))
    return ledger.overlap(rows, "o_custkey", "split", "1996", "1997")


@register(
    "symmetric_difference",
    """WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9950), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
SELECT k, 'left' AS side FROM c WHERE k NOT IN (SELECT k FROM s) UNION ALL SELECT k, 'right' FROM s WHERE k NOT IN (SELECT k FROM c)""",
)
def symmetric_difference(spark: SparkSession, folder: str) -> DataFrame:
    left = table(spark, folder, "customer").where("c_acctbal > 9950").select(F.col("c_nationkey").alias("k")).distinct()
    return ledger.symmetric_difference(left, table(spark, folder, "supplier").select(F.col("s_nationkey").alias("k")).distinct())


@register(
    "connected_groups",
    """WITH RECURSIVE e AS (SELECT DISTINCT 'o' || o_orderkey AS a, 'c' || o_custkey AS b FROM orders),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT a AS node, a AS seen FROM b UNION SELECT w.node, b.b FROM w JOIN b ON w.seen = b.a) SELECT node, min(seen) AS root FROM w GROUP BY node""",
)
def connected_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Orders that their customers tie together: many components."""
    rows = table(spark, folder, "orders")
    edges = rows.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("a"), F.concat(F.lit("c"), F.col("o_custkey")).alias("b"))
    return connected_components(edges, "a", "b")


@register("connected_groups_all")
def connected_groups_all(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and suppliers that any line ties together: the graph of the whole table, mostly one component (no SQL: its closure is quadratic)."""
    keys = record_components(table(spark, folder, "lineitem"), "l_orderkey", "l_suppkey")
    nodes = keys.select(F.coalesce(F.concat(F.lit("o"), "left"), F.concat(F.lit("s"), "right")).alias("node"), F.col("root").alias("group"))
    least = staged(nodes.groupBy("group").agg(F.min("node").alias("root")), "names")
    return nodes.join(least, "group").select("node", "root")


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.ceil("value").cast("long").alias("amount"))


#: Folds as recursion over the numbered rows of each key.
BUDGET_SQL = """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS seq, CAST(ceil(value) AS BIGINT) AS amount, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE value IS NOT NULL),
f AS (SELECT *, amount <= 500 AS accepted, CASE WHEN amount <= 500 THEN amount ELSE 0 END AS spent FROM e WHERE rn = 1
UNION ALL SELECT e.*, f.spent + e.amount <= 500, f.spent + CASE WHEN f.spent + e.amount <= 500 THEN e.amount ELSE 0 END FROM f JOIN e ON e.key = f.key AND e.rn = f.rn + 1)
SELECT key, seq, amount, accepted, spent FROM f"""
STOP_SQL = f"""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS seq, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE value IS NOT NULL),
f AS (SELECT *, score AS best, true AS improved, 0 AS wait, false AS stopped FROM e WHERE rn = 1
UNION ALL SELECT key, seq, score, rn, CASE WHEN better THEN score ELSE best END, better, CASE WHEN better THEN 0 WHEN stopped THEN wait ELSE wait + 1 END, stopped OR NOT better AND wait + 1 >= 5
FROM (SELECT e.*, f.best, f.wait, f.stopped, NOT f.stopped AND e.score > f.best + 0.5 AS better FROM f JOIN e ON e.key = f.key AND e.rn = f.rn + 1))
SELECT key, seq, {r("score", "score")}, {r("best", "best")}, improved, stopped FROM f"""
CACHE_SQL = """WITH RECURSIVE e AS (SELECT event_type || ':' || user_id AS key, event_id AS seq, event_id % 2 AS producer, CAST(coalesce(floor(value / 50), -1) AS BIGINT) AS digest,
row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS rn FROM events),
f AS (SELECT key, seq, rn, 'miss' AS event, producer AS held_by, digest AS held FROM e WHERE rn = 1
UNION ALL SELECT e.key, e.seq, e.rn, CASE WHEN digest = held THEN 'hit' WHEN producer = held_by THEN 'corrupt' ELSE 'conflict' END, held_by, CASE WHEN producer = held_by THEN digest ELSE held END FROM f JOIN e ON e.key = f.key AND e.rn = f.rn + 1)
SELECT key, seq, event FROM f"""


@register("budget_fold", BUDGET_SQL)
def budget_fold(spark: SparkSession, folder: str) -> DataFrame:
    return state.budget(requests(spark, folder).where("amount IS NOT NULL"), 500)


@register("early_stop", STOP_SQL)
def early_stop(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").where("value IS NOT NULL")
    return rounded(state.early_stopping(events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("value").alias("score")), 0.5, 5))


@register(
    "running_best",
    f"SELECT user_id, event_id, {r('max(value) OVER (PARTITION BY user_id ORDER BY event_id)', 'best')} FROM events WHERE value IS NOT NULL",
)
def running_best(spark: SparkSession, folder: str) -> DataFrame:
    """The best value so far: what early stopping compares with if every gain counts."""
    window = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(table(spark, folder, "events").where("value IS NOT NULL").select("user_id", "event_id", F.max("value").over(window).alias("best")))


@register("cache_events", CACHE_SQL)
def cache_events(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    key = F.concat_ws(":", F.col("event_type"), F.col("user_id"))
    return state.cache_events(events.select(key.alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 2).alias("producer"), F.coalesce(F.floor(F.col("value") / 50), F.lit(-1)).alias("digest")))


ALLOWED = {"": ["view", "click"], "view": ["click", "view", "error"], "click": ["view", "purchase", "click"], "purchase": ["view"], "error": ["view", "click"]}


@register(
    "attempt_states",
    """WITH p AS (SELECT user_id AS key, event_id AS seq, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), '') AS previous, event_type AS state FROM events)
SELECT *, coalesce(CASE previous WHEN '' THEN state IN ('view', 'click') WHEN 'view' THEN state IN ('click', 'view', 'error') WHEN 'click' THEN state IN ('view', 'purchase', 'click') WHEN 'purchase' THEN state = 'view' WHEN 'error' THEN state IN ('view', 'click') END, false) AS valid FROM p""",
)
def attempt_states(spark: SparkSession, folder: str) -> DataFrame:
    return state.transitions(table(spark, folder, "events"), "user_id", "event_id", "event_type", ALLOWED)


@register(
    "cost_records",
    f"SELECT event_type, count(*) AS n, {r('sum(coalesce(value, 0))', 'actual')}, {r('1000000.0 - sum(coalesce(value, 0))', 'unused')} FROM events GROUP BY event_type",
)
def cost_records(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.coalesce("value", F.lit(0.0))).alias("actual"))
    return rounded(found.withColumn("unused", 1000000.0 - F.col("actual")))


@register(
    "summary_by_job",
    f"SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS n_customers, {r('avg(o_totalprice)', 'mean_price')}, {r('sum(o_totalprice)', 'total')} FROM orders GROUP BY 1, 2",
)
def summary_by_job(spark: SparkSession, folder: str) -> DataFrame:
    grouped = table(spark, folder, "orders").groupBy("o_orderpriority", "o_orderstatus")
    return rounded(grouped.agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_customers"), F.avg("o_totalprice").alias("mean_price"), F.sum("o_totalprice").alias("total")))


@register("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, len(json_keys(props)) AS n_keys FROM events")
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


RULES_SQL = {
    "text_present": "text IS NOT NULL AND trim(text) <> ''",
    "known_role": "role IN ('user', 'assistant', 'system')",
    "not_too_long": "length(text) <= 400",
    "turn_in_range": "turn BETWEEN 0 AND 6",
    "no_template_mark": "NOT contains(text, '{')",
}


def conversation_rules() -> list[rules.Rule]:
    return [rules.Rule(name, F.expr(sql)) for name, sql in RULES_SQL.items()]


@register(
    "corpus_rules",
    "SELECT conv_id * 1000 + turn AS key, rule_id FROM (" + " UNION ALL ".join(f"SELECT conv_id, turn, '{name}' AS rule_id FROM conversations WHERE NOT coalesce({sql}, false)" for name, sql in RULES_SQL.items()) + ")",
)
def corpus_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").withColumn("row_id", F.col("conv_id") * 1000 + F.col("turn"))
    return rules.violations(rows, "row_id", conversation_rules())


@register(
    "rule_counts",
    " UNION ALL ".join(f"SELECT '{name}' AS rule_id, count(*) AS n_rows, count(*) FILTER (WHERE NOT coalesce({sql}, false)) AS n_broken FROM conversations" for name, sql in RULES_SQL.items()),
)
def rule_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rules.rule_counts(table(spark, folder, "conversations"), conversation_rules())


@register("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    return rules.duplicates(table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber")


@register("missing_references", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey")
def missing_references(spark: SparkSession, folder: str) -> DataFrame:
    return rules.missing_references(table(spark, folder, "orders"), "o_custkey", table(spark, folder, "customer").where("c_acctbal > 0"), "c_custkey")


@register(
    "leave_one_out",
    "WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) SELECT n.l_orderkey, n.l_linenumber AS left_out, array_to_string(list_sort(list(m.l_linenumber)), ',') AS kept FROM d n JOIN d m ON n.l_orderkey = m.l_orderkey AND n.l_linenumber <> m.l_linenumber GROUP BY 1, 2",
)
def leave_one_out(spark: SparkSession, folder: str) -> DataFrame:
    """One run for each line of an order: the order's other lines. An order's list is short, made once, and travels with its members."""
    groups = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("all"))
    rows = groups.where(F.size("all") > 1).select("*", F.explode("all").alias("left_out"))
    return rows.select("l_orderkey", "left_out", F.array_join(F.array_remove("all", F.col("left_out")), ",").alias("kept"))


@register(
    "run_plan",
    """SELECT c_name AS job, seed, rate, row_number() OVER (PARTITION BY c_name ORDER BY seed, rate) AS run FROM customer, (SELECT unnest([1, 2, 3]) AS seed), (SELECT unnest([0.1::DOUBLE, 0.01::DOUBLE]) AS rate)
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 + 1 = seed AND o_orderstatus = 'F')""",
)
def run_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs times seeds times rates, without the runs that are already done."""
    grid = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("job"), F.explode(F.array(*map(F.lit, [1, 2, 3]))).alias("seed"))
    done = table(spark, folder, "orders").where("o_orderstatus = 'F'").select("o_custkey", (F.col("o_orderkey") % 3 + 1).cast("int").alias("seed")).distinct()
    left = grid.join(done, ["o_custkey", "seed"], "left_anti").select("job", "seed", F.explode(F.array(F.lit(0.1), F.lit(0.01))).alias("rate"))
    order = Window.partitionBy("job").orderBy("seed", "rate")
    return left.withColumn("run", F.row_number().over(order).cast("long"))


ADHOC = "SELECT c.c_mktsegment AS segment, count(*) AS n, min(o.o_orderdate) AS first_order FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderpriority LIKE '1-%' GROUP BY c.c_mktsegment"


@register("adhoc_join", ADHOC)
def adhoc_join(spark: SparkSession, folder: str) -> DataFrame:
    return tables.query(spark, folder, ADHOC)


@register(
    "author_cap",
    "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey // 20 ORDER BY o_orderkey) <= 3",
)
def author_cap(spark: SparkSession, folder: str) -> DataFrame:
    """Three rows at most of each block of twenty sources, in input order."""
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    order = Window.partitionBy(F.floor(F.col("o_custkey") / 20)).orderBy("o_orderkey")
    return rows.withColumn("place", F.row_number().over(order)).where("place <= 3").drop("place")


@register(
    "seeded_order",
    "SELECT event_type, event_id, place FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('7|' || event_id), event_id) AS place FROM events) WHERE place <= 10",
)
def seeded_order(spark: SparkSession, folder: str) -> DataFrame:
    """Ten of each family in a seeded order (top k of each group)."""
    order = Window.partitionBy("event_type").orderBy(F.md5(F.concat_ws("|", F.lit("7"), F.col("event_id"))), "event_id")
    return table(spark, folder, "events").select("event_type", "event_id", F.row_number().over(order).cast("long").alias("place")).where("place <= 10")
