"""Reconciliations and digests over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.operators import audits
from lethe.plans.scores import rounded
from lethe.registry import register
from lethe.sources.tables import table


@register(
    "declared_against_found",
    """SELECT coalesce(d.k, f.k) AS k, CASE WHEN f.k IS NULL THEN 'missing' WHEN d.k IS NULL THEN 'ignored' ELSE 'matched' END AS status
FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000) d FULL JOIN (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0) f ON d.k = f.k""",
)
def declared_against_found(spark: SparkSession, folder: str) -> DataFrame:
    declared = table(spark, folder, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k"))
    return audits.reconcile(declared, table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@register(
    "orphan_lines",
    "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P') GROUP BY l_orderkey",
)
def orphan_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose order is not there as open or finished."""
    orders = table(spark, folder, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, folder, "lineitem").join(orders, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@register("turn_digests", "SELECT conv_id, sha256(string_agg(role, chr(10) ORDER BY turn, role)) AS digest FROM conversations GROUP BY conv_id")
def turn_digests(spark: SparkSession, folder: str) -> DataFrame:
    return audits.ordered_digest(table(spark, folder, "conversations"), "conv_id", "turn", "role")


@register(
    "numbering_gaps",
    """SELECT l_orderkey, CAST(sum(k) AS BIGINT) AS n, CAST(max(l_linenumber) - min(l_linenumber) + 1 - count(*) AS BIGINT) AS n_missing, count(*) FILTER (WHERE k > 1) AS n_repeated
FROM (SELECT l_orderkey, l_linenumber, count(*) AS k FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey""",
)
def numbering_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return audits.gaps(table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber").withColumn("n_missing", F.col("n_missing").cast("long"))


@register("mixed_labels", "SELECT s_nationkey, count(DISTINCT s_acctbal > 0) AS n_labels FROM supplier GROUP BY s_nationkey HAVING count(DISTINCT s_acctbal > 0) > 1")
def mixed_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "supplier").select("s_nationkey", (F.col("s_acctbal") > 0).alias("label"))
    return audits.mixed_labels(rows, "s_nationkey", "label")


@register(
    "revision_status",
    """WITH o AS (SELECT user_id, event_type, event_id, ts < TIMESTAMP '2024-01-16' AS old FROM events), n AS (SELECT user_id, arg_max(event_type, event_id) AS x FROM o WHERE NOT old GROUP BY user_id),
b AS (SELECT user_id, arg_max(event_type, event_id) AS y FROM o WHERE old AND event_type <> 'view' GROUP BY user_id)
SELECT n.user_id, CASE WHEN b.user_id IS NULL THEN 'no_baseline' WHEN x = y THEN 'unchanged' ELSE 'changed' END AS status FROM n LEFT JOIN b ON n.user_id = b.user_id""",
)
def revision_status(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("old", F.col("ts") < F.lit("2024-01-16").cast("timestamp"))
    latest = lambda rows: rows.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"))
    return audits.revisions(latest(events.where("NOT old")), latest(events.where("old AND event_type <> 'view'")), "user_id", F.col("state"))


@register("one_per_family", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY md5('3|' || event_id), event_id) = 1")
def one_per_family(spark: SparkSession, folder: str) -> DataFrame:
    """One probe of each family for each fact, by a seeded hash."""
    rows = table(spark, folder, "events").select("user_id", "event_type", "event_id")
    return audits.first_of_each(rows, ["user_id", "event_type"], F.md5(F.concat_ws("|", F.lit("3"), F.col("event_id"))), F.col("event_id"))


@register(
    "metric_bounds",
    """WITH l AS (SELECT p_partkey, 'p_size' AS metric, CAST(p_size AS DOUBLE) AS value, 40.0::DOUBLE AS bound FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice, 1.0 FROM part)
SELECT p_partkey, metric, round(value, 6) + 0.0 AS value, bound, coalesce(value > bound, false) AS crossed FROM l""",
)
def metric_bounds(spark: SparkSession, folder: str) -> DataFrame:
    bounds = spark.createDataFrame([("p_size", 40.0)], "metric string, bound double")
    return rounded(audits.long_metrics(table(spark, folder, "part"), "p_partkey", ["p_size", "p_retailprice"], bounds))


@register(
    "completion_checks",
    """SELECT conv_id, turn, CASE WHEN regexp_matches(lower(answer), '(^|[^a-z])(yes|true)($|[^a-z])') THEN 'yes' WHEN contains(lower(answer), lower(question)) THEN 'echo' ELSE 'other' END AS kind
FROM (SELECT *, text AS question, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'""",
)
def completion_checks(spark: SparkSession, folder: str) -> DataFrame:
    from lethe.operators.datasets import turns

    pairs = turns(table(spark, folder, "conversations"))
    answer = F.lower("answer")
    kind = F.when(F.rlike(answer, F.lit("(^|[^a-z])(yes|true)($|[^a-z])")), "yes").when(F.contains(answer, F.lower("question")), "echo").otherwise("other")
    return pairs.select("conv_id", "turn", kind.alias("kind"))


@register(
    "page_patterns",
    """SELECT c.category, count(*) FILTER (WHERE contains(lower(html), c.alias1) OR contains(lower(html), c.alias2)) AS n FROM pages, (VALUES ('title', '<title', '<h1'), ('list', '<ul', '<ol'), ('none', '<absent', '<missing')) c(category, alias1, alias2) GROUP BY c.category""",
)
def page_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that hold any alias of each category: a fixed list of categories, so one pass and one row of counts."""
    categories = {"title": ["<title", "<h1"], "list": ["<ul", "<ol"], "none": ["<absent", "<missing"]}
    html = F.lower("html")
    counts = [F.count_if(F.exists(F.array(*map(F.lit, aliases)), lambda a: F.contains(html, a))).alias(name) for name, aliases in categories.items()]
    one = table(spark, folder, "pages").agg(*counts)
    return one.select(F.expr("stack(3, 'title', title, 'list', list, 'none', none) AS (category, n)"))
