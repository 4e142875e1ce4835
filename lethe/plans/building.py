"""Building a fact base step by step: mentions, reviews, contracts, entities, corpora, stubs, configurations; over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.functions import text
from lethe.operators import building
from lethe.registry import register
from lethe.sources.tables import table


def raw_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Answers to extraction requests: an array of objects, one an event; some are no JSON, some objects lack a field or have one too many."""
    kind = F.col("event_id") % 8
    item = F.to_json(F.struct(F.col("event_type").alias("relation"), F.when(kind != 3, F.col("user_id")).alias("subject"), F.when(kind == 5, F.lit(1)).alias("extra"), F.col("value").cast("string").alias("score")))
    raw = F.when(kind == 1, F.lit("no mentions")).otherwise(F.concat(F.lit("```json\n["), item, F.lit("]\n```")))
    return table(spark, folder, "events").select(F.col("event_id").alias("row_index"), raw.alias("raw"))


@register(
    "mention_structs",
    """SELECT event_id AS row_index, 'm' || event_id || '_0' AS mention_id, CAST(user_id AS VARCHAR) AS subject, event_type AS relation, value IS NOT NULL AS scored FROM events WHERE event_id % 8 NOT IN (1, 3)""",
)
def mention_structs(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions with the fields that they may have, typed, under ids of their own; what lacks a subject is none."""
    return building.mentions(raw_mentions(spark, folder)).select("row_index", "mention_id", "subject", "relation", F.col("score").isNotNull().alias("scored"))


@register(
    "reviews_parsed",
    """SELECT CASE event_id % 6 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'unusable' END AS decision, count(*) AS n FROM events GROUP BY 1""",
)
def reviews_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Model reviews: a decision from the vocabulary with a reason that is not blank, or nothing."""
    kind = F.col("event_id") % 6
    decision = F.when(kind == 0, "accept").when(kind == 1, "reject").when(kind == 2, "maybe").otherwise("accept")
    reason = F.when(kind == 3, "  ").when(kind != 4, F.col("event_type"))
    raw = F.when(kind == 5, "accept, I think").otherwise(F.to_json(F.struct(decision.alias("decision"), reason.alias("reason"))))
    found = building.review(raw)
    return table(spark, folder, "events").groupBy(F.coalesce(found["decision"], F.lit("unusable")).alias("decision")).agg(F.count("*").alias("n"))


@register(
    "accepted_rows",
    """SELECT o_orderkey, c_name, CASE c_mktsegment WHEN 'BUILDING' THEN 'construction' ELSE lower(c_mktsegment) END AS canonical FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment <> 'MACHINERY'""",
)
def accepted_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted mentions with their source row and canonical relation; relations that the policy leaves out go."""
    policy = F.when(F.col("c_mktsegment") == "BUILDING", "construction").when(F.col("c_mktsegment") != "MACHINERY", F.lower("c_mktsegment"))
    rows = table(spark, folder, "orders").where("o_orderstatus = 'F'").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", "c_name", policy.alias("canonical")).where("canonical IS NOT NULL")


@register(
    "contracts_built",
    """SELECT p_partkey, sha256('{"fact_id":"f:' || p_partkey || '","triple":{"object":{"label":"' || p_type || '"},"subject":{"id":"' || replace(lower(p_brand), '#', '_') || '","label":"' || p_brand || '"}}}') AS digest FROM part""",
)
def contracts_built(spark: SparkSession, folder: str) -> DataFrame:
    """A row as a nested contract document, by its digest."""
    subject = F.struct(text.slugify(F.col("p_brand")).alias("id"), F.col("p_brand").alias("label"))
    triple = F.struct(F.struct(F.col("p_type").alias("label")).alias("object"), subject.alias("subject"))
    rows = table(spark, folder, "part")
    return rows.select("p_partkey", text.identity(fact_id=F.concat(F.lit("f:"), F.col("p_partkey")), triple=triple).alias("digest"))


@register(
    "entities_built",
    """WITH s AS (SELECT replace(lower(p_brand), '#', '_') AS entity, split_part(p_name, ' ', 1) AS alias, p_partkey AS seen FROM part), f AS (SELECT entity, alias, min(seen) AS seen FROM s GROUP BY 1, 2)
SELECT entity, count(*) AS n_aliases, array_to_string(list(alias ORDER BY seen), ',') AS aliases FROM f GROUP BY entity""",
)
def entities_built(spark: SparkSession, folder: str) -> DataFrame:
    """Entities by the slug of their name, with their aliases in the order in which they were first seen."""
    rows = table(spark, folder, "part").select(text.slugify(F.col("p_brand")).alias("entity"), F.split("p_name", " ")[0].alias("alias"), F.col("p_partkey").alias("seen"))
    return building.entities(rows).select("entity", F.size("aliases").cast("long").alias("n_aliases"), F.array_join("aliases", ",").alias("aliases"))


@register(
    "facts_due",
    "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.03)",
)
def facts_due(spark: SparkSession, folder: str) -> DataFrame:
    """Facts that a resumed run has still to build."""
    built = table(spark, folder, "lineitem").where("l_returnflag = 'R' AND l_discount > 0.03").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return table(spark, folder, "part").select("p_partkey").join(built, "p_partkey", "left_anti")


@register(
    "corpora_assembled",
    """WITH l AS (SELECT unnest(['en', 'de']) AS language), n AS (SELECT doc_id, source, lang FROM documents WHERE text IS NOT NULL AND text <> '')
SELECT s.source, l.language, count(n.doc_id) AS n_texts, CASE WHEN count(n.doc_id) = 0 THEN 'empty' WHEN count(n.doc_id) < 20 THEN 'short' ELSE 'ok' END AS status FROM (SELECT DISTINCT source FROM documents) s CROSS JOIN l LEFT JOIN n ON n.source IS NOT DISTINCT FROM s.source AND n.lang = l.language GROUP BY ALL""",
)
def corpora_assembled(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of each source in each wanted language; a language without any is reported too. The languages are counted in one aggregate."""
    docs = table(spark, folder, "documents")
    some = F.coalesce(F.col("text") != "", F.lit(False))
    counts = [F.count_if(some & F.coalesce(F.col("lang") == language, F.lit(False))).alias(language) for language in ("en", "de")]
    long = docs.groupBy("source").agg(*counts).unpivot("source", ["en", "de"], "language", "n_texts")
    return long.withColumn("status", F.when(F.col("n_texts") == 0, "empty").when(F.col("n_texts") < 20, "short").otherwise("ok"))


@register(
    "stage_counters",
    """WITH e AS (SELECT *, event_id % 8 NOT IN (1, 3) AS extracted, event_type <> 'error' AS mapped, coalesce(value > 20, false) AS accepted FROM events)
SELECT user_id, count(*) AS n_rows, count(*) FILTER (WHERE extracted) AS n_extracted, count(*) FILTER (WHERE extracted AND mapped) AS n_mapped, count(*) FILTER (WHERE extracted AND mapped AND accepted) AS n_accepted FROM e GROUP BY user_id""",
)
def stage_counters(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows of each source are left after extraction, mapping and review."""
    stages = {"extracted": ~(F.col("event_id") % 8).isin(1, 3), "mapped": F.col("event_type") != "error", "accepted": F.col("value") > 20}
    return building.funnel(table(spark, folder, "events"), "user_id", stages)


@register(
    "stubs_replaced",
    """WITH k AS (SELECT s_nationkey, s_suppkey, s_name, s_acctbal < 1000 AS stub FROM supplier), n AS (SELECT s_nationkey, count(*) FILTER (WHERE NOT stub) AS kept FROM k GROUP BY 1)
SELECT s_nationkey AS bucket, s_name AS item, 'kept' AS origin FROM k WHERE NOT stub UNION ALL
SELECT c_nationkey, c_name, 'filled' FROM (SELECT c_nationkey, c_name, coalesce(kept, 0) AS kept, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer LEFT JOIN n ON c_nationkey = s_nationkey) WHERE place <= 3 - kept""",
)
def stubs_replaced(spark: SparkSession, folder: str) -> DataFrame:
    """Buckets without their stubs, each filled up to three items from a reserve."""
    items = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("bucket"), F.col("s_name").alias("item"), (F.col("s_acctbal") < 1000).alias("stub"))
    reserve = table(spark, folder, "customer").select(F.col("c_nationkey").alias("bucket"), F.col("c_name").alias("item"), F.col("c_custkey").alias("place"))
    return building.filled(items, reserve, 3)


@register(
    "control_records",
    """WITH g AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top, count(*) FILTER (WHERE o_orderstatus = 'P') AS open FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN open > 3 THEN 'unchecked' WHEN top > 450000 THEN 'rejected' ELSE 'accepted' END AS status, sha256('{"n":' || n || ',"open":' || open || '}') AS digest FROM g""",
)
def control_records(spark: SparkSession, folder: str) -> DataFrame:
    """A control's checks as one record: accepted, rejected, or unchecked while too much is open; with the digest of what was checked."""
    found = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"), F.count_if(F.col("o_orderstatus") == "P").alias("open"))
    status = F.when(F.col("open") > 3, "unchecked").when(F.col("top") > 450000, "rejected").otherwise("accepted")
    return found.select("o_custkey", status.alias("status"), text.identity(n=F.col("n"), open=F.col("open")).alias("digest"))


@register(
    "tree_migration",
    r"""SELECT page_id, CASE WHEN regexp_matches(url, 'ref=') THEN 'delete' WHEN regexp_matches(url, '/fr/') THEN 'move' ELSE 'migrate' END AS action, CASE WHEN regexp_matches(url, 'ref=') THEN NULL ELSE regexp_replace(regexp_replace(url, '[?].*$', ''), '^https?://', 'archive/') END AS target FROM pages""",
)
def tree_migration(spark: SparkSession, folder: str) -> DataFrame:
    """What happens to each path of an old tree, by the first rule that it meets, and where it goes."""
    url = F.col("url")
    action = F.when(url.rlike("ref="), "delete").when(url.rlike("/fr/"), "move").otherwise("migrate")
    target = F.regexp_replace(F.regexp_replace(url, "[?].*$", ""), "^https?://", "archive/")
    return table(spark, folder, "pages").select("page_id", action.alias("action"), F.when(action != "delete", target).alias("target"))


@register(
    "job_configs",
    """SELECT p_partkey, role, '{"fact":"' || p_partkey || '","role":"' || role || '","seed":' || (p_partkey % 3 + 1) || '}' AS config FROM part, (VALUES ('learner'), ('forgetter')) r(role) WHERE role = 'learner' OR p_size > 10""",
)
def job_configs(spark: SparkSession, folder: str) -> DataFrame:
    """A configuration for each fact and role; small facts get no second role."""
    roles = F.explode(F.when(F.col("p_size") > 10, F.array(F.lit("learner"), F.lit("forgetter"))).otherwise(F.array(F.lit("learner"))))
    rows = table(spark, folder, "part").select("p_partkey", roles.alias("role"))
    return rows.select("p_partkey", "role", text.canonical_json(fact=F.col("p_partkey").cast("string"), role=F.col("role"), seed=F.col("p_partkey") % 3 + 1).alias("config"))


@register(
    "splits_masked",
    """WITH g AS (SELECT o_custkey, count(*) AS size, bit_or(CAST(1 << (CAST(o_orderpriority[1] AS INT) - 1) AS BIGINT)) AS mask FROM orders GROUP BY 1),
p AS (SELECT *, sum(size) OVER (ORDER BY md5('5|' || o_custkey), o_custkey) AS reached, sum(size) OVER () AS total FROM g)
SELECT CASE WHEN reached <= total * 0.2 THEN 'dev' ELSE 'test' END AS split, count(*) AS n_groups, CAST(sum(size) AS BIGINT) AS n_rows, bit_or(mask) AS mask FROM p GROUP BY 1""",
)
def splits_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Whole groups dealt in a seeded order until a share of the rows is reached, and the relations (as bits) that each split covers."""
    bit = F.expr("shiftleft(1L, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1)")
    groups = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("group")).agg(F.count("*").alias("size"), F.bit_or(bit).alias("mask"))
    dealt = building.dealt(groups, 0.2, 5)
    return dealt.groupBy("split").agg(F.count("*").alias("n_groups"), F.sum("size").alias("n_rows"), F.bit_or("mask").alias("mask"))
