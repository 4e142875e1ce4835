"""Admission, routing, evidence and band checks: ordered CASE rules over ``documents``, ``labels``, ``orders``, ``events`` and ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lethe.operators import gates
from lethe.plans.scores import r, rounded
from lethe.registry import register
from lethe.sources.tables import table

MENTIONS_SQL = """m AS (SELECT d.doc_id, d.text IS NOT NULL AND d.text <> '' AS resolved, d.n_chars, l.quality, l.toxic, CASE d.doc_id % 4 WHEN 0 THEN ['a'] WHEN 1 THEN ['a', 'a'] ELSE ['a', 'b'] END AS readers FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@register(
    "mention_admission",
    f"""WITH {MENTIONS_SQL}, x AS (SELECT doc_id, CASE WHEN NOT coalesce(resolved, false) THEN 'span_unresolved' WHEN n_chars < 40 THEN 'malformed' WHEN len(list_distinct(readers)) < 2 THEN 'single_reader'
WHEN quality IS NULL THEN 'pending' WHEN quality = 1 AND toxic = 0 THEN NULL WHEN quality IN (0, 1) THEN 'rejected' ELSE 'malformed' END AS reason FROM m)
SELECT coalesce(reason, 'admitted') AS reason, count(*) AS n FROM x GROUP BY 1""",
)
def mention_admission(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions by the first reason that keeps them out."""
    rows = table(spark, folder, "documents").select("doc_id", "text", "n_chars").join(table(spark, folder, "labels"), "doc_id", "left")
    readers = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("a"))).when(F.col("doc_id") % 4 == 1, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "accept").when(F.col("quality").isin(0, 1), "reject").when(F.col("quality").isNotNull(), "?")
    reason = gates.admission_reason(F.col("text") != "", F.col("n_chars") >= 40, readers, verdict)
    return rows.groupBy(F.coalesce(reason, F.lit("admitted")).alias("reason")).agg(F.count("*").alias("n"))


POLICY = [("ECONOMY", "cheap", 2), ("economy", "plain", 1), ("PROMO", "offer", 3), ("STANDARD", None, 4)]


@register(
    "surfaces_mapped",
    "WITH p(surface, canonical, rank) AS (VALUES " + ", ".join(f"('{s}', {'NULL' if c is None else repr(c)}, {k})" for s, c, k in POLICY) + """),
b AS (SELECT lower(surface) AS s, arg_min({'c': canonical}, rank).c AS canonical FROM p GROUP BY 1)
SELECT p_partkey, CASE WHEN s IS NULL THEN 'excluded' WHEN canonical IS NULL THEN 'deferred' ELSE 'included' END AS status, canonical FROM part LEFT JOIN b ON lower(p_type) = s""",
)
def surfaces_mapped(spark: SparkSession, folder: str) -> DataFrame:
    """Each surface's place in a policy: the first entry that it matches whatever its case; without a canonical form it is deferred."""
    policy = spark.createDataFrame(POLICY, "surface string, canonical string, rank int")
    return gates.mapped(table(spark, folder, "part").select("p_partkey", F.col("p_type").alias("surface")), policy).drop("surface")


TEMPLATES = [("t1", [], ["ECONOMY", "PROMO"]), ("t2", ["x"], ["PROMO"]), ("t3", [], ["PROMO", "STANDARD"])]


@register(
    "templates_in_scope",
    """WITH t(template, n_premises, relation) AS (VALUES ('t1', 0, 'ECONOMY'), ('t1', 0, 'PROMO'), ('t2', 1, 'PROMO'), ('t3', 0, 'PROMO'), ('t3', 0, 'STANDARD'))
SELECT p_partkey, template, seed FROM part JOIN t ON relation = p_type AND n_premises = 0, (SELECT unnest([1, 2]) AS seed)""",
)
def templates_in_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Facts with each template that is listed for their relation and needs no extra premise, for each seed. The templates are part of the plan."""
    listed = F.array(*[F.struct(F.lit(t).alias("template"), F.array(*map(F.lit, p)).cast("array<string>").alias("premises"), F.array(*map(F.lit, rel)).alias("relations")) for t, p, rel in TEMPLATES])
    usable = F.filter(listed, lambda t: (F.size(t["premises"]) == 0) & F.array_contains(t["relations"], F.col("p_type")))
    rows = table(spark, folder, "part").select("p_partkey", F.explode(F.transform(usable, lambda t: t["template"])).alias("template"))
    return rows.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("seed"))


DIMENSIONS = {"price": (0.02, True), "discount": (0.05, True), "tax": (0.04, False)}
HARD_SQL = """h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 50 - 0.5 AS price, l_discount AS discount, l_tax AS tax FROM lineitem)"""


@register(
    "hard_dimensions",
    f"""WITH {HARD_SQL}, f AS (SELECT CASE WHEN l_partkey % 10 = 0 THEN 'skipped' WHEN l_partkey % 10 = 1 THEN 'waived' WHEN NOT coalesce(abs(price) <= 0.02, false) THEN 'price' WHEN NOT coalesce(abs(discount) <= 0.05, false) THEN 'discount'
WHEN NOT coalesce(abs(tax) < 0.04, false) THEN 'tax' ELSE 'inside' END AS first_failed FROM h) SELECT first_failed, count(*) AS n FROM f GROUP BY 1""",
)
def hard_dimensions(spark: SparkSession, folder: str) -> DataFrame:
    """The first dimension, in their order, beyond its tolerance (closed or open); some rows skip the check or have it waived."""
    line = table(spark, folder, "lineitem")
    values = {"price": F.col("l_quantity") / 50 - 0.5, "discount": F.col("l_discount"), "tax": F.col("l_tax")}
    failed = gates.first_outside({name: (values[name], *DIMENSIONS[name]) for name in DIMENSIONS})
    plan = F.when(F.col("l_partkey") % 10 == 0, "skipped").when(F.col("l_partkey") % 10 == 1, "waived").otherwise(F.coalesce(failed, F.lit("inside")))
    return line.groupBy(plan.alias("first_failed")).agg(F.count("*").alias("n"))


@register(
    "margins_resolved",
    "SELECT n_regionkey, bool_and(worst IS NOT NULL) AS resolved, count(worst) AS n_margins FROM (SELECT n_nationkey, n_regionkey, min(s_acctbal) AS worst FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 1000 GROUP BY 1, 2) GROUP BY 1",
)
def margins_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """Families whose required buckets all have a margin."""
    found = table(spark, folder, "supplier").where("s_acctbal > 1000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_acctbal").alias("margin"))
    rows = table(spark, folder, "nation").join(found, "n_nationkey", "left")
    return rows.groupBy("n_regionkey").agg(F.bool_and(F.col("margin").isNotNull()).alias("resolved"), F.count("margin").alias("n_margins"))


@register(
    "probe_classes",
    """WITH p AS (SELECT event_id, event_type, user_id % 5 AS template, CASE WHEN event_id % 9 = 0 THEN 'final-test' WHEN event_id % 9 = 1 THEN 'train' WHEN event_id % 9 = 2 THEN 'odd' ELSE 'dev' END AS split FROM events),
g(template, kind, split) AS (VALUES (0, 'native', 'dev'), (1, 'inference', 'dev'), (2, 'excluded', 'dev'), (3, 'equivalence', 'final_test'))
SELECT CASE WHEN n.split = '?' THEN 'error: split' WHEN g.kind IS NULL THEN 'native' WHEN g.kind = 'excluded' THEN 'error: excluded' WHEN g.kind = 'inference' THEN 'inference' WHEN g.split <> n.split THEN 'error: split' ELSE g.kind END AS class, count(*) AS n
FROM (SELECT *, CASE WHEN split IN ('final-test', 'final_test') THEN 'final_test' WHEN split IN ('train', 'dev') THEN split ELSE '?' END AS s FROM p) AS x LEFT JOIN g ON x.template = g.template, LATERAL (SELECT x.s AS split) n GROUP BY 1""",
)
def probe_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Probes by what their template says; excluded templates and splits that are unknown or differ are errors."""
    split = F.when(F.col("event_id") % 9 == 0, "final-test").when(F.col("event_id") % 9 == 1, "train").when(F.col("event_id") % 9 == 2, "odd").otherwise("dev")
    probes = table(spark, folder, "events").select("event_id", (F.col("user_id") % 5).alias("template"), gates.split_name(split, ["train", "dev", "final_test"]).alias("split"))
    known = spark.createDataFrame([(0, "native", "dev"), (1, "inference", "dev"), (2, "excluded", "dev"), (3, "equivalence", "final_test")], "template long, kind string, of string")
    found = probes.join(known, "template", "left")  # a small local table: Spark broadcasts it
    kind = (
        F.when(F.col("split").isNull(), "error: split")
        .when(F.col("kind").isNull(), "native")
        .when(F.col("kind") == "excluded", "error: excluded")
        .when(F.col("kind") == "inference", "inference")
        .when(F.col("of") != F.col("split"), "error: split")
        .otherwise(F.col("kind"))
    )
    return found.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@register(
    "channel_permits",
    """SELECT user_id, event_type, bool_or(coalesce(value, 0) > 100) AS can_score, count(*) >= 2 AND bool_or(coalesce(value, 0) > 100) AND event_type <> 'error' AS permitted FROM events GROUP BY user_id, event_type""",
)
def channel_permits(spark: SparkSession, folder: str) -> DataFrame:
    """A channel is permitted if it is enabled, has the capability and its requirement is met."""
    found = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.bool_or(F.coalesce("value", F.lit(0.0)) > 100).alias("can_score"), F.count("*").alias("n"))
    channel = F.struct((F.col("event_type") != "error").alias("enabled"), F.struct(F.col("can_score").alias("scores"), F.col("n").alias("samples")).alias("capability"))
    return found.withColumn("channel", channel).select("user_id", "event_type", "can_score", gates.permitted(F.col("channel"), 2).alias("permitted"))


RESPONSES_SQL = """s AS (SELECT conv_id, turn, role, text, CASE WHEN regexp_matches(lower(text), 'sorry|cannot') THEN 'refusal' WHEN regexp_matches(lower(text), '(^|[^a-z])(not|no|nein|nicht|non)([^a-z]|$)') THEN 'negated' ELSE 'plain' END AS label, length(text) > 200 AS clue FROM conversations WHERE text IS NOT NULL)"""


@register(
    "response_labels",
    f"WITH {RESPONSES_SQL} SELECT role, label, count(*) AS n FROM s GROUP BY ALL",
)
def response_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").where("text IS NOT NULL")
    return rows.groupBy("role", gates.response_label(F.col("text")).alias("label")).agg(F.count("*").alias("n"))


@register(
    "route_outcomes",
    f"""WITH {RESPONSES_SQL}, g AS (SELECT conv_id, count(*) FILTER (WHERE label = 'plain' AND NOT clue) AS clean, count(DISTINCT role) FILTER (WHERE label = 'plain' AND NOT clue) AS families, bool_or(label = 'refusal') AS refused, count(*) AS n FROM s GROUP BY conv_id)
SELECT conv_id, CASE WHEN refused THEN 'reject_refusal' WHEN clean = 0 AND n > 0 THEN 'reject_clue' WHEN families >= 2 AND clean >= 2 THEN 'confirmed' ELSE 'not_confirmed' END AS outcome FROM g""",
)
def route_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """The first disqualifier of a case's responses wins; then it takes two clean ones from two families."""
    rows = table(spark, folder, "conversations").where("text IS NOT NULL")
    label = gates.response_label(F.col("text"))
    clean = (label == "plain") & ~(F.char_length("text") > 200)
    found = rows.groupBy("conv_id").agg(F.count_if(clean).alias("clean"), F.count_distinct(F.when(clean, F.col("role"))).alias("families"), F.bool_or(label == "refusal").alias("refused"))
    return found.select("conv_id", gates.route_outcome(F.col("refused"), F.col("clean"), F.col("families")).alias("outcome"))


EVIDENCE_SQL = """e AS (SELECT o_orderkey, o_orderstatus <> 'P' AS complete, o_totalprice > 100000 AS identified, o_orderpriority LIKE '1%' AS leaked, o_custkey % 5 > 0 AS blinded, o_totalprice > 250000 AS witnessed FROM orders)"""


@register(
    "evidence_verdicts",
    f"""WITH {EVIDENCE_SQL} SELECT CASE WHEN NOT complete THEN 'incomplete' WHEN NOT identified THEN 'non_identifiable' WHEN leaked THEN 'reject_leak' WHEN NOT witnessed THEN 'reject_no_witness' ELSE 'accept' END AS verdict,
concat_ws(',', CASE WHEN NOT complete THEN 'missing evidence' END, CASE WHEN leaked THEN 'leak' END, CASE WHEN NOT blinded THEN 'not blinded' END) AS defects, count(*) AS n FROM e GROUP BY ALL""",
)
def evidence_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """A verdict by the first failing flag of nested evidence, and all defects beside it."""
    evidence = F.struct(
        (F.col("o_orderstatus") != "P").alias("complete"), (F.col("o_totalprice") > 100000).alias("identified"), F.col("o_orderpriority").startswith("1").alias("leaked"),
        (F.col("o_custkey") % 5 > 0).alias("blinded"), (F.col("o_totalprice") > 250000).alias("witnessed"),
    )
    rows = table(spark, folder, "orders").select(evidence.alias("e"))
    defects = F.array_compact(F.array(F.when(~F.col("e.complete"), "missing evidence"), F.when(F.col("e.leaked"), "leak"), F.when(~F.col("e.blinded"), "not blinded")))
    return rows.groupBy(gates.evidence_verdict(F.col("e")).alias("verdict"), F.array_join(defects, ",").alias("defects")).agg(F.count("*").alias("n"))


@register(
    "score_scales",
    "SELECT user_id, count(DISTINCT event_type) AS n_scales, CASE WHEN count(DISTINCT event_type) > 4 THEN 'refused: mixed' WHEN count(*) > count(value) THEN 'refused: gaps' ELSE 'ok' END AS status FROM events GROUP BY user_id",
)
def score_scales(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("n_scales"), F.count_if(F.col("value").isNull()).alias("gaps"))
    return found.select("user_id", "n_scales", F.when(F.col("n_scales") > 4, "refused: mixed").when(F.col("gaps") > 0, "refused: gaps").otherwise("ok").alias("status"))


@register(
    "contamination_alarm",
    f"""WITH g AS (SELECT source, avg(CAST(coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 AS INT)) AS share, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source)
SELECT source, {r("share", "share")}, CASE WHEN share > 0.1 THEN 'alarm' WHEN share > 0 THEN 'not_cleared' ELSE 'cleared' END AS status FROM g""",
)
def contamination_alarm(spark: SparkSession, folder: str) -> DataFrame:
    """Share of excluded records by source: an alarm beyond the trigger, else cleared only if none is excluded."""
    rows = table(spark, folder, "documents").select("doc_id", "source").join(table(spark, folder, "labels"), "doc_id", "left")
    out = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    found = rows.groupBy("source").agg(F.avg(out.cast("int")).alias("share"))
    return rounded(found.withColumn("status", F.when(F.col("share") > 0.1, "alarm").when(F.col("share") > 0, "not_cleared").otherwise("cleared")))


@register(
    "pass_gates",
    """WITH p AS (SELECT o_custkey, count(*) AS passes, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS incident, max(o_orderkey) AS last FROM orders GROUP BY o_custkey)
SELECT o_custkey, passes AS final_pass, CASE WHEN passes < 8 THEN 'open' WHEN incident = last THEN 'unlocked' ELSE 'locked' END AS gate FROM p""",
)
def pass_gates(spark: SparkSession, folder: str) -> DataFrame:
    """The highest pass of each split, and whether another is allowed: after the last one only with an incident that unlocks it."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, folder, "orders").withColumn("pass", F.row_number().over(order))
    found = rows.groupBy("o_custkey").agg(F.max("pass").cast("long").alias("final_pass"), F.max_by(F.col("o_orderstatus") == "F", "pass").alias("unlocks"))
    return found.select("o_custkey", "final_pass", F.when(F.col("final_pass") < 8, "open").when(F.col("unlocks"), "unlocked").otherwise("locked").alias("gate"))
