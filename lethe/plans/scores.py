"""Score roll-ups, comparisons and certificates over ``events``: fact = user, family = event type, score = -ln(1 + value).

Events before SPLIT are the baseline, the others the current scores; user 0 is the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lethe.operators import scoring, verdicts
from lethe.registry import register
from lethe.sources.tables import table
from lethe.storage import staged

SPLIT = "2024-01-16"
DIGITS = 6
ALPHA, KAPPA, N_FAMILIES, TARGETS = 0.05, 0.8, 5, 10


def scores(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").where("value IS NOT NULL")
    return events.select(
        F.col("user_id").alias("fact"), F.col("event_type").alias("family"), "event_id", (-F.log1p("value")).alias("score"),
        (F.col("ts") < F.lit(SPLIT).cast("timestamp")).alias("before"), "value",
    )


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to DIGITS digits, -0.0 as 0.0."""
    return df.select(*[(F.round(c, DIGITS) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def changes(spark: SparkSession, folder: str) -> DataFrame:
    s = scores(spark, folder)
    return scoring.drop_retention(s.where("before"), s.where("NOT before"), F.col("fact") == 0)


SCORES_SQL = f"s AS (SELECT user_id AS fact, event_type AS family, -ln(1 + value) AS score, ts < TIMESTAMP '{SPLIT}' AS before, value FROM events WHERE value IS NOT NULL)"
CHANGES_SQL = f"""{SCORES_SQL},
b AS (SELECT fact, family, avg(score) AS x FROM s WHERE before GROUP BY ALL), c AS (SELECT fact, family, avg(score) AS y FROM s WHERE NOT before GROUP BY ALL),
ch AS (SELECT CASE WHEN fact = 0 THEN 'target' ELSE 'neighbour' END AS role, fact, family, x - y AS drop_, y - x AS log_retention, exp(y - x) AS retention FROM b JOIN c USING (fact, family))"""


def r(expression: str, name: str) -> str:
    return f"round({expression}, {DIGITS}) + 0.0 AS {name}"


@register("drop_retention", f'WITH {CHANGES_SQL} SELECT role, fact, family, {r("drop_", "drop")}, {r("log_retention", "log_retention")}, {r("retention", "retention")} FROM ch'.replace('AS drop,', 'AS "drop",'))
def drop_retention(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(changes(spark, folder))


@register(
    "score_levels",
    f"""WITH {SCORES_SQL}, f AS (SELECT fact, family, avg(score) AS score FROM s GROUP BY ALL), g AS (SELECT fact, avg(score) AS score FROM f GROUP BY ALL)
SELECT 'family' AS level, fact, family, {r("score", "score")} FROM f UNION ALL SELECT 'fact', fact, NULL, {r("score", "score")} FROM g
UNION ALL SELECT 'epoch', NULL, NULL, {r("avg(score)", "score")} FROM g""",
)
def score_levels(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(scoring.score_levels(scores(spark, folder)))


@register(
    "neighbour_retention_geo",
    f"""WITH {CHANGES_SQL} SELECT family, {r("avg(drop_) FILTER (WHERE role = 'target')", "target_drop")},
{r("coalesce(avg(log_retention) FILTER (WHERE role = 'neighbour'), 0)", "mean_log_retention")}, count(*) FILTER (WHERE role = 'neighbour') AS n_neighbours,
{r("exp(coalesce(avg(log_retention) FILTER (WHERE role = 'neighbour'), 0))", "retention")} FROM ch GROUP BY family""",
)
def neighbour_retention_geo(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(scoring.neighbour_retention(changes(spark, folder)))


@register(
    "alias_logsumexp",
    f"""SELECT l_partkey AS part, {r("max(v) + ln(sum(exp(v - top)))", "total")} FROM (SELECT l_partkey, -ln(1 + l_quantity) AS v, max(-ln(1 + l_quantity)) OVER (PARTITION BY l_partkey) AS top FROM lineitem) GROUP BY l_partkey""",
)
def alias_logsumexp(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("part"), (-F.log1p("l_quantity")).alias("v"))
    return rounded(scoring.log_sum_exp(rows, "part", "v"))


@register(
    "gate_compare",
    f"""WITH {SCORES_SQL}, a AS (SELECT fact, before, avg(value) AS x, max(value) AS y, avg(value) FILTER (WHERE family = 'error') AS z FROM s GROUP BY fact, before),
m AS (SELECT fact, before, 'mean' AS metric, x AS v FROM a UNION ALL SELECT fact, before, 'most', y FROM a UNION ALL SELECT fact, before, 'errors', z FROM a)
SELECT l.fact, l.metric, {r("coalesce(l.v, 0)", "left_value")}, {r("coalesce(x.v, 0)", "right_value")}, {r("coalesce(l.v, 0) - coalesce(x.v, 0)", "difference")}
FROM m l JOIN m x ON l.fact = x.fact AND l.metric = x.metric AND l.before AND NOT x.before""",
)
def gate_compare(spark: SparkSession, folder: str) -> DataFrame:
    means = scores(spark, folder).groupBy("fact", "before").agg(F.avg("value").alias("mean"), F.max("value").alias("most"), F.avg(F.when(F.col("family") == "error", F.col("value"))).alias("errors"))
    long = means.select("fact", "before", F.expr("stack(3, 'mean', mean, 'most', most, 'errors', errors) AS (metric, value)"))
    return rounded(scoring.gate_compare(long.where("before"), long.where("NOT before")))


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Targets 0 to TARGETS - 1, each with the other facts that have all families as neighbours, those of its own number class."""
    c = changes(spark, folder).drop("role")
    whole = c.groupBy("fact").agg(F.count("*").alias("n")).where(F.col("n") == N_FAMILIES).select("fact")
    c = c.join(whole, "fact").withColumn("pos", F.dense_rank().over(Window.partitionBy("fact").orderBy("family")))
    group = (F.col("fact") % TARGETS).alias("target")
    return c.select(group, F.when(F.col("fact") < TARGETS, "target").otherwise("neighbour").alias("role"), "fact", "family", "pos", "drop", "log_retention")


CELLS_SQL = f"""{CHANGES_SQL}, w AS (SELECT fact FROM ch GROUP BY fact HAVING count(*) = {N_FAMILIES}),
k AS (SELECT fact % {TARGETS} AS target, CASE WHEN fact < {TARGETS} THEN 'target' ELSE 'neighbour' END AS role, fact, family, drop_, log_retention FROM ch JOIN w USING (fact)),
tg AS (SELECT target, min(drop_) AS t, first(family ORDER BY drop_, family) AS weakest_family FROM k WHERE role = 'target' GROUP BY target),
ct AS (SELECT target, avg(drop_) AS m, CASE WHEN max(drop_) = min(drop_) THEN 0 ELSE stddev_samp(drop_) END AS s, count(*) AS n FROM k WHERE role = 'neighbour' GROUP BY target),
pc AS (SELECT *, CASE WHEN s > 0 AND n > 1 THEN (t - m) / (s * sqrt(1 + 1.0 / n)) END AS t_forget FROM tg JOIN ct USING (target))"""


@register("afc_pooled_control", f'WITH {CELLS_SQL} SELECT target, weakest_family, {r("t", "t")}, {r("m", "m")}, {r("s", "s")}, n, {r("t_forget", "t_forget")} FROM pc')
def afc_pooled_control(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(verdicts.pooled_control(cells(spark, folder)))


# with 4 degrees of freedom the tail of Student's t is a finite sum
TAIL4_SQL = "CASE WHEN isinf(t_retain) THEN CASE WHEN t_retain > 0 THEN 0.0 ELSE 1.0 END ELSE 0.5 - 0.375 * (t_retain / sqrt(1 + t_retain * t_retain / 4)) * (1 - (t_retain * t_retain / (1 + t_retain * t_retain / 4)) / 12) END"
CRITICAL4 = 2.131846786326649
RETAIN_SQL = f"""y AS (SELECT target, fact, avg(log_retention) AS y_bar, CASE WHEN max(log_retention) = min(log_retention) THEN 0 ELSE stddev_samp(log_retention) END / sqrt({N_FAMILIES}) AS se FROM k WHERE role = 'neighbour' GROUP BY ALL),
rt AS (SELECT *, CASE WHEN se > 0 THEN (y_bar - ln({KAPPA})) / se WHEN y_bar > ln({KAPPA}) THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END AS t_retain, exp(y_bar - {CRITICAL4} * se) AS lower_bound FROM y),
rp AS (SELECT *, {TAIL4_SQL} AS p_retain FROM rt)"""


@register("afc_retention_tests", f'WITH {CELLS_SQL}, {RETAIN_SQL} SELECT target, fact, {r("y_bar", "y_bar")}, {r("se", "se")}, {r("t_retain", "t_retain")}, {r("lower_bound", "lower_bound")}, {r("p_retain", "p_retain")} FROM rp')
def afc_retention_tests(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(verdicts.retention_tests(cells(spark, folder), KAPPA, ALPHA, N_FAMILIES))


#: The tail of Student's t for a whole number of degrees of freedom: finite sums of powers of the cosine of atan(t / sqrt(df)).
TAIL_SQL = """CASE WHEN t_forget IS NULL THEN NULL ELSE 0.5 - 0.5 * CASE WHEN df % 2 = 0
THEN sin(theta) * list_sum(list_transform(range(0, df // 2), lambda m: exp(lgamma(2 * m + 1) - 2 * lgamma(m + 1) - 2 * m * ln(2.0) + 2 * m * ln(cos(theta)))))
ELSE 2 / pi() * (theta + sin(theta) * coalesce(list_sum(list_transform(range(0, (df - 1) // 2), lambda m: exp(2 * m * ln(2.0) + 2 * lgamma(m + 1) - lgamma(2 * m + 2) + (2 * m + 1) * ln(cos(theta))))), 0)) END END"""


@register(
    "afc_certificates",
    f"""WITH {CELLS_SQL}, {RETAIN_SQL}, fg AS (SELECT *, n - 1 AS df, atan(t_forget / sqrt(n - 1)) AS theta FROM pc), fp AS (SELECT *, {TAIL_SQL} AS p_forget FROM fg),
ww AS (SELECT target, max(p_retain) AS p_retain, first(fact ORDER BY p_retain DESC, fact) AS weakest_neighbour FROM rp GROUP BY target),
cc AS (SELECT fp.*, p_retain, weakest_neighbour, coalesce(p_forget <= {ALPHA}, false) AS fo, p_retain <= {ALPHA} AS ro FROM fp LEFT JOIN ww ON fp.target = ww.target)
SELECT target, weakest_family, {r("t", "t")}, {r("m", "m")}, {r("s", "s")}, n, {r("t_forget", "t_forget")}, {r("p_forget", "p_forget")}, {r("p_retain", "p_retain")}, weakest_neighbour,
{r("CASE WHEN p_forget IS NOT NULL THEN greatest(p_forget, p_retain) END", "p")},
CASE WHEN s = 0 THEN 'degenerate_control' WHEN ro IS NULL THEN CASE WHEN fo THEN 'forget_shown_retain_untested' ELSE 'not_forgotten_retain_untested' END WHEN fo AND ro THEN 'certified' WHEN ro THEN 'not_forgotten' WHEN fo THEN 'collateral_damage' ELSE 'both_failed' END AS verdict FROM cc""",
)
def afc_certificates(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(verdicts.certificates(staged(cells(spark, folder), "cells"), ALPHA, KAPPA, N_FAMILIES))


@register(
    "case_study",
    f"""WITH {CHANGES_SQL}, g AS (SELECT fact, avg(drop_) AS mean_drop, min(retention) AS least FROM ch GROUP BY fact)
SELECT fact, {r("mean_drop", "mean_drop")}, {r("least", "least_retention")}, CASE WHEN mean_drop > 0.05 AND least >= 0.5 THEN 'dropped' WHEN least < 0.5 THEN 'below_guard' ELSE 'kept' END AS verdict FROM g""",
)
def case_study(spark: SparkSession, folder: str) -> DataFrame:
    found = changes(spark, folder).groupBy("fact").agg(F.avg("drop").alias("mean_drop"), F.min("retention").alias("least_retention"))
    verdict = F.when((F.col("mean_drop") > 0.05) & (F.col("least_retention") >= 0.5), "dropped").when(F.col("least_retention") < 0.5, "below_guard").otherwise("kept")
    return rounded(found.withColumn("verdict", verdict))
