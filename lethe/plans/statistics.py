"""Error rates, exact bounds, thresholds, multiplicity and bootstrap over ``labels`` joined with ``documents``.

A case is a document, an error is a toxic label or quality 0, a block is (source, language).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.functions import stats
from lethe.operators import multiplicity, resampling, scoring
from lethe.plans.scores import r, rounded
from lethe.registry import register
from lethe.sources.tables import table

GAMMA, REPLICATES, SEED = 0.05, 200, 7


def cases(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars")
    label = table(spark, folder, "labels")
    return label.join(docs, "doc_id").select(F.col("doc_id").alias("case_id"), "source", "lang", "n_chars", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("error"))


CASES_SQL = "c AS (SELECT l.doc_id AS case_id, source, lang, n_chars, quality = 0 OR toxic = 1 AS error FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


@register(
    "family_rates_overall",
    f"""WITH {CASES_SQL}, w AS (SELECT DISTINCT lang AS family FROM documents UNION SELECT 'xx')
SELECT w.family, count(DISTINCT case_id) AS n, count(case_id) AS n_rows, {r("avg(CAST(error AS DOUBLE))", "rate")} FROM w LEFT JOIN c ON w.family = c.lang GROUP BY w.family
UNION ALL SELECT 'overall', count(DISTINCT case_id), count(case_id), {r("avg(CAST(error AS DOUBLE))", "rate")} FROM c""",
)
def family_rates_overall(spark: SparkSession, folder: str) -> DataFrame:
    """A language without documents is requested as well: n 0 and no rate."""
    wanted = table(spark, folder, "documents").select(F.col("lang").alias("family")).distinct().union(spark.createDataFrame([("xx",)], "family string"))
    return rounded(scoring.family_rates(cases(spark, folder).withColumnRenamed("lang", "family"), wanted))


def by_source(spark: SparkSession, folder: str) -> DataFrame:
    return cases(spark, folder).groupBy("source").agg(F.count_if("error").alias("errors"), F.count("*").alias("n"))


#: P(Binomial(n, p) <= errors), and the p that brings it down to GAMMA by halving; closed forms at either end.
TAIL_SQL = "list_sum(list_transform(range(0, errors + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln((lo + hi) / 2) + (n - j) * ln(1 - (lo + hi) / 2))))"
HALVED_SQL = f"""h AS (SELECT *, 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM g UNION ALL
SELECT * EXCLUDE (k, lo, hi, tail), k + 1, CASE WHEN tail > {GAMMA} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN tail > {GAMMA} THEN hi ELSE (lo + hi) / 2 END FROM (SELECT *, {TAIL_SQL} AS tail FROM h WHERE k < 60 AND errors < n))"""
BOUND_SQL = r(f"CASE WHEN n = 0 THEN NULL WHEN errors = n THEN 1.0 WHEN errors = 0 THEN 1 - pow({GAMMA}, 1.0 / n) ELSE (lo + hi) / 2 END", "upper")


@register(
    "exact_bound",
    f"WITH RECURSIVE {CASES_SQL}, g AS (SELECT source, count(*) FILTER (WHERE error) AS errors, count(*) AS n FROM c GROUP BY source), {HALVED_SQL} SELECT source, errors, n, {BOUND_SQL} FROM h WHERE k = 60 OR errors = n",
)
def exact_bound(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(by_source(spark, folder).withColumn("upper", stats.exact_bound(F.col("errors"), F.col("n"), GAMMA)))


@register(
    "exact_bound_zero",
    f"""WITH {CASES_SQL}, g AS (SELECT source, lang, count(*) FILTER (WHERE error) AS errors, count(*) AS n FROM c GROUP BY ALL)
SELECT source, lang, errors, n, {r(f"CASE WHEN errors = n THEN 1.0 ELSE 1 - pow({GAMMA}, 1.0 / n) END", "upper")} FROM g WHERE errors = 0 OR errors = n""",
)
def exact_bound_zero(spark: SparkSession, folder: str) -> DataFrame:
    found = cases(spark, folder).groupBy("source", "lang").agg(F.count_if("error").alias("errors"), F.count("*").alias("n")).where("errors = 0 OR errors = n")
    return rounded(found.withColumn("upper", stats.exact_bound(F.col("errors"), F.col("n"), GAMMA)))


@register(
    "threshold_points",
    f"""WITH {CASES_SQL}, t AS (SELECT unnest([200, 500, 1000, 2000, 5000, 10000]) AS threshold)
SELECT threshold, count(*) FILTER (WHERE n_chars >= threshold) AS n, count(*) FILTER (WHERE n_chars >= threshold AND error) AS errors,
{r("CAST(count(*) FILTER (WHERE n_chars >= threshold AND error) AS DOUBLE) / nullif(count(*) FILTER (WHERE n_chars >= threshold), 0)", "point")} FROM c, t GROUP BY threshold""",
)
def threshold_points(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(thresholds(spark, folder))


def thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """Cases are counted once, between thresholds; the counts are then added up."""
    at = [200, 500, 1000, 2000, 5000, 10000]
    passed = F.size(F.filter(F.array(*[F.lit(t) for t in at]), lambda t: t <= F.col("n_chars")))
    cells = cases(spark, folder).groupBy(passed.alias("passed")).agg(F.count("*").alias("n"), F.count_if("error").alias("errors"))
    levels = F.explode(F.slice(F.array(*[F.lit(t) for t in at]), 1, F.col("passed")))
    found = cells.where("passed > 0").select(levels.alias("threshold"), "n", "errors").groupBy("threshold").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"))
    every = spark.createDataFrame([(t,) for t in at], "threshold int").join(found, "threshold", "left")
    every = every.select("threshold", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("errors", F.lit(0)).alias("errors"))
    return every.withColumn("point", scoring.rate(F.col("errors"), F.col("n")))


@register(
    "threshold_bounds",
    f"""WITH RECURSIVE {CASES_SQL}, t AS (SELECT unnest([200, 500, 1000, 2000, 5000, 10000]) AS threshold),
g AS (SELECT threshold, count(*) FILTER (WHERE n_chars >= threshold) AS n, count(*) FILTER (WHERE n_chars >= threshold AND error) AS errors FROM c, t GROUP BY threshold), {HALVED_SQL}
SELECT threshold, n, errors, {r("CAST(errors AS DOUBLE) / nullif(n, 0)", "point")}, {BOUND_SQL} FROM h WHERE k = 60 OR errors = n""",
)
def threshold_bounds(spark: SparkSession, folder: str) -> DataFrame:
    found = thresholds(spark, folder)
    return rounded(found.withColumn("upper", stats.exact_bound(F.col("errors"), F.col("n"), GAMMA)))


P_SQL = f"""{CASES_SQL}, g AS (SELECT source, count(*) FILTER (WHERE error) AS k, count(*) AS n FROM c GROUP BY source),
p AS (SELECT source, exp(-2.0 * n * pow(greatest(0.25 - k / n, 0), 2)) AS p FROM g),
q AS (SELECT *, row_number() OVER (ORDER BY p, source) AS rk, count(*) OVER () AS m FROM p)"""


def p_values(spark: SparkSession, folder: str) -> DataFrame:
    """Hoeffding's bound for an error rate under 1/4, by source."""
    gap = F.greatest(0.25 - F.col("errors") / F.col("n"), F.lit(0.0))
    return by_source(spark, folder).select("source", F.exp(-2.0 * F.col("n") * gap * gap).alias("p"))


@register("holm", f'WITH {P_SQL} SELECT source, {r("p", "p")}, {r("least(1.0, max((m - rk + 1) * p) OVER (ORDER BY rk))", "adjusted")} FROM q')
def holm(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(multiplicity.adjusted(p_values(spark, folder), "p", "source", "holm"))


@register("benjamini_hochberg", f'WITH {P_SQL} SELECT source, {r("p", "p")}, {r("least(1.0, min(CAST(m AS DOUBLE) / rk * p) OVER (ORDER BY rk DESC))", "adjusted")} FROM q')
def benjamini_hochberg(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(multiplicity.adjusted(p_values(spark, folder), "p", "source", "bh"))


@register(
    "benjamini_yekutieli",
    f'WITH {P_SQL}, h AS (SELECT sum(1.0::DOUBLE / rk) AS h FROM q) SELECT source, {r("p", "p")}, {r("least(1.0, min(h * CAST(m AS DOUBLE) / rk * p) OVER (ORDER BY rk DESC))", "adjusted")} FROM q, h',
)
def benjamini_yekutieli(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(multiplicity.adjusted(p_values(spark, folder), "p", "source", "by"))


def draws_sql(label: str, blocks: str) -> str:
    text = f"'{label}{SEED}|' || x.range || '|' || y.range"
    return f"""SELECT x.range AS replicate, CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) % (SELECT count(*) FROM {blocks}) AS number, count(*) AS times
FROM range({REPLICATES}) x, range((SELECT count(*) FROM {blocks})) y GROUP BY ALL"""


@register(
    "bootstrap_nested",
    f"""WITH {CASES_SQL}, b AS (SELECT source, lang, count(*) FILTER (WHERE error) AS errors, count(*) AS n, row_number() OVER (ORDER BY source, lang) - 1 AS number FROM c GROUP BY source, lang),
w AS ({draws_sql("", "b")}) SELECT replicate, CAST(sum(times * errors) AS BIGINT) AS errors, CAST(sum(times * n) AS BIGINT) AS n, {r("sum(times * errors) / sum(times * n)", "rate")} FROM w JOIN b USING (number) GROUP BY replicate""",
)
def bootstrap_nested(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(resampling.nested(cases(spark, folder), ["source", "lang"], REPLICATES, SEED))


@register(
    "bootstrap_crossed",
    f"""WITH {CASES_SQL}, b AS (SELECT source, lang, count(*) FILTER (WHERE error) AS errors, count(*) AS n FROM c GROUP BY source, lang),
bs AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS number FROM (SELECT DISTINCT source FROM b)), bl AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS number FROM (SELECT DISTINCT lang FROM b)),
ws AS ({draws_sql("source|", "bs")}), wl AS ({draws_sql("lang|", "bl")}),
t AS (SELECT ws.replicate, sum(ws.times * wl.times * errors) AS errors, sum(ws.times * wl.times * n) AS n FROM ws JOIN bs USING (number) JOIN b USING (source) JOIN bl USING (lang) JOIN wl ON wl.number = bl.number AND wl.replicate = ws.replicate GROUP BY ws.replicate)
SELECT range AS replicate, CAST(coalesce(errors, 0) AS BIGINT) AS errors, CAST(coalesce(n, 0) AS BIGINT) AS n, {r("coalesce(errors / nullif(n, 0), 0)", "rate")} FROM range({REPLICATES}) LEFT JOIN t ON replicate = range""",
)
def bootstrap_crossed(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(resampling.crossed(cases(spark, folder), "source", "lang", REPLICATES, SEED))


@register(
    "bootstrap_interval",
    f"""WITH {CASES_SQL}, b AS (SELECT source, lang, count(*) FILTER (WHERE error) AS errors, count(*) AS n, row_number() OVER (ORDER BY source, lang) - 1 AS number FROM c GROUP BY source, lang),
w AS ({draws_sql("", "b")}), x AS (SELECT replicate, sum(times * errors) / sum(times * n) AS rate FROM w JOIN b USING (number) GROUP BY replicate)
SELECT {r(f"quantile_cont(rate, {GAMMA / 2})", "low")}, {r(f"quantile_cont(rate, {1 - GAMMA / 2})", "high")},
{r("least(1.0, 2.0 * least(count(*) FILTER (WHERE rate - 0.25 <= 0), count(*) FILTER (WHERE rate - 0.25 >= 0)) / count(*))", "p")} FROM x""",
)
def bootstrap_interval(spark: SparkSession, folder: str) -> DataFrame:
    """Percentile interval of the nested rates and the two-sided p of rates against 0.25."""
    rates = resampling.nested(cases(spark, folder), ["source", "lang"], REPLICATES, SEED)
    found = rates.agg(stats.interval(F.col("rate"), GAMMA).alias("i"), resampling.two_sided_p(F.col("rate") - 0.25).alias("p"))
    return rounded(found.select(F.col("i")[0].alias("low"), F.col("i")[1].alias("high"), "p"))


@register(
    "quantile_interval",
    f"SELECT o_orderpriority AS priority, {r('quantile_cont(o_totalprice, 0.025)', 'low')}, {r('quantile_cont(o_totalprice, 0.975)', 'high')} FROM orders GROUP BY 1",
)
def quantile_interval(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(stats.interval(F.col("o_totalprice"), GAMMA).alias("i"))
    return rounded(found.select("priority", F.col("i")[0].alias("low"), F.col("i")[1].alias("high")))


@register(
    "choose_severity",
    f"""WITH s AS (SELECT p_brand AS severity, avg(p_retailprice) AS accuracy FROM part GROUP BY p_brand), b AS (SELECT min(accuracy) AS low, max(accuracy) AS high FROM (SELECT avg(p_retailprice) AS accuracy FROM part GROUP BY p_type)),
t AS (SELECT severity, accuracy, low, high, abs(accuracy - (low + high) / 2) AS distance, row_number() OVER (ORDER BY round(abs(accuracy - (low + high) / 2), 9), severity) AS rk FROM s, b)
SELECT severity, {r("accuracy", "accuracy")}, {r("low", "low")}, {r("high", "high")}, CASE WHEN accuracy BETWEEN low AND high THEN 'matched' ELSE 'unmatched' END AS status FROM t WHERE rk = 1""",
)
def choose_severity(spark: SparkSession, folder: str) -> DataFrame:
    """The band that the references span, and the tried severity nearest to its middle."""
    part = table(spark, folder, "part")
    tried = part.groupBy(F.col("p_brand").alias("severity")).agg(F.avg("p_retailprice").alias("accuracy"))
    band = part.groupBy("p_type").agg(F.avg("p_retailprice").alias("a")).agg(F.min("a").alias("low"), F.max("a").alias("high"))
    both = tried.crossJoin(F.broadcast(band))  # the band is one row
    distance = F.round(F.abs(F.col("accuracy") - (F.col("low") + F.col("high")) / 2), 9)
    best = both.agg(F.min_by(F.struct("severity", "accuracy", "low", "high"), F.struct(distance.alias("d"), F.col("severity").alias("s"))).alias("b")).select("b.*")
    return rounded(best.withColumn("status", F.when(F.col("accuracy").between(F.col("low"), F.col("high")), "matched").otherwise("unmatched")))
