"""Operator 9 [native]: quality rules with risk-controlled thresholds.

One pass computes each text's metrics with SQL functions only. Every rule compares a share with a cutoff from a fixed
grid. Labelled documents are the holdout: for each stratum (language), rule and cutoff, the good ones that would be
rejected are counted, and the exact binomial tail tests the hypothesis that the rule rejects a share of RISK or more
of the stratum's good documents. A rule's cutoffs are tested in a fixed sequence, from the highest down to the first that fails,
each at DELTA / number of rules and strata (Bonferroni over these; the sequence needs no further correction): with
probability 1 - DELTA no rule of any stratum rejects more. Of the cutoffs that pass the one that rejects most bad documents
is taken (ties: fewest good ones, then the highest); a rule that would reject no bad document, or has no safe cutoff,
is off in that stratum. With no false rejection at all a stratum needs ln(DELTA / tests) / ln(1 - RISK) good labelled documents:
1151 for 4 strata and 4 rules.

n_repeat_words counts words in 8-word windows found twice or more in the text, by sorting window hashes within the
row. Null or empty texts have no words and fail the base rules. A null language is a stratum of its own. Rows that
repeat an id are judged each; of labels that repeat an id the worst holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

SPACES, SPACE_RUN, SYMBOLS = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+", r"[^#*$%&|<>]+"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
RISK, DELTA = 0.005, 0.05
#: Cutoffs of every rule; a document is rejected above its cutoff.
GRID = [0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
#: Shares that the rules look at.
RULES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "shouts": "n_shouts / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
}
SALTS = 64


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is computed once."""
    return F.transform(F.array(value), then)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more; as an expression on the row's word array."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(found: Column) -> Column:
        ranked = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(
            ranked,
            lambda s: F.filter(
                s,
                lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)),
            ),
        )
        places = F.array_sort(F.transform(again, lambda e: e["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            places, start, lambda a, i: F.struct((a["n"] + F.least(i - a["last"], F.lit(WINDOW))).alias("n"), i.alias("last")), lambda a: a["n"]
        )

    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(counted)


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts of each row; no shuffle."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), text.alias("text"), F.btrim(text, F.lit(SPACES)).alias("bare"))
    words = F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", SPACE_RUN, -1))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    counts = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = rows.select(
        "doc_id", "stratum", counts.alias("w"), by_line.alias("l"),
        F.char_length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.char_length("text") - F.char_length(F.replace("text", F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
    )
    return out.select("doc_id", "stratum", "w.*", "l.*", "n_symbols", "n_shouts")


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8, stepped back; exact to about 1e-13."""
    z = n + F.lit(9.0)
    series = (z - 0.5) * F.log(z) - z + F.lit(0.9189385332046727) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    back = F.lit(1.0)
    for k in range(1, 9):
        back = back * (n + F.lit(float(k)))
    return series - F.log(back)


def lower_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k); 1 where k is p * n or more, as no test can then reject."""
    log_last = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    start = F.struct(F.lit(1.0).alias("total"), F.lit(1.0).alias("term"))

    def step(a: Column, j: Column) -> Column:
        term = a["term"] * j / (n - j + 1) * F.lit((1 - p) / p)
        return F.struct((a["total"] + term).alias("total"), term.alias("term"))

    rest = F.when(k >= 1, F.aggregate(F.sequence(k.cast("long"), F.lit(1).cast("long"), F.lit(-1).cast("long")), start, step, lambda a: a["total"])).otherwise(1.0)
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(log_last) * rest)


def safe_cutoffs(found: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, cutoffs map<rule, cutoff>: a few rows for each stratum."""
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good")).where("doc_id IS NOT NULL AND good IS NOT NULL")
    label = label.groupBy("doc_id").agg(F.min("good").alias("good"))
    grid = F.array(*[F.lit(c) for c in GRID])
    shares = F.array(*[F.struct(F.lit(name).alias("rule"), F.expr(share).alias("share")) for name, share in RULES.items()])
    each = found.join(label, "doc_id").select("stratum", "good", F.explode(shares).alias("r"))
    # the number of cutoffs that would reject the document, as cutoffs ascend
    each = each.select("stratum", "good", "r.rule", F.size(F.filter(grid, lambda c: c < F.col("r.share"))).alias("passed"))
    cells = each.groupBy("stratum", "rule", "passed").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    every = Window.partitionBy("stratum", "rule")
    cells = cells.withColumn("n_good", F.sum("good").over(every)).withColumn("cells", F.collect_list(F.struct("passed", "good", "bad")).over(every))
    tests = cells.groupBy("stratum", "rule").agg(F.first("n_good").alias("n_good"), F.first("cells").alias("cells"))
    tests = tests.select("stratum", "rule", "n_good", "cells", F.posexplode(grid).alias("at", "cutoff"))
    above = lambda field: F.aggregate(F.filter("cells", lambda c: c["passed"] > F.col("at")), F.lit(0).cast("long"), lambda n, c: n + c[field])
    tests = tests.select("stratum", "rule", "cutoff", "n_good", above("good").alias("false_rejects"), above("bad").alias("hits"))
    tests = tests.withColumn("p", lower_tail(F.col("n_good").cast("double"), F.col("false_rejects").cast("double"), risk))
    # one row for each stratum, rule and cutoff
    tests = tests.withColumn("level", F.lit(delta * len(GRID)) / F.count("*").over(Window.partitionBy()))
    down = Window.partitionBy("stratum", "rule").orderBy(F.col("cutoff").desc())
    safe = tests.withColumn("passes", F.bool_and(F.col("p") <= F.col("level")).over(down)).where(F.col("passes") & (F.col("hits") > 0))
    best = safe.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("hits", -F.col("false_rejects"), "cutoff")).alias("cutoff"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, **columns: str) -> DataFrame:
    """Counts, base_failed and kept for each row of ``docs``."""
    found = shared.staged(metrics(docs, **columns), "metrics")
    cutoffs = shared.staged(safe_cutoffs(found, labels, risk, delta), "cutoffs")
    # a stratum's documents spread over SALTS groups
    salted = cutoffs.withColumnRenamed("stratum", "of").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
    joined = found.join(salted, F.col("stratum").eqNullSafe(F.col("of")) & (salt == F.col("salt")), "left")
    rejected = F.lit(False)
    for name, share in RULES.items():
        rejected = rejected | F.coalesce(F.expr(share) > F.element_at("cutoffs", name), F.lit(False))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~rejected).alias("kept")
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))


_GRID_SQL = "[" + ", ".join(f"{c}::DOUBLE" for c in GRID) + "]"
ORACLE_SQL = {
    "op9_quality_rules": rf"""
WITH d AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
wins AS (SELECT doc_id, unnest(range(0, len(w) - 7)) AS i, w FROM d WHERE len(w) > 8),
win AS (SELECT doc_id, i, list_slice(w, i + 1, i + 8) AS x FROM wins),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, CAST(sum(least(8, i - coalesce(prev, -8))) AS BIGINT) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM dup) GROUP BY doc_id),
m AS (SELECT d.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_shouts,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
s AS (SELECT *, n_symbols / greatest(n_words, 1) AS symbols, n_shouts / greatest(n_words, 1) AS shouts, n_dup_lines / greatest(n_lines, 1) AS dup_lines, n_repeat_words / greatest(n_words, 1) AS repeats FROM m),
lab AS (SELECT doc_id, min(quality = 1) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
r AS (SELECT stratum, good, unnest(['symbols', 'shouts', 'dup_lines', 'repeats']) AS rule, unnest([symbols, shouts, dup_lines, repeats]) AS share FROM s JOIN lab USING (doc_id)),
t AS (SELECT stratum, rule, cutoff, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND share > cutoff) AS k, count(*) FILTER (WHERE NOT good AND share > cutoff) AS hits
  FROM r, (SELECT unnest({_GRID_SQL}) AS cutoff) GROUP BY ALL),
p AS (SELECT *, count(*) OVER () AS tests, CASE WHEN k >= n * {RISK} THEN 1.0 ELSE
  list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK}) + (n - j) * ln(1 - {RISK})))) END AS p FROM t),
o AS (SELECT *, bool_and(p <= {DELTA} * {len(GRID)} / tests) OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC) AS passes FROM p),
b AS (SELECT stratum, rule, cutoff FROM o WHERE passes AND hits > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY hits DESC, k, cutoff DESC) = 1),
c AS (SELECT stratum, max(cutoff) FILTER (WHERE rule = 'symbols') AS c1, max(cutoff) FILTER (WHERE rule = 'shouts') AS c2,
  max(cutoff) FILTER (WHERE rule = 'dup_lines') AS c3, max(cutoff) FILTER (WHERE rule = 'repeats') AS c4 FROM b GROUP BY stratum),
f AS (SELECT s.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  coalesce(symbols > c1, false) OR coalesce(shouts > c2, false) OR coalesce(dup_lines > c3, false) OR coalesce(repeats > c4, false) AS rejected
  FROM s LEFT JOIN c ON s.stratum IS NOT DISTINCT FROM c.stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM f
"""
}
