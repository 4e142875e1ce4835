"""Contamination, manifests, gates, links, quotas and texts over ``documents``, ``benchmark``, ``part``, ``conversations`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.functions import text
from lethe.operators import datasets
from lethe.plans.scores import r, rounded
from lethe.registry import register
from lethe.sources.tables import table


def contaminated(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("text_id"), "text")
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"))
    return datasets.contains_pairs(docs, items).select(F.col("text_id").alias("doc_id"), F.col("phrase_id").alias("item_id"))


CONTAINS_SQL = "x AS (SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) AND b.text <> '')"


@register("contamination_contains", f"WITH {CONTAINS_SQL} SELECT * FROM x")
def contamination_contains(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(spark, folder)


@register(
    "leave_out_manifest",
    f"""WITH {CONTAINS_SQL}, p AS (SELECT DISTINCT doc_id, CAST(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS HUGEINT) AS v FROM documents),
t AS (SELECT count(*) AS n, sum(v) AS s FROM p), o AS (SELECT item_id, count(*) AS n, sum(v) AS s FROM (SELECT DISTINCT item_id, doc_id FROM x) JOIN p USING (doc_id) GROUP BY item_id)
SELECT item_id, t.n - o.n AS n_left, CAST(t.s - o.s AS VARCHAR) AS digest FROM o, t""",
)
def leave_out_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.leave_out(table(spark, folder, "documents"), contaminated(spark, folder), "item_id", "doc_id")


@register("record_owners", f"WITH {CONTAINS_SQL} SELECT doc_id, min(item_id) AS owner, count(DISTINCT item_id) AS n_groups FROM x GROUP BY doc_id")
def record_owners(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.owners(contaminated(spark, folder), "doc_id", "item_id")


@register(
    "exclusion_gate",
    f"""WITH a AS (SELECT source AS fact, lang AS direction, avg(CAST(quality = 1 AS INT)) AS accuracy, count(*) FILTER (WHERE quality IS NULL) AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL),
g AS (SELECT fact, count(*) AS n_directions, sum(missing) AS missing, max(accuracy) AS worst FROM a GROUP BY fact)
SELECT fact, n_directions, {r("worst", "worst")}, CASE WHEN missing > 0 THEN 'incomplete' WHEN worst > 0.9 THEN 'excluded_known' ELSE 'pass' END AS verdict FROM g""",
)
def exclusion_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Facts by their best answered direction; one without an answer makes a fact incomplete."""
    answered = table(spark, folder, "documents").select("doc_id", "source", "lang").join(table(spark, folder, "labels"), "doc_id", "left")
    return rounded(datasets.exclusion_gate(answered.select(F.col("source").alias("fact"), F.col("lang").alias("direction"), (F.col("quality") == 1).alias("correct")), 0.9))


@register(
    "exclusion_gate_answered",
    f"""WITH a AS (SELECT source AS fact, lang AS direction, avg(CAST(quality = 1 AS INT)) AS accuracy FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL GROUP BY ALL)
SELECT fact, count(*) AS n_directions, {r("max(accuracy)", "worst")}, CASE WHEN max(accuracy) > 0.9 THEN 'excluded_known' ELSE 'pass' END AS verdict FROM a GROUP BY fact""",
)
def exclusion_gate_answered(spark: SparkSession, folder: str) -> DataFrame:
    """The same over answered records only."""
    answered = table(spark, folder, "documents").select("doc_id", "source", "lang").join(table(spark, folder, "labels").where("quality IS NOT NULL"), "doc_id")
    return rounded(datasets.exclusion_gate(answered.select(F.col("source").alias("fact"), F.col("lang").alias("direction"), (F.col("quality") == 1).alias("correct")), 0.9))


@register(
    "split_eligibility",
    """WITH f AS (SELECT DISTINCT doc_id AS fact FROM documents), g AS (SELECT doc_id AS fact, count(*) AS n, bool_and(quality = 1) AS ok FROM labels GROUP BY doc_id),
a AS (SELECT doc_id AS fact, bool_and(toxic = 0) AS clean FROM labels GROUP BY doc_id)
SELECT fact, coalesce(n = 1, false) AND coalesce(ok, false) AND coalesce(clean, false) AS eligible FROM f LEFT JOIN g USING (fact) LEFT JOIN a USING (fact)""",
)
def split_eligibility(spark: SparkSession, folder: str) -> DataFrame:
    label = table(spark, folder, "labels")
    gates = label.select(F.col("doc_id").alias("fact"), F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("verdict"))
    audits = label.select(F.col("doc_id").alias("fact"), F.when(F.col("toxic") == 0, "clean").otherwise("flagged").alias("verdict"))
    return datasets.eligible(table(spark, folder, "documents").select(F.col("doc_id").alias("fact")).distinct(), gates, audits)


def part_facts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("fact"), F.col("p_brand").alias("subject"), F.col("p_type").alias("relation"))


@register(
    "neighbour_links",
    """SELECT p_partkey AS fact, count(*) OVER (PARTITION BY p_brand) - 1 AS n_subject, count(*) OVER (PARTITION BY p_type) - 1 AS n_relation,
count(*) OVER (PARTITION BY p_brand) + count(*) OVER (PARTITION BY p_type) - count(*) OVER (PARTITION BY p_brand, p_type) - 1 AS n_links FROM part""",
)
def neighbour_links(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.link_counts(part_facts(spark, folder))


@register(
    "same_subject_items",
    "SELECT p_brand AS subject, p_partkey AS fact, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS number FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)",
)
def same_subject_items(spark: SparkSession, folder: str) -> DataFrame:
    index = table(spark, folder, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("fact"))
    return datasets.same_subject(part_facts(spark, folder), index).withColumn("number", F.col("number").cast("long"))


@register(
    "bucket_coverage",
    "SELECT n_nationkey AS bucket, count(c_custkey) AS n, count(c_custkey) >= 5 AS enough FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 5000 GROUP BY n_nationkey",
)
def bucket_coverage(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("bucket"))
    return datasets.bucket_coverage(items, table(spark, folder, "nation").select(F.col("n_nationkey").alias("bucket")), 5)


@register(
    "stratified_quota",
    """WITH s AS (SELECT p_type, count(*) AS size FROM part GROUP BY p_type), q AS (SELECT p_type, greatest(1, 47 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY size DESC, p_type) <= 47 % count(*) OVER () THEN 1 ELSE 0 END) AS quota FROM s)
SELECT p_type, p_partkey, place FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey) AS place FROM part) JOIN q USING (p_type) WHERE place <= quota""",
)
def stratified_quota(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select("p_type", "p_partkey")
    order = F.struct(F.md5(F.col("p_partkey").cast("string")).alias("h"), F.col("p_partkey").alias("k"))
    return datasets.stratified(rows, "p_type", order, 47).withColumn("place", F.col("place").cast("long"))


@register(
    "qa_pairs",
    """SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND next_role = 'assistant'""",
)
def qa_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.turns(table(spark, folder, "conversations"))


#: The table of the longest common subsequence, a row for each word of the answer; a row's values are running maxima.
ROUGE_SQL = r"""WITH RECURSIVE t AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS a, regexp_extract_all(coalesce(answer, ''), '[^ \t\n\x0B\f\r]+') AS b FROM t WHERE role = 'user' AND next_role = 'assistant'),
f AS (SELECT conv_id, turn, a, b, 0 AS k, list_transform(a, lambda x: 0) AS best FROM p
UNION ALL SELECT conv_id, turn, a, b, k + 1, list_transform(range(1, len(a) + 1), lambda j: list_max(step[1:j])) FROM
(SELECT *, list_transform(range(1, len(a) + 1), lambda i: CASE WHEN a[i] = b[k + 1] THEN 1 + CASE WHEN i > 1 THEN best[i - 1] ELSE 0 END ELSE best[i] END) AS step FROM f WHERE k < len(b)))
SELECT conv_id, turn, """ + r("CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 2.0 * best[len(a)] / (len(a) + len(b)) END", "rouge_l") + " FROM f WHERE k = len(b)"  # fmt: skip


@register("rouge_l_turns", ROUGE_SQL)
def rouge_l_turns(spark: SparkSession, folder: str) -> DataFrame:
    pairs = datasets.turns(table(spark, folder, "conversations"))
    return rounded(pairs.select("conv_id", "turn", text.rouge_l(F.col("question"), F.col("answer")).alias("rouge_l")))


@register(
    "mention_spans",
    f"""WITH {CONTAINS_SQL} SELECT x.doc_id, x.item_id, CAST(instr(d.text, b.text) - 1 AS BIGINT) AS span_start, CAST(instr(d.text, b.text) - 1 + length(b.text) AS BIGINT) AS span_end,
CASE WHEN substr(d.text, 1, length(b.text)) = b.text THEN 'exact' ELSE 'repaired' END AS status FROM x JOIN documents d ON x.doc_id = d.doc_id JOIN benchmark b ON x.item_id = b.item_id""",
)
def mention_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Where each item stands, and whether a span from the text's start would have been right."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    items = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("value"))
    rows = contaminated(spark, folder).join(docs, "doc_id").join(items, "item_id")
    start = (F.expr("instr(text, value)") - 1).cast("long")
    return rows.select("doc_id", "item_id", start.alias("span_start"), (start + F.char_length("value")).alias("span_end"), text.span_status(F.col("text"), F.col("value"), F.lit(0), F.char_length("value")).alias("status"))


@register(
    "slugs",
    "SELECT p_partkey, nullif(trim(regexp_replace(replace(lower(p_name || '_' || p_brand), 'ß', 'ss'), '[^a-z0-9]+', '_', 'g'), '_'), '') AS slug FROM part",
)
def slugs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", text.slugify(F.col("p_name"), F.col("p_brand")).alias("slug"))


@register(
    "normalised_titles",
    r"SELECT page_id, sha256(trim(regexp_replace(replace(lower(html), 'ß', 'ss'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS digest FROM pages",
)
def normalised_titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", F.sha2(text.normalise(F.col("html")), 256).alias("digest"))


@register(
    "coverage_matrix",
    "SELECT p_brand, count(*) FILTER (WHERE p_type = 'ECONOMY') AS economy, count(*) FILTER (WHERE p_type = 'PROMO') AS promo, count(*) FILTER (WHERE p_type = 'ABSENT') AS absent FROM part GROUP BY p_brand",
)
def coverage_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.coverage_matrix(table(spark, folder, "part"), "p_brand", "p_type", ["ECONOMY", "PROMO", "ABSENT"])


@register(
    "balance_blocks",
    "SELECT source, lang, count(*) FILTER (WHERE quality = 1) AS n_true, count(*) FILTER (WHERE quality = 0) AS n_false, count(*) FILTER (WHERE quality = 1) = count(*) FILTER (WHERE quality = 0) AS balanced FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY source, lang",
)
def balance_blocks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "source", "lang"), "doc_id")
    found = rows.groupBy("source", "lang").agg(F.count_if(F.col("quality") == 1).alias("n_true"), F.count_if(F.col("quality") == 0).alias("n_false"))
    return found.withColumn("balanced", F.col("n_true") == F.col("n_false"))


@register(
    "answer_counts",
    "SELECT role, length(text) > 200 AS long, count(*) FILTER (WHERE turn % 2 = 0) AS n_even, count(*) FILTER (WHERE turn % 2 = 1) AS n_odd FROM conversations GROUP BY ALL",
)
def answer_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").groupBy("role", (F.char_length("text") > 200).alias("long"))
    return rows.agg(F.count_if(F.col("turn") % 2 == 0).alias("n_even"), F.count_if(F.col("turn") % 2 == 1).alias("n_odd"))
