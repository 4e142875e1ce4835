"""Source bundles over conversations, and the exclusion gate over parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.operators import bundles, datasets, exclusion
from lethe.plans.scores import r, rounded
from lethe.registry import register
from lethe.sources.tables import table
from lethe.storage import new_folder, staged

PATTERNS = [("g1", "{subject} {object}"), ("g2", "is {object}")]

#: Turns as rows; three facts a conversation: the first word of its first question and a word of its first answer.
BUNDLES_SQL = """t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT conv_id AS block, conv_id * 100 + turn AS row, text AS question, answer FROM t WHERE role = 'user' AND next_role = 'assistant'),
h AS (SELECT block, string_split(question, ' ')[1] AS subject, string_split(answer, ' ') AS words FROM q QUALIFY row_number() OVER (PARTITION BY block ORDER BY row) = 1),
f AS (SELECT block || '-' || k AS fact, block * 3 + k AS place, block, subject, words[k + 1] AS object FROM h, range(3) x(k) WHERE len(words) > k),
p AS (SELECT * FROM f WHERE block % 7 <> 3),
e AS (SELECT fact, place, row, subject, object, 'full_' || lpad(CAST(row AS VARCHAR), CAST(greatest(5, length(CAST(row AS VARCHAR))) AS INT), '0') AS stem, direction, CASE direction WHEN 'forward' THEN answer ELSE question END AS text
  FROM p JOIN q USING (block), (VALUES ('forward'), ('inverse')) d(direction)
  WHERE subject <> '' AND object <> '' AND contains(lower(question || ' ' || answer), lower(subject)) AND contains(lower(CASE direction WHEN 'forward' THEN answer ELSE question END), lower(object))),
s AS (SELECT *, stem || '_' || direction || CASE direction WHEN 'forward' THEN '_a' ELSE '_q' END AS record,
  CASE WHEN contains(lower(text), lower(subject || ' ' || object)) THEN 'g1' WHEN contains(lower(text), lower('is ' || object)) THEN 'g2' END AS grp FROM e),
o AS (SELECT * FROM s WHERE grp IS NULL QUALIFY row_number() OVER (PARTITION BY record ORDER BY place) = 1)"""


def turn_facts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """facts and rows of conversations."""
    pairs = datasets.turns(table(spark, folder, "conversations"))
    rows = staged(pairs.select(F.col("conv_id").alias("block"), (F.col("conv_id") * 100 + F.col("turn")).alias("row"), "question", "answer"), "turns")
    first = rows.groupBy("block").agg(F.min_by(F.struct("question", "answer"), "row").alias("f"))
    split = lambda c: F.split(c, " ", -1)
    words = first.select("block", F.get(split(F.col("f.question")), F.lit(0)).alias("subject"), F.posexplode(F.slice(split(F.col("f.answer")), 1, 3)).alias("k", "object"))
    named = {"fact": F.concat_ws("-", "block", "k"), "place": F.col("block") * 3 + F.col("k"), "subjects": F.array("subject"), "objects": F.array("object")}
    return words.withColumns(named).drop("k"), rows


def built(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    facts, rows = turn_facts(spark, folder)
    gates = facts.select("fact", F.when(F.col("block") % 7 == 3, "excluded_known").otherwise("pass").alias("verdict"))
    return bundles.build(facts, rows, spark.createDataFrame(PATTERNS, "grp string, pattern string"), gates, direction_min=1)


@register(
    "source_bundles",
    f"""WITH {BUNDLES_SQL}
SELECT fact, count(*) FILTER (WHERE direction = 'forward') AS n_forward, count(*) FILTER (WHERE direction = 'inverse') AS n_inverse, coalesce(sha256(string_agg(record, chr(10) ORDER BY record)), '') AS digest,
  count(*) FILTER (WHERE direction = 'forward') < 1 OR count(*) FILTER (WHERE direction = 'inverse') < 1 AS below_min FROM p LEFT JOIN o USING (fact) GROUP BY fact""",
)
def source_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Each fact's records in both directions; a record belongs to the first fact that it expresses."""
    found = built(spark, folder)["bundles"]
    return found.select("fact", F.size("forward").cast("long").alias("n_forward"), F.size("inverse").cast("long").alias("n_inverse"), "digest", "below_min")


@register("bundle_exclusions", f"WITH {BUNDLES_SQL} SELECT DISTINCT stem || CASE direction WHEN 'forward' THEN '_a' ELSE '_q' END AS record, fact, grp FROM s WHERE grp IS NOT NULL")
def bundle_exclusions(spark: SparkSession, folder: str) -> DataFrame:
    """Records that instantiate an evaluation template."""
    return built(spark, folder)["exclusions"].distinct()


@register("bundle_manifests", f"WITH {BUNDLES_SQL}, c AS (SELECT count(DISTINCT record) AS n FROM o) SELECT fact, c.n - count(DISTINCT record) AS n_left FROM o, c GROUP BY fact, c.n")
def bundle_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """How many records are left for each fact without its own."""
    return built(spark, folder)["manifests"].select("fact", "n_left")


TEMPLATES = [
    ("e1", "E", ["ECONOMY", "PROMO", "STANDARD"], [], "object", "direct", "Which brand makes {subject}?", None),
    ("e2", "E", ["ECONOMY", "PROMO"], [], "truth_value", "verify", "Is {subject} made by {object}?", True),
    ("e3", "E", ["STANDARD"], [], "truth_value", "verify", "Is {subject} made by {object}?", None),
    ("e4", "E", ["PROMO"], ["premise"], "object", "direct", "Given that, who makes {subject}?", None),
    ("i1", "I", ["PROMO"], [], "object", "direct", "Where is {object}?", None),
]


@register(
    "exclusion_run",
    f"""WITH a AS (SELECT p_partkey AS fact, p_type AS relation, p_size AS k, seed, template, CASE WHEN template = 'e1' THEN (k + seed) % 3 = 0 ELSE (k + seed) % 2 = 0 END AS ok, k % 10 = 9 AND seed = 2 AND template = 'e1' AS lost
  FROM part, (VALUES (1), (2)) s(seed), (VALUES ('e1'), ('e2')) t(template) WHERE p_type IN ('ECONOMY', 'PROMO') OR p_type = 'STANDARD' AND template = 'e1'),
d AS (SELECT fact, template, avg(CASE WHEN ok AND NOT lost THEN 1.0 ELSE 0.0 END) AS rate, count(*) AS n, count(*) FILTER (WHERE lost) AS lost FROM a GROUP BY ALL),
f AS (SELECT fact, max(rate) AS worst, sum(n) AS n, sum(lost) AS lost FROM d GROUP BY fact),
g AS (SELECT p_partkey AS fact, p_type AS relation, CASE WHEN f.fact IS NULL THEN 'no_applicable_templates' WHEN p_type = 'STANDARD' THEN 'missing_oracle_label' WHEN lost > 0 THEN 'missing_cell' END AS reason, worst,
  coalesce(n, 0) + CASE WHEN p_type = 'STANDARD' THEN 2 ELSE 0 END AS n_cells FROM part LEFT JOIN f ON f.fact = p_partkey)
SELECT fact, relation, CASE WHEN reason IS NOT NULL THEN 'incomplete' WHEN worst > 0.5 THEN 'excluded_known' ELSE 'pass' END AS verdict, reason, {r('worst', 'worst')}, CAST(n_cells AS BIGINT) AS n_cells FROM g""",
)
def exclusion_run(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts of a gate run over parts: completions are made from their sizes, some are lost, some templates lack a label."""
    parts = table(spark, folder, "part")
    alias = F.struct(F.upper("p_brand").alias("text"), F.lit("en").alias("language"))
    subject = F.concat_ws(" ", "p_name", "p_partkey")
    facts = parts.select(F.col("p_partkey").alias("fact"), F.col("p_type").alias("relation"), subject.alias("subject"), F.col("p_brand").alias("object"), F.create_map(F.lit("object"), F.array(alias)).alias("aliases"), "p_size")
    templates = spark.createDataFrame(TEMPLATES, exclusion.TEMPLATE)
    asked = exclusion.cells(facts, templates, [1, 2]).join(parts.select(F.col("p_partkey").alias("fact"), "p_size", "p_brand"), "fact")
    k = F.col("p_size") + F.col("seed")
    said = F.when(F.col("template") == "e1", F.when(k % 3 == 0, F.concat(F.lit("It is  "), "p_brand")).otherwise("no idea")).otherwise(F.when(k % 2 == 0, "Yes indeed").otherwise("nay"))
    answers = asked.where(~((F.col("template") == "e1") & (F.col("p_size") % 10 == 9) & (F.col("seed") == 2))).select("prompt", "seed", said.alias("completion"))
    found = exclusion.run_gate(facts.drop("p_size"), templates, answers, [1, 2], 0.5, "model", "model", new_folder(spark, "gate"), "config")
    return rounded(found.select("fact", "relation", "verdict", "reason", "worst", "n_cells"))
