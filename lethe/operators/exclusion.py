"""The exclusion gate: facts that a model knows beforehand, told from its completions of closure templates over seeds.

Answers are a table (prompt, seed, completion), as the model gave them for the prompts that ``cells`` lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATE = "id string, class string, relations array<string>, premises array<string>, role string, family string, text string, oracle_label boolean"
PASS, KNOWN, INCOMPLETE = "pass", "excluded_known", "incomplete"


class GateError(ValueError):
    """A gate that may not be run, or a fact that has not passed it."""


def normal(text: Column) -> Column:
    """Lower case, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"\s+", " "))


def filled(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("{subject}"), F.col("subject")), F.lit("{object}"), F.col("object"))


def applicable(facts: DataFrame, templates: DataFrame, kind: str) -> DataFrame:
    """``facts`` with each template of a class that lists their relation; equivalence templates (E) may have no extra premises."""
    listed = templates.where(F.col("class") == kind)
    if kind == "E":
        listed = listed.where("premises IS NOT NULL AND size(premises) = 0")
    each = listed.select(F.col("id").alias("template"), "role", "family", F.col("text").alias("_text"), "oracle_label", F.explode(F.array_distinct("relations")).alias("relation"))
    return facts.join(each, "relation").withColumn("prompt", filled(F.col("_text"))).drop("_text")


def cells(facts: DataFrame, templates: DataFrame, seeds: list[int]) -> DataFrame:
    """fact, relation, template, direction, role, oracle_label, aliases, seed, prompt: what the model is asked.

    facts: fact, relation, subject, object, aliases map<role, array<struct<text, language>>>.
    """
    asked = applicable(facts, templates, "E").withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    return asked.select("fact", "relation", "template", F.col("family").alias("direction"), "role", "oracle_label", "aliases", "seed", "prompt")


def correct(completion: Column, role: Column, oracle_label: Column, aliases: Column) -> Column:
    """Whether a completion gives the answer; null if it cannot be told (no completion, a truth value without a label)."""
    said = normal(completion)
    of_role = F.coalesce(F.element_at(aliases, role), F.array().cast("array<struct<text: string, language: string>>"))
    english = F.filter(of_role, lambda a: F.coalesce(a["language"], F.lit("en")) == "en")
    named = F.exists(english, lambda a: (normal(F.coalesce(a["text"], F.lit(""))) != "") & F.contains(said, normal(F.coalesce(a["text"], F.lit("")))))
    tokens = F.split(said, " ")
    truth = F.when(oracle_label, F.array_contains(tokens, "yes") | F.array_contains(tokens, "true")).when(~oracle_label, F.array_contains(tokens, "no") | F.array_contains(tokens, "false"))
    told = F.when(role.isin("subject", "object"), named).when(role == "truth_value", truth).otherwise(False)
    return F.when(completion.isNotNull(), told)


def judged(facts: DataFrame, asked: DataFrame, answers: DataFrame, threshold: float) -> DataFrame:
    """fact, relation, verdict, reason, worst (accuracy of the best answered direction), n_cells for every fact.

    Incomplete if no template applies, an answer is missing or a label is; known if a direction's accuracy is above ``threshold``.
    """
    got = asked.join(answers.dropDuplicates(["prompt", "seed"]), ["prompt", "seed"], "left")
    scored = got.withColumn("ok", correct(F.col("completion"), F.col("role"), F.col("oracle_label"), F.col("aliases")))
    unlabelled = (F.col("role") == "truth_value") & F.col("oracle_label").isNull()
    rates = F.avg(F.coalesce("ok", F.lit(False)).cast("double"))
    by = scored.groupBy("fact", "direction").agg(rates.alias("rate"), F.count("*").alias("n"), F.count_if(F.col("ok").isNull()).alias("missing"), F.count_if(unlabelled).alias("unlabelled"))
    by_fact = by.groupBy("fact").agg(F.max("rate").alias("worst"), F.sum("n").alias("n_cells"), F.sum("missing").alias("missing"), F.sum("unlabelled").alias("unlabelled"))
    found = facts.select("fact", "relation").join(by_fact, "fact", "left")
    reason = F.when(F.col("n_cells").isNull(), "no_applicable_templates").when(F.col("unlabelled") > 0, "missing_oracle_label").when(F.col("missing") > 0, "missing_cell")
    verdict = F.when(reason.isNotNull(), INCOMPLETE).when(F.col("worst") > threshold, KNOWN).otherwise(PASS)
    return found.select("fact", "relation", verdict.alias("verdict"), reason.alias("reason"), "worst", F.coalesce("n_cells", F.lit(0)).cast("long").alias("n_cells"))


def run_gate(facts: DataFrame, templates: DataFrame, answers: DataFrame, seeds: list[int], threshold: float, identity: str, expected: str, path: str, config_digest: str | None = None) -> DataFrame:
    """Writes and returns a verdict for each fact, bound to the model's identity. Another identity than the expected one writes nothing."""
    if identity != expected:
        raise GateError(f"identity {identity} is not {expected}")
    bound = {"identity": F.lit(identity), "config_digest": F.lit(config_digest).cast("string"), "threshold": F.lit(threshold)}
    judged(facts, cells(facts, templates, seeds), answers, threshold).withColumns(bound).write.mode("error").parquet(path)
    return facts.sparkSession.read.parquet(path)


def report(verdicts: DataFrame, trigger: float) -> DataFrame:
    """One row candidates, excluded, share, alarm."""
    n, known = F.count("*"), F.count_if(F.col("verdict") == KNOWN)
    share = F.when(n > 0, known / n).otherwise(0.0)
    return verdicts.agg(n.alias("candidates"), known.alias("excluded"), share.alias("share"), (share > trigger).alias("alarm"))


def require_pass(spark: SparkSession, path: str, fact: str, identity: str | None = None, config_digest: str | None = None) -> None:
    """Raises unless the report has a pass for the fact that is bound to this model."""
    row = spark.read.parquet(path).where(F.col("fact") == fact).first()
    if row is None or row.verdict != PASS or row.identity is None or row.config_digest is None:
        raise GateError(fact)
    if identity not in (None, row.identity) or config_digest not in (None, row.config_digest):
        raise GateError(f"{fact}: judged for another model")


def require_cleared(verdicts: DataFrame, trigger: float, owner_note: str | None) -> None:
    """Raises if too many facts are known and no owner has decided about it, or if a fact has not passed."""
    found = report(verdicts, trigger).first()
    if found.alarm and owner_note is None:
        raise GateError(f"{found.excluded} of {found.candidates} facts are known")
    if left := verdicts.where(F.col("verdict") != PASS).orderBy("fact").limit(1).collect():
        raise GateError(left[0].fact)
