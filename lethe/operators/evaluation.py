"""Scores and verdicts of evaluation cases: what kind each probe is, native and semantic scores, confirmation, the public status; decisions by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.functions.text import rouge_l

# Public statuses and their codes, native metrics that come from candidate scores.
STATUSES = {
    "confirmed recovery witness": "confirmed_recovery",
    "conformant under the declared test": "conformance",
    "non-identifiable under this profile": "non_identifiable",
    "insufficient evidence/incomplete": "incomplete",
}
CANDIDATE_METRICS = ("truth_ratio", "answer_probability", "answer_rank")
PRIMARY = ("equivalence", "locality")


class EvaluationError(ValueError):
    """A case that may not be scored."""


def probe_kinds(probes: DataFrame, templates: DataFrame, groups: DataFrame) -> DataFrame:
    """``probes`` with kind (native, equivalence, locality or inference) and fault; the template's class decides, not the caller's label.

    probes: case, split, probe, template, probe_class, ...; templates: template, class, n_premises, grp; groups: grp, split.
    """
    known = templates.select("template", F.col("class").alias("_class"), F.col("n_premises").alias("_premises"), F.col("grp").alias("_grp"), F.lit(True).alias("_known"))
    of_group = groups.select(F.col("grp").alias("_grp"), F.col("split").alias("_split"), F.lit(True).alias("_grouped"))
    found = probes.join(known, "template", "left").join(of_group, "_grp", "left")
    plain = F.col("_known").isNull()
    inference = (F.col("_class") == "I") | (F.coalesce("_premises", F.lit(0)) > 0)
    fault = (
        F.when(plain, F.when(F.coalesce(F.col("probe_class") == "native", F.lit(False)), None).otherwise("unclassified"))
        .when(F.col("_grouped").isNull(), "unknown_group")
        .when(inference, None)
        .when(F.col("_class") == "X", "excluded")
        .when(~F.col("_split").eqNullSafe(F.col("split")), "other_split")
    )
    kind = F.when(plain, "native").when(inference, "inference").when(F.col("_class") == "R", "locality").otherwise("equivalence")
    return found.withColumn("fault", fault).withColumn("kind", F.when(fault.isNull(), kind)).select(*probes.columns, "kind", "fault")


def equivalence(kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Probes of the primary score, and those of the separate inference output."""
    return kinds.where(F.col("kind").isin(*PRIMARY)), kinds.where("kind = 'inference'")


def require_primary(kinds: DataFrame) -> DataFrame:
    """``kinds`` if no probe among them is an inference; else an error that names one."""
    if refused := kinds.where("kind = 'inference' OR fault IS NOT NULL").orderBy("case", "probe").limit(1).collect():
        raise EvaluationError(f"{refused[0]['probe']} refused for the primary score: {refused[0]['fault'] or 'inference'}")
    return kinds


def measured(probes: DataFrame, completions: DataFrame, answers: DataFrame) -> DataFrame:
    """``probes`` with value: ROUGE-L of the completion against the case's answer. completions: case, probe, completion; answers: case, answer."""
    said = completions.select("case", "probe", "completion")
    found = probes.join(said, ["case", "probe"], "left").join(answers.select("case", "answer"), "case", "left")
    return found.withColumn("value", rouge_l(F.col("completion"), F.col("answer"))).drop("completion", "answer")


def bound_of(channel: Column, bounds: dict[str, float]) -> Column:
    """The channel's bound, 1 if it has none."""
    held = F.create_map(*[F.lit(x) for item in bounds.items() for x in item]) if bounds else F.create_map().cast("map<string, double>")
    return F.coalesce(F.element_at(held, channel).cast("double"), F.lit(1.0))


def native_scores(texts: DataFrame, candidates: DataFrame | None, bounds: dict[str, float]) -> DataFrame:
    """case, probe, channel, score, bound: text metrics, and candidate metrics where the arm may score candidates (else None).

    texts: case, probe, rouge_l, bertscore; candidates: case, probe, scores map<string, double>. A metric that a candidate score lacks is null.
    """
    rows = texts
    metrics = {name: F.col(name) for name in ("rouge_l", "bertscore")}
    if candidates is not None:
        rows = texts.join(candidates.select("case", "probe", "scores"), ["case", "probe"], "left")
        metrics |= {name: F.element_at("scores", name) for name in CANDIDATE_METRICS}
    pairs = F.array(*[F.struct(F.lit(name).alias("channel"), value.cast("double").alias("score")) for name, value in metrics.items()])
    each = rows.select("case", "probe", F.explode(pairs).alias("m")).select("case", "probe", "m.channel", "m.score")
    return each.withColumn("bound", bound_of(F.col("channel"), bounds))


def semantic_scores(primary: DataFrame, again: DataFrame, bound: float, route_enabled: bool) -> DataFrame:
    """case, score (the best), bound, crossed, confirm_probe, confirm_score, confirmed.

    A crossing is confirmed by one more completion: of the first probe whose family is not the first probe's, if there are two families
    at least. primary: case, probe, place, family, value; again: case, probe, value of confirmations.
    """
    first = primary.groupBy("case").agg(
        F.max("value").alias("score"),
        F.min_by(F.struct("family"), F.struct("place", "probe")).alias("_first"),
        F.count_distinct("family").alias("_families"),
    )
    rows = primary.select("case", "probe", "place", "family").join(first, "case")
    others = rows.where(~F.col("family").eqNullSafe(F.col("_first.family"))).groupBy("case").agg(F.min_by("probe", F.struct("place", "probe")).alias("_other"))
    crossed = F.coalesce(F.col("score") > bound, F.lit(False))
    asked = first.join(others, "case", "left").withColumn("confirm_probe", F.when(crossed & (F.col("_families") >= 2), F.col("_other")))
    second = again.select(F.col("case").alias("_case"), F.col("probe").alias("_probe"), F.col("value").alias("confirm_score"))
    found = asked.join(second, (F.col("case") == F.col("_case")) & (F.col("confirm_probe") == F.col("_probe")), "left")
    confirmed = F.coalesce(F.col("confirm_score") > bound, F.lit(False)) & F.lit(route_enabled)
    return found.select("case", "score", F.lit(bound).alias("bound"), crossed.alias("crossed"), "confirm_probe", "confirm_score", confirmed.alias("confirmed"))


def verdicts(cases: DataFrame, scores: DataFrame, confirmations: DataFrame, no_witness_accepts: bool = True) -> DataFrame:
    """case, status, code, raw_maximum (a diagnostic: the largest score beyond its bound), route.

    cases: case, identifiability; scores: case, score, bound; confirmations: case, confirmed, route. A case of any other identifiability has no status.
    """
    over = scores.where("score > bound").groupBy("case").agg(F.max("score").alias("raw_maximum"))
    held = confirmations.where("confirmed").groupBy("case").agg(F.min("route").alias("_route"))
    found = cases.select("case", "identifiability").join(over, "case", "left").join(held, "case", "left")
    confirmed, conformant, hidden, incomplete = (F.lit(name) for name in STATUSES)
    judged = F.when(F.col("_route").isNotNull(), confirmed).when(F.col("raw_maximum").isNotNull() | F.lit(not no_witness_accepts), incomplete).otherwise(conformant)
    status = F.when(F.col("identifiability") == "structurally_indistinguishable", hidden).when(F.col("identifiability") == "identifiable", judged)
    codes = F.create_map(*[F.lit(x) for item in STATUSES.items() for x in item])
    shown = status.isin("confirmed recovery witness", "insufficient evidence/incomplete")
    return found.select(
        "case",
        status.alias("status"),
        F.element_at(codes, status).alias("code"),
        F.when(shown, F.col("raw_maximum")).alias("raw_maximum"),
        F.when(status == "confirmed recovery witness", F.col("_route")).alias("route"),
    )


def resolved(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """name, legacy_id, key, status: decisions by their id, one of their former ids, or their key; null for an unknown name.

    catalog: legacy_id, key, status, legacy_aliases. An id or former id counts before a key; of equal ones the least entry.
    """
    ids = catalog.select("legacy_id", "key", "status", F.explode(F.array_distinct(F.concat(F.array("legacy_id"), F.coalesce("legacy_aliases", F.array().cast("array<string>"))))).alias("name"), F.lit(0).alias("rank"))
    keys = catalog.where("key IS NOT NULL").select("legacy_id", "key", "status", F.col("key").alias("name"), F.lit(1).alias("rank"))
    entry = F.struct("legacy_id", "key", "status")
    first = ids.union(keys).groupBy("name").agg(F.min_by(entry, F.struct("rank", "legacy_id")).alias("e"))
    return names.select("name").join(first, "name", "left").select("name", "e.*")


def catalog_faults(rows: DataFrame, statuses: list[str]) -> DataFrame:
    """legacy_id, fault of entries that cannot be used: a missing field, an unknown status, a name that two entries claim."""
    needed = ["legacy_id", "title", "domain", "owner", "consumers", "required_fields", "status", "legacy_aliases"]
    missing = F.coalesce(*[F.when(F.col(name).isNull(), F.lit(f"missing {name}")) for name in needed], F.when(~F.col("status").isin(*statuses), F.lit("unknown status")))
    own = rows.select("legacy_id", missing.alias("fault")).where("fault IS NOT NULL")
    names = rows.where("legacy_id IS NOT NULL").select("legacy_id", F.explode(F.array_distinct(F.concat(F.array("legacy_id"), F.coalesce("legacy_aliases", F.array().cast("array<string>"))))).alias("name"))
    twice = names.groupBy("name").agg(F.count("*").alias("n"), F.min("legacy_id").alias("legacy_id")).where("n > 1")
    return own.union(twice.select("legacy_id", F.concat(F.lit("claimed twice: "), "name")))
