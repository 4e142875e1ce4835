"""String functions: Spark SQL functions, and one Arrow helper for the longest common subsequence."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def folded(text: Column) -> Column:
    """Lower case with sharp s as ss, so that both spellings meet. Ligatures and the final sigma stay as they are."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def slugify(*parts: Column) -> Column:
    """Parts joined by ``_``, lower case, runs of other characters than a-z and 0-9 as one ``_``; null if nothing is left."""
    joined = F.regexp_replace(folded(F.concat_ws("_", *parts)), "[^a-z0-9]+", "_")
    slug = F.btrim(joined, F.lit("_"))
    return F.when(slug != "", slug)


def normalise(text: Column) -> Column:
    """Folded, white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(folded(text), r"\s+", " "))


def span_status(text: Column, value: Column, start: Column, end: Column) -> Column:
    """exact, repaired or span_unresolved for a half-open span, counted from 0, that should hold ``value``."""
    return F.when(F.substring(text, start + 1, end - start) == value, "exact").when(F.contains(text, value), "repaired").otherwise("span_unresolved")


def words(text: Column) -> Column:
    """White-space words; none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def subsequence_length(left: list[str], right: list[str]) -> int:
    """Length of the longest common subsequence: a row of the table is one integer, a bit per word of ``left``."""
    masks: dict[str, int] = {}
    for k, word in enumerate(left):
        masks[word] = masks.get(word, 0) | 1 << k
    full = (1 << len(left)) - 1
    row = full
    for word in right:
        if mask := masks.get(word):
            hit = row & mask
            row = (row + hit | row - hit) & full
    return len(left) - row.bit_count()


def rouge_l(hypothesis: Column, reference: Column) -> Column:
    """F-measure of the longest common word subsequence; 0 if either text has no words."""

    @F.pandas_udf(LongType())
    def common(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([subsequence_length(list(a), list(b)) for a, b in zip(left, right)], dtype="int64")

    left, right = words(hypothesis), words(reference)
    some = (F.size(left) > 0) & (F.size(right) > 0)
    return F.when(some, 2.0 * common(left, right) / (F.size(left) + F.size(right))).otherwise(F.lit(0.0))


def filled(template: Column, **values: Column) -> Column:
    """``template`` with ``{name}`` replaced by each value; a null value leaves its mark."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("{" + name + "}")))
    return template


def without_surfaces(text: Column, surfaces: Column) -> Column:
    """``text`` without any of the array ``surfaces``, longest first (ties: by code point); blank and null ones remove nothing."""
    some = F.filter(F.array_distinct(surfaces), lambda s: s.isNotNull() & (s != ""))
    ranked = F.array_sort(F.transform(some, lambda s: F.struct((-F.char_length(s)).alias("n"), s.alias("s"))))
    return F.aggregate(ranked, text, lambda left, s: F.replace(left, s["s"], F.lit("")))


def without_diacritics(text: Column) -> Column:
    """Decomposed characters without their combining marks (an Arrow helper: Spark has no such function)."""

    @F.pandas_udf("string")
    def plain(values: pd.Series) -> pd.Series:
        apart = values.str.normalize("NFKD")
        return apart.map(lambda v: v if v is None or v.isascii() else "".join(c for c in v if not unicodedata.combining(c)))

    return plain(text)


def local_id(full_id: Column) -> Column:
    """What follows the second colon; null with fewer colons."""
    found = F.regexp_extract(full_id, "^[^:]*:[^:]*:(.*)$", 1)
    return F.when(full_id.rlike("^[^:]*:[^:]*:"), found)


def last_segment(full_id: Column) -> Column:
    return F.substring_index(full_id, ":", -1)


def short_name(job: Column, prefix: str) -> Column:
    """``job`` without a leading ``prefix``, up to the first hyphen that is not the sign of an exponent."""
    return F.regexp_extract(F.regexp_replace(job, f"^{prefix}", ""), r"^(?:[^-]|(?<=[0-9]e)-)*", 0)


def qa_text(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Q: "), question, F.lit("\nA: "), answer)


def qa_pairs_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, number, question, answer of each text of ``Q: `` lines that an ``A: `` line may follow.

    The line after a question is used up whatever it is, so of questions in a row every second one counts; a question
    without an answer has an empty one. Blank and null texts have no pairs.
    """
    lines = texts.select(key, F.posexplode(F.transform(F.split(F.btrim(text, F.lit(" \t\n\r")), "\r?\n"), lambda x: F.btrim(x, F.lit(" \t")))).alias("line", "value"))
    order = Window.partitionBy(key).orderBy("line")
    ahead = lines.withColumn("next", F.lead("value").over(order))
    asked = ahead.where(F.startswith("value", F.lit("Q: ")))
    run = asked.withColumn("run", F.col("line") - F.row_number().over(order))
    kept = run.withColumn("at", F.row_number().over(Window.partitionBy(key, "run").orderBy("line"))).where("at % 2 = 1")
    answer = F.when(F.startswith("next", F.lit("A: ")), F.substr("next", F.lit(4))).otherwise("")
    return kept.select(key, (F.row_number().over(order) - 1).cast("long").alias("number"), F.substr("value", F.lit(4)).alias("question"), answer.alias("answer"))


def json_part(raw: Column) -> Column:
    """The JSON in a model's answer: without code fences; the outermost brackets if it starts with neither bracket nor brace."""
    bare = F.btrim(F.regexp_replace(raw, "```(?:json)?", ""), F.lit(" \t\n\r"))
    return F.when(bare.rlike(r"^[\[{]"), bare).otherwise(F.nullif(F.regexp_extract(bare, r"(?s)\[.*\]", 0), F.lit("")))


def canonical_json(**fields: Column) -> Column:
    """A compact JSON object with its keys in order, so that equal contents give equal texts; null fields stay as null."""
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]), {"ignoreNullFields": "false"})


def identity(**fields: Column) -> Column:
    """SHA-256 of the canonical JSON of ``fields``."""
    return F.sha2(canonical_json(**fields), 256)


def real_text(value: Column) -> Column:
    """A number as text; NaN as a token of its own, null as null."""
    return F.when(F.isnan(value), F.lit("NaN")).otherwise(value.cast("string"))


def real_value(text: Column) -> Column:
    """The number behind ``real_text``; null for any other text."""
    return F.when(text == "NaN", F.lit(float("nan"))).otherwise(text.try_cast("double"))
