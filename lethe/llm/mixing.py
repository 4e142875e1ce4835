"""Operator 7 [native]: mixing sources to target weights by hash-threshold histograms.

Each document has a hash of LEVELS * LEVEL_BITS bits. A source whose target is c whole copies and a rest takes every
document c times, and once more those whose hash lies below the source's threshold. The threshold is found without
sorting: words are summed by source and hash bucket, the bucket in which the budget ends is refined by the next bits,
and so on. The last cell, a document or documents with the very same hash, is cut to the words that are still missing,
so a source meets its target to the word. Thresholds are nested: a larger budget only adds documents.

A word is a maximal run of other characters than space and \\x09-\\x0D. Weights go to the sources in code point order,
null last, and repeat. Targets share ``share`` times all words by weight and stop at ``most`` times the source's words;
the excess is shared by weight among the others until none is above (that is: min(most * size, rate * weight) with the
one rate that uses up the budget). Null text: no words. A null id hashes like the text "null". Rows that repeat an id and
have one hash share the last cell in equal parts. A source without words has target 0. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
LEVELS, LEVEL_BITS = 4, 13
#: Documents are joined with their source's row by source and salt, so that one source's documents spread.
SALTS = 64
WORD = r"[^\x20\x09-\x0D]+"


def hash_of(id_col: Column) -> Column:
    """52 bits of MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("null"))), 1, 13), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, hash: one narrow pass over the texts."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), hash_of(F.col(id_col)).alias("hash"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target. One row per source goes through one task; nothing here grows with the documents."""
    ranked = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    cap = F.col("source_size") * F.lit(most)
    found = ranked.select("source", "source_size", weight.alias("weight"), cap.alias("cap"))
    # capped sources are those with the smallest cap / weight; given the first k, the rest share what is left at one rate
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    rated = found.withColumn("rate", left / open_weight)
    # the first source that its rate does not fill up sets the rate of all
    final = F.coalesce(F.min(F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rate"))).over(everything)["rate"], F.lit(float("inf")))
    return rated.select("source", "source_size", F.least("cap", F.when(final == float("inf"), F.col("cap")).otherwise(final * F.col("weight"))).alias("target"))


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, source_size, target, copies, threshold (hashes below it go in once more), missing (words that the cell at
    it still gives) and cell (words of that cell)."""
    spark = sizes.sparkSession
    whole = F.floor(F.col("target").cast("double")).cast("long")
    copies = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    state = wanted.select("source", "source_size", "target", copies.alias("copies"), (whole - copies * F.col("source_size")).alias("missing"), F.lit(0).cast("long").alias("threshold"), F.lit(0).cast("long").alias("cell"))
    state = shared.staged(state, "mix-targets")
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        rows = sizes if level == 0 else matched(sizes, state.select("source", "threshold")).where(F.call_function("shiftright", F.col("hash"), F.lit(shift + LEVEL_BITS)) == F.call_function("shiftright", F.col("threshold"), F.lit(shift + LEVEL_BITS)))
        cell = F.call_function("shiftright", F.col("hash"), F.lit(shift))
        counts = rows.groupBy("source", cell.alias("bucket")).agg(F.sum("size").alias("words")).where("words > 0")
        running = Window.partitionBy("source").orderBy("bucket")
        summed = counts.withColumn("upto", F.sum("words").over(running)).withColumnRenamed("source", "of")
        ends = state.join(summed, F.col("source").eqNullSafe(F.col("of")) & (F.col("upto") > F.col("missing")))
        first = ends.groupBy("source").agg(F.min(F.struct("bucket", "words", "upto")).alias("end")).withColumnRenamed("source", "of")
        joined = state.join(first, F.col("source").eqNullSafe(F.col("of")), "left")
        bucket = F.coalesce(F.call_function("shiftleft", F.col("end.bucket"), F.lit(shift)), F.col("threshold"))
        state = shared.staged(
            joined.select(
                "source", "source_size", "target", "copies",
                F.coalesce(F.col("missing") - F.col("end.upto") + F.col("end.words"), "missing").alias("missing"),
                bucket.alias("threshold"), F.coalesce("end.words", F.lit(0)).cast("long").alias("cell"),
            ),
            "mix-level",
        )
    return state


def matched(sizes: DataFrame, by_source: DataFrame) -> DataFrame:
    """Each document with its source's row; a source's documents spread over SALTS groups."""
    salted = by_source.withColumnRenamed("source", "of").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return sizes.join(salted, F.col("source").eqNullSafe(F.col("of")) & ((F.col("hash") % SALTS).cast("int") == F.col("salt"))).drop("of", "salt")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, **columns: str) -> DataFrame:
    """doc_id, source, size, hash, source_size, target, taken for each row of ``docs``."""
    sizes = shared.staged(sized(docs, **columns), "mix-sizes")
    found = matched(sizes, thresholds(sizes, targets(sizes, weights, share, most)))
    extra = (
        F.when(F.col("hash") < F.col("threshold"), F.col("size"))
        .when((F.col("hash") == F.col("threshold")) & (F.col("cell") > 0), F.floor(F.col("size") * F.col("missing") / F.col("cell")).cast("long"))
        .otherwise(0)
    )
    return found.select("doc_id", "source", "size", "hash", "source_size", "target", (F.col("copies") * F.col("size") + extra).alias("taken"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(shared.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes it; the document that is cut goes in whole if half of it is taken.

    Only the thresholds travel to the texts.
    """
    sizes = shared.staged(sized(docs, id_col, text_col, source_col), "mix-sizes")
    found = thresholds(sizes, targets(sizes, weights, share, most)).select(*[F.col(c).alias(f"_mix_{c}") for c in ("source", "copies", "threshold", "missing", "cell")])
    salted = found.withColumn("_mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hashed = docs.withColumn("_mix_hash", hash_of(F.col(id_col)))
    joined = hashed.join(salted, F.col(source_col).cast("string").eqNullSafe(F.col("_mix_source")) & ((F.col("_mix_hash") % SALTS).cast("int") == F.col("_mix_salt")))
    last = (F.col("_mix_hash") == F.col("_mix_threshold")) & (F.col("_mix_missing") * 2 >= F.col("_mix_cell")) & (F.col("_mix_cell") > 0)
    times = F.col("_mix_copies") + ((F.col("_mix_hash") < F.col("_mix_threshold")) | last).cast("long")
    repeated = joined.withColumn("_mix_times", times).where("_mix_times > 0").withColumn("_mix_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_times"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = {
    "op7_mix_sources": r"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS hash FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
  CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM g),
r AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w),
f AS (SELECT rate AS final FROM r WHERE rate * weight <= cap ORDER BY cap / weight, rate LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT final FROM f) * weight, cap)) AS target FROM r),
m AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
c AS (SELECT source, hash, sum(size) AS cell FROM s GROUP BY ALL),
u AS (SELECT source, hash, cell, sum(cell) OVER (PARTITION BY source ORDER BY hash) - cell AS before FROM c),
j AS (SELECT s.doc_id, s.size, m.source_size, m.target, m.copies, CAST(floor(m.target) AS BIGINT) - m.copies * m.source_size AS missing, u.cell, u.before
  FROM s JOIN m ON s.source IS NOT DISTINCT FROM m.source JOIN u ON s.source IS NOT DISTINCT FROM u.source AND s.hash = u.hash)
SELECT doc_id, size, source_size, target, CAST(copies * size + CASE WHEN before + cell <= missing THEN size WHEN before < missing AND cell > 0
  THEN floor(CAST(size AS DOUBLE) * (missing - before) / cell) ELSE 0 END AS BIGINT) AS taken FROM j
"""
}
