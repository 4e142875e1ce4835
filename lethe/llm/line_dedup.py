"""Operator 4 [native]: line deduplication with per-document keep bitmaps.

Only DataFrame functions. Each line becomes a 128-bit key hash. The hashes are range-partitioned with a secondary
sort by document and position; a running window streams the first document of each key past its later lines.
Keys that hold over 1/HOT_SHARE of all lines (so at most HOT_SHARE keys) would fill a task: their first document is
pre-aggregated and broadcast instead. What comes back is a bitmap per document with a dropped line (64-bit words in chunks, looked up
by position; chunks without a dropped line are empty, and nothing follows the last one), never text; ``apply_bitmaps`` puts it to use.

Null or empty text: one empty line, kept. A null id counts as larger than all others. Rows that repeat an id
belong to one document; equal lines of one document all stay if no smaller id holds them. Lines whose key is shorter than ``min_chars``
code points always stay. An empty table gives no row. Only the two named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS, HOT_SHARE = 1 << 16, 1000
#: 64-bit words in a chunk of a bitmap.
WORDS = 512
LAST = 2**63 - 1


def line_key(line: Column) -> Column:
    """Stripped and with A-Z lower-cased; pure ASCII takes the quick built-in."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWERED))


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return shared.id_and_text(docs, id_col, text_col).select(
        "doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc_at"), F.coalesce("text", F.lit("")).alias("text")
    )


def lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_at, text_at (tells rows of one id apart), position and the two halves of the key's hash."""
    # hash and split first: beside the generator they would be worked out again for each line
    whole = docs.select("doc_at", F.xxhash64("text").alias("text_at"), F.split("text", "\n", -1).alias("lines"))
    keyed = whole.select("doc_at", "text_at", F.posexplode("lines").alias("position", "line")).select("doc_at", "text_at", "position", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select("doc_at", "text_at", "position", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def hot_keys(found: DataFrame) -> DataFrame:
    """Keys that hold more than 1/HOT_SHARE of all lines, with their first document: HOT_SHARE rows at most, whatever the input.

    A histogram over coarse hash buckets (one row per bucket and task is shuffled) tells where such keys can be;
    only those buckets are counted by key.
    """
    bucket = F.col("h1").bitwiseAND(BUCKETS - 1)
    counts = found.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    full = counts.crossJoin(F.broadcast(total)).where(F.col("n") * HOT_SHARE > F.col("total")).select("bucket", "total")
    inside = found.join(F.broadcast(full), bucket == F.col("bucket"))
    keys = inside.groupBy("h1", "h2", "total").agg(F.count("*").alias("n"), F.min("doc_at").alias("first_doc"))
    return keys.where(F.col("n") * HOT_SHARE > F.col("total")).select("h1", "h2", "first_doc")


def keep_bitmaps(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_at, text_at, dropped: an array of chunks of WORDS 64-bit words, a 1 for each dropped line; for documents with a drop, up to it."""
    found = shared.staged(lines(documents(docs, id_col, text_col), min_chars), "lines")
    hot = F.broadcast(hot_keys(found))
    order = Window.partitionBy("h1", "h2").orderBy("doc_at", "position")
    spread = found.join(hot, ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2")
    streamed = spread.withColumn("first_doc", F.first("doc_at").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    columns = ["doc_at", "text_at", "position", "first_doc"]
    dropped = streamed.select(columns).union(found.join(hot, ["h1", "h2"]).select(columns)).where("doc_at > first_doc")
    words = dropped.groupBy("doc_at", "text_at", (F.col("position") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("position") % 64)).alias("bits")
    )
    chunk, at = (F.col("word") / WORDS).cast("int"), F.col("word") % WORDS
    chunks = words.groupBy("doc_at", "text_at", chunk.alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct(at, "bits"))).alias("held"), F.max(at).alias("last"))
    chunks = chunks.withColumn("bits", F.transform(F.sequence(F.lit(0), "last"), lambda k: F.coalesce(F.element_at("held", k), F.lit(0).cast("long"))))
    found = chunks.groupBy("doc_at", "text_at").agg(F.map_from_entries(F.collect_list(F.struct("chunk", "bits"))).alias("held"), F.max("chunk").alias("last"))
    none = F.array().cast("array<bigint>")
    return found.select("doc_at", "text_at", F.transform(F.sequence(F.lit(0), "last"), lambda k: F.coalesce(F.element_at("held", k), none)).alias("dropped"))


def is_dropped(position: Column) -> Column:
    word = F.get(F.get("dropped", (position / (64 * WORDS)).cast("int")), (position / 64).cast("int") % WORDS)
    return F.coalesce(F.getbit(word, position % 64) == 1, F.lit(False))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every document."""
    whole = documents(docs, id_col, text_col).withColumn("text_at", F.xxhash64("text"))
    joined = whole.join(bitmaps, ["doc_at", "text_at"], "left")
    every = F.split("text", "\n", -1)
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(every, lambda line, i: ~is_dropped(i)), "\n")
    )
    n_dropped = F.coalesce(F.aggregate(F.flatten("dropped"), F.lit(0), lambda n, bits: n + F.bit_count(bits)), F.lit(0))
    return joined.select("doc_id", F.size(every).cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), kept.alias("text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return apply_bitmaps(docs, keep_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op4_line_dedup": r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM s),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key),
d AS (SELECT k.doc_id, k.i, k.line, coalesce(f.first_doc < k.doc_id, false) AS gone FROM k LEFT JOIN f ON k.key = f.key AND length(k.key) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
}
