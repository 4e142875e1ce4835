"""Operator 11: how filters interact, by sorted posting lists.

Each document gets one bit per filter that it fails. For every part and range of row numbers, the rows that fail a filter form a
sorted posting list. Unions of lists and what a list holds beyond a union are found by galloping merges: of both lists only the
stretches that a block of the shorter one reaches are looked into. Sizes are summed over ranges. What a filter removes depends on
the set of filters before it only, so k * 2^(k-1) differences a range give the steps of all k! orders and the Shapley sums.

Only documents that fail something leave their task, as a row number and bits; texts never do. A part may hold any share of the
rows: ranges split it, and each range sends a row for each difference at most.

Null text: empty. Null part: the empty string. A null id counts as larger than all others and has no label. Rows that repeat an id
count each; they are no copies of one another for filter E, as neither id is smaller. Labels that repeat an id: any of them. An empty
table has no parts and gives no row. Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 100, 80, 10, b"#$%&*|"
CAPITALS = bytes(range(65, 91))
LAST = 2**63 - 1
#: Rows of a posting range, and of the block whose reach a gallop finds.
RANGE, BLOCK = 1 << 16, 1 << 10
#: Texts held by over 1/HOT_SHARE of all rows (HOT_SHARE at most) are broadcast with their first id, so that none fills a task.
HOT_SHARE = 1000
POSTINGS = "part string, lists array<array<long>>, good array<long>, toxic array<long>"


def text_fails(raw: bytes) -> int:
    """Bits of the filters that look at one text: A few words, B repetitive, C capitals, D symbols. bytes.split() cuts at \\x20 and \\x09-\\x0D."""
    words = raw.split()
    points = len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
        | (100 * capitals > MAX_CAPITALS * points) << 2
        | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3
    )


def signals(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """Staged: row (a number of its own), doc_id, part, fails (bits of A to D), h1 and h2 (a 128-bit hash of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(shared.texts_of(batch, "text"))
            bits = pa.array([text_fails(raw) for raw in texts], pa.int32())
            hashes = np.frombuffer(b"".join(hashlib.blake2b(raw, digest_size=16).digest() for raw in texts), "<i8").reshape(-1, 2)
            columns = [batch.column("doc_id"), batch.column("part"), bits, pa.array(hashes[:, 0]), pa.array(hashes[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "fails", "h1", "h2"])

    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    found = shared.id_and_text(docs, id_col, text_col, part=part).mapInArrow(run, "doc_id long, part string, fails int, h1 long, h2 long")
    return shared.staged(found.withColumn("row", F.monotonically_increasing_id()), "signals")


def with_copies(found: DataFrame, bit: int) -> DataFrame:
    """``found`` with ``bit`` set in fails where a smaller id holds the same text."""
    at = F.coalesce("doc_id", F.lit(LAST))
    groups = found.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).where("first < last")
    groups = shared.staged(groups, "copies")
    is_hot = F.col("n") * HOT_SHARE > F.lit(found.count())
    hot = F.broadcast(groups.where(is_hot).select("h1", "h2", "first"))
    rest = found.join(hot, ["h1", "h2"], "left_anti").join(groups.where(~is_hot).select("h1", "h2", "first"), ["h1", "h2"], "left")
    both = rest.unionByName(found.join(hot, ["h1", "h2"]))
    return both.withColumn("fails", F.col("fails").bitwiseOR(F.when(at > F.col("first"), bit).otherwise(0))).select("row", "doc_id", "part", "fails")


def posting_lists(failed: DataFrame, k: int, range_rows: int = RANGE) -> DataFrame:
    """A row for each part and range: for each of ``k`` filters the sorted rows that fail it, and those that are good or toxic.

    failed: row, part, fails (bits), good, toxic.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size, part = 0, None

        def full() -> pa.RecordBatch:
            rows, fails, good, toxic = (np.concatenate(column) for column in zip(*held))
            lists = [rows[(fails >> f & 1) > 0].tolist() for f in range(k)]
            kinds = pa.string(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64()), pa.list_(pa.int64())
            values = part, lists, rows[good].tolist(), rows[toxic].tolist()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], ["part", "lists", "good", "toxic"])

        for batch in batches:
            parts = np.array(batch.column("part").to_pylist(), object)
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "fails", "good", "toxic")]
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:]):
                while a < b:
                    if held and (parts[a] != part or size >= range_rows):
                        yield full()
                        held, size = [], 0
                    part, end = parts[a], min(b, a + range_rows - size)
                    held.append(tuple(column[a:end] for column in columns))
                    size, a = size + end - a, end
        if held:
            yield full()

    ordered = failed.select("part", "row", "fails", "good", "toxic").repartitionByRange("part", "row").sortWithinPartitions("part", "row")
    return ordered.mapInArrow(run, POSTINGS)


def gallop(ids: np.ndarray, value: int, start: int) -> int:
    """The first place from ``start`` on whose id is not below ``value``, looked for in steps that double."""
    step, end = 1, start
    while end < len(ids) and ids[end] < value:
        start, end, step = end + 1, end + step, 2 * step
    return start + int(np.searchsorted(ids[start:end], value))


def matches(few: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``few`` are in ``many``, and where each stands or would stand there. Both are sorted and distinct."""
    hit, place, at = np.zeros(len(few), bool), np.zeros(len(few), np.int64), 0
    for k in range(0, len(few), BLOCK):
        block = few[k : k + BLOCK]
        at = gallop(many, block[0], at)
        end = gallop(many, block[-1] + 1, at)
        if at < end:
            near = np.searchsorted(many[at:end], block)
            hit[k : k + BLOCK] = many[at:end][np.minimum(near, end - at - 1)] == block
            place[k : k + BLOCK] = at + near
        else:
            place[k : k + BLOCK] = at
        at = end
    return hit, place


def outside(ids: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of ``ids`` are not in ``other``; the shorter list gallops through the longer one."""
    if len(ids) <= len(other):
        return ~matches(ids, other)[0]
    out = np.ones(len(ids), bool)
    hit, place = matches(other, ids)
    out[place[hit]] = False
    return out


def union(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    few, many = sorted((one, two), key=len)
    hit, place = matches(few, many)
    return np.insert(many, place[~hit], few[~hit])


def differences(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(filter, set of filters before it, rows it removes after them, good and toxic rows among those), where it removes any."""
    k = len(lists)
    unions = {0: np.empty(0, np.int64)}
    for before in range(1 << k):
        if before:
            low = before & -before
            unions[before] = union(unions[before ^ low], lists[low.bit_length() - 1])
        for f in range(k):
            if not before >> f & 1 and len(lists[f]):
                removed = lists[f][outside(lists[f], unions[before])]
                if len(removed):
                    lost = (len(removed) - int(outside(removed, marked).sum()) for marked in (good, toxic))
                    yield f, before, len(removed), *lost


def interactions(postings: DataFrame) -> DataFrame:
    """part, filter, before (bits), removed, good, toxic: the differences of each range."""
    names = ["part", "filter", "before", "removed", "good", "toxic"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, lists, good, toxic in zip(*(batch.column(c) for c in ("part", "lists", "good", "toxic"))):
                arrays = [x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in (*lists, good, toxic)]
                found = [(part.as_py(), *row) for row in differences(arrays[:-2], *arrays[-2:])]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)

    return postings.mapInArrow(run, "part string, filter int, before int, removed long, good long, toxic long")


def audit(failed: DataFrame, totals: DataFrame, filters: str) -> DataFrame:
    """Every step of every order of ``filters`` (a letter each) in every part.

    failed: row (distinct), part, fails (bits in the order of ``filters``), good, toxic. totals: part, rows.
    """
    k, full = len(filters), (1 << len(filters)) - 1
    sums = interactions(posting_lists(failed, k)).groupBy("part", "filter", "before").agg(*[F.sum(c).alias(c) for c in ("removed", "good", "toxic")])
    entry = F.struct(F.col("filter") * (1 << k) + F.col("before"), F.struct("removed", "good", "toxic"))
    by_part = sums.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("found"))  # k * 2^(k-1) entries at most
    none = F.create_map().cast("map<int, struct<removed: bigint, good: bigint, toxic: bigint>>")
    parts = totals.join(by_part, "part", "left").withColumn("found", F.coalesce("found", none))

    def at(f: Column | int, before: Column | int, field: str = "removed") -> Column:
        return F.coalesce(F.element_at("found", F.lit(f) * (1 << k) + F.lit(before))[field], F.lit(0).cast("long"))

    orders = [
        {"order": "".join(filters[f] for f in order), "path": [{"step": i + 1, "filter": f, "before": sum(1 << g for g in order[:i])} for i, f in enumerate(order)]}
        for order in permutations(range(k))
    ]
    kind = "array<struct<order: string, path: array<struct<step: int, filter: int, before: int>>>>"
    ordered = parts.withColumn("order", F.explode(F.from_json(F.lit(json.dumps(orders)), kind)))
    summed = ordered.withColumn("gone", F.transform("order.path", lambda x: at(x["filter"], x["before"])))
    steps = summed.withColumn("at", F.explode("order.path"))
    step, f, before = F.col("at.step"), F.col("at.filter"), F.col("at.before")
    # in so many orders exactly the filters of a set stand before one that is not in it
    chances = F.array(*[F.lit(math.factorial(b.bit_count()) * math.factorial(max(0, k - 1 - b.bit_count()))) for b in range(full + 1)])
    shapley = F.aggregate(
        F.filter(F.sequence(F.lit(0), F.lit(full)), lambda b: F.getbit(b, f) == 0),
        F.lit(0).cast("long"),
        lambda total, b: total + at(f, b) * F.element_at(chances, b + 1),
    )
    return steps.select(
        "part",
        F.col("order.order").alias("filter_order"),
        step.alias("step"),
        (F.col("rows") - F.aggregate(F.slice("gone", 1, step), F.lit(0).cast("long"), lambda x, y: x + y)).alias("kept"),
        at(f, before).alias("removed"),
        (at(f, 0) - at(f, before)).alias("redundant"),
        at(f, F.lit(full) - F.call_function("shiftleft", F.lit(1), f)).alias("unique_fails"),
        at(f, before, "good").alias("good_lost"),
        at(f, before, "toxic").alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The five filters over whole texts (A to D: ``text_fails``; E: a smaller id holds the same text), audited by part."""
    found = signals(docs, id_col, text_col, part_col)
    failed = with_copies(found, 1 << FILTERS.index("E")).where("fails > 0")
    marks = labels.groupBy(F.col("doc_id").alias("doc_id")).agg(*[F.max((F.col(c) == 1).cast("int")).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))])
    marked = failed.join(marks, "doc_id", "left").withColumns({c: F.coalesce(F.col(c) == 1, F.lit(False)) for c in ("good", "toxic")})
    return audit(shared.staged(marked, "failed"), found.groupBy("part").agg(F.count("*").alias("rows")), FILTERS)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))


ORACLE_SQL = {
    "op11_filter_audit": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN coalesce(first_id < doc_id, first_id IS NOT NULL) THEN 16 ELSE 0 END AS fails
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY ALL),
o(path, used) AS (SELECT '', 0 UNION ALL SELECT path || letter, used + bit FROM o, (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit) WHERE used & bit = 0),
s AS (SELECT path AS filter_order, step, 1 << (ascii(substr(path, step, 1)) - 65) AS bit,
  list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(path, i, 1)) - 65))) AS b FROM o, range(1, 6) r(step) WHERE length(path) = 5),
m AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (WHERE fails & (coalesce(b, 0)::INT | bit) = 0), 0) AS kept,
  coalesce(sum(n) FILTER (WHERE fails & bit > 0 AND fails & coalesce(b, 0)::INT = 0), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE fails & bit > 0 AND fails & coalesce(b, 0)::INT > 0), 0) AS redundant,
  coalesce(sum(n) FILTER (WHERE fails = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (WHERE fails & bit > 0 AND fails & coalesce(b, 0)::INT = 0), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE fails & bit > 0 AND fails & coalesce(b, 0)::INT = 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM m
"""
}
