"""Operator 6: removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every byte that a ``length``-byte string covers is removed if the same string starts earlier (a smaller id, or earlier in
the same document). Matches never cross documents and are judged on the input.

A window of ``length`` bytes selects the least of its GRAM-byte gram hashes (the leftmost of equals). The choice depends on
the window's bytes only, so equal windows select equal grams at the same offset. Each run of windows that select one gram is a
context. Contexts go to the task of their gram: those that equal an earlier context (by two independent 64-bit hashes) are covered as a
whole, grams with one distinct context hold no repeat, and only distinct contexts of one gram fetch their bytes.
There, for batches of whole grams, the transform of all contexts is built (suffixes sorted by their first ``length``
bytes), and intervals of single bytes are extended backwards one byte at a time, breadth first. Every extension that
ends at a fresh place sets a boundary with the common prefix of that level; the expansion stops at ``length``. Rows without a
boundary between them share ``length`` bytes; all but the earliest window of such a class are covered.

A gram in many contexts within one task leaves it once per distinct context (combined before the shuffle). A gram with more than HOT
distinct contexts is split into its single windows, which are compared by a 128-bit hash of their bytes, combined in the same way.

Null or empty text: no bytes, nothing removed. A null id counts as larger than all others. Rows that repeat an id are documents of
their own, ordered by their texts. An empty table gives no row. Only the two named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .kernels import BYTE_VALUE, INVERSE, MULTIPLIER, POWER, mixed

LENGTH, GRAM = 100, 28
#: Window starts of a document that are looked at together; positions inside must fit 20 bits.
BLOCK = 1 << 18
#: Contexts that a task gathers before it combines them.
FLUSH = 1 << 18
#: Bytes of contexts that go into one transform, and distinct contexts from which a gram is split.
BATCH_BYTES, HOT = 1 << 20, 4096
#: Up to so many rows of 32 bytes may be broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000
SEPARATOR = 0xFF  # never a byte of UTF-8
COVER, FETCH = 0, 1
#: For the second hash: a value for each pair of neighbouring bytes, and powers of a multiplier of its own.
PAIR_VALUE = np.random.Generator(np.random.PCG64(20240301)).integers(1, 2**63, 1 << 16, dtype=np.uint64)
SECOND = np.uint64(0xD6E8FEB86659FD93)
with np.errstate(over="ignore"):
    SECOND_POWER = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full((1 << 19) - 1, SECOND))))
    SECOND_INVERSE = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full((1 << 19) - 1, np.uint64(pow(int(SECOND), -1, 1 << 64))))))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys (block prefixes and suffixes)."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    table = padded.reshape(blocks, width)
    prefix = np.minimum.accumulate(table, 1).ravel()
    suffix = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - width + 1], prefix[width - 1 : n])


def contexts(text: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """gram hash, two context hashes, first window, number of windows of each context of a text.

    The first hash is a polynomial over bytes, the second one over pairs of neighbouring bytes with another multiplier.
    """
    data = np.frombuffer(text, np.uint8)
    found = []
    for begin in range(0, len(data) - length + 1, BLOCK):
        part = data[begin : begin + BLOCK + length - 1]
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(BYTE_VALUE[part] * POWER[: len(part)], out=sums[1:])
            grams = mixed((sums[gram:] - sums[:-gram]) * INVERSE[: len(part) - gram + 1])
            keys = (grams & ~np.uint64(0xFFFFF)) | np.arange(len(grams), dtype=np.uint64)
            chosen = (sliding_least(keys, length - gram + 1) & np.uint64(0xFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.diff(chosen, prepend=-1))
            count = np.diff(first, append=len(chosen))
            place = chosen[first]
            whole = (sums[first + count + length - 1] - sums[first]) * INVERSE[first]
            shape = ((count.astype(np.uint64) << np.uint64(32)) + (place - first).astype(np.uint64)) * MULTIPLIER
            pairs = (part[:-1].astype(np.uint16) << 8) | part[1:]
            np.cumsum(PAIR_VALUE[pairs] * SECOND_POWER[: len(pairs)], out=sums[1:-1])
            second = (sums[first + count + length - 2] - sums[first]) * SECOND_INVERSE[first]
            found.append((grams[place], mixed(mixed(whole) + shape), mixed(mixed(second) ^ shape), first + begin, count))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.uint64),) * 3 + (np.empty(0, np.int64),) * 2


COLUMNS = ["kind", "gram", "context", "second", "doc_at", "copy", "first", "windows"]
TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
ROWS = "kind int, gram long, context long, second long, doc_at long, copy int, first long, windows int"


def to_batch(columns: list[np.ndarray], names: list[str] = COLUMNS) -> pa.RecordBatch:
    kinds = dict(zip(COLUMNS, TYPES))
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), kinds[n]) for c, n in zip(columns, names)], names)


def combine(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Of equal contexts the first is kept to be compared; the others are covered."""
    grams, ctx, second, doc, copy, first, count = (np.concatenate(c) for c in zip(*parts))
    grams, ctx, second = grams.view(np.int64), ctx.view(np.int64), second.view(np.int64)
    order = np.lexsort((first, copy, doc, second, ctx, grams))
    grams, ctx, second, doc, copy, first, count = (c[order] for c in (grams, ctx, second, doc, copy, first, count))
    later = np.concatenate(([False], (grams[1:] == grams[:-1]) & (ctx[1:] == ctx[:-1]) & (second[1:] == second[:-1])))
    # a covered row has done with its gram: it travels under a key of its document
    with np.errstate(over="ignore"):
        key = np.where(later, mixed(doc.astype(np.uint64)).view(np.int64), grams)
    return to_batch([np.where(later, COVER, FETCH), key, np.where(later, 0, ctx), np.where(later, 0, second), doc, copy, first, count])


def context_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Contexts of all texts. Of equal ones in a task the first is kept to be compared; the others are covered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for doc, copy, text in zip(batch.column("doc_at").to_pylist(), batch.column("copy").to_pylist(), shared.texts_of(batch, "text")):
                if len(text) < length:
                    continue
                grams, ctx, second, first, count = contexts(text, length, gram)
                parts.append((grams, ctx, second, np.full(len(first), doc), np.full(len(first), copy), first, count))
                held += len(first)
                if held >= FLUSH:
                    yield combine(parts)
                    parts, held = [], 0
        if parts:
            yield combine(parts)

    return docs.mapInArrow(run, ROWS)


def compared(rows: DataFrame) -> DataFrame:
    """kind COVER: a context that equals an earlier one, FETCH: the first of a distinct context of a gram that has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the first row of the latest context; sent: whether it has gone out
        sent = False
        for batch in batches:
            new = [batch.column(c).to_numpy() for c in COLUMNS]
            done = new[0] == COVER
            out = [[c[done] for c in new]]
            new = [c[~done] for c in new]
            ghost = held is not None
            if ghost:
                new = [np.concatenate([h, c]) for h, c in zip(held, new)]
            _, grams, ctx, second, *_ = new
            if len(grams):
                fresh_gram = np.concatenate(([True], grams[1:] != grams[:-1]))
                fresh = fresh_gram | np.concatenate(([True], (ctx[1:] != ctx[:-1]) | (second[1:] != second[:-1])))
                out.append([np.full((~fresh).sum(), COVER), *[c[~fresh] for c in new[1:]]])
                start = np.flatnonzero(fresh_gram)
                several = np.add.reduceat(fresh.astype(np.int64), start) > 1
                if ghost and sent:
                    several[0] = True
                going = fresh & np.repeat(several, np.diff(start, append=len(grams)))
                if ghost and sent:
                    going[0] = False
                out.append([c[going] for c in new])
                latest = np.flatnonzero(fresh)[-1]
                held, sent = [c[latest : latest + 1] for c in new], bool(several[-1])
            yield to_batch([np.concatenate(c) for c in zip(*out)])

    return rows.repartition("gram").sortWithinPartitions("gram", "context", "second", "doc_at", "copy", "first").mapInArrow(run, ROWS)


def sorted_suffixes(data: np.ndarray, depth: int) -> np.ndarray:
    """Places in ``data`` ordered by their next ``depth`` bytes at least (prefix doubling from 8 bytes on)."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key |= padded[k : k + n] << np.uint64(56 - 8 * k)
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(fresh)
    known = 8
    while known < depth and not fresh.all():
        # only places in groups of several still move
        alone = fresh & np.concatenate((fresh[1:], [True]))
        at = np.flatnonzero(~alone)
        place = order[at]
        ahead = np.zeros(len(place), np.int64)
        inside = place + known < n
        ahead[inside] = rank[place[inside] + known]
        pair = rank[place] * (n + 1) + ahead
        again = np.argsort(pair, kind="stable")
        order[at] = place[again]
        pair = pair[again]
        split = np.ones(n, bool)
        split[at] = np.concatenate(([True], pair[1:] != pair[:-1]))
        fresh |= split
        # a place's rank is the number of its group's first row, so ranks of groups that stay together don't change
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(1, n + 1), 0))
        known *= 2
    return order


def boundaries(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each row of the suffix order, whether it shares less than ``length`` bytes with the row before.

    Intervals of rows are extended backwards, all of one string length at a time; one that ends at a place without a boundary
    sets it and goes on.
    """
    n = len(data)
    last = data[order - 1]  # the transform; the suffix from 0 gets the final separator
    step = np.empty(n, np.int64)
    step[np.argsort(last, kind="stable")] = np.arange(n)
    counts = np.bincount(data, minlength=256)
    ends = np.cumsum(counts)
    lo, hi = (ends - counts)[counts > 0], ends[counts > 0]
    bound = np.zeros(n + 1, bool)
    bound[0] = True
    bound[hi] = True
    for _ in range(length - 1):
        if not len(lo):
            break
        size = hi - lo
        rows = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
        key = (np.repeat(np.arange(len(lo)), size) << 8) | last[rows]
        by = np.argsort(key, kind="stable")
        key, target = key[by], step[rows[by]]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        lo, hi = target[first], target[np.append(first[1:], len(key)) - 1] + 1
        fresh = ~bound[hi]
        lo, hi = lo[fresh], hi[fresh]
        bound[hi] = True
    return bound[:n]


def covered_windows(rows: list[tuple[int, int, int, bytes]], length: int) -> list[tuple[int, int, int, int]]:
    """(doc, copy, first, windows) of the later ones of equal windows. rows: doc, copy, first window, bytes."""
    rows = sorted(rows, key=lambda r: r[:3])
    sizes = np.array([len(r[3]) for r in rows])
    data = np.frombuffer(b"".join(r[3] + bytes([SEPARATOR]) for r in rows), np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(rows)), sizes + 1)
    offset = np.arange(len(data)) - begin[owner]
    order = sorted_suffixes(data, length)
    group = np.cumsum(boundaries(data, order, length))
    whole = offset[order] <= sizes[owner[order]] - length
    at, group = order[whole], group[whole]  # contexts stand in the order of their windows, so the least place is the earliest
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    earliest = np.repeat(np.minimum.reduceat(at, start), np.diff(start, append=len(at)))
    later = np.sort(at[at > earliest])
    if not len(later):
        return []
    fresh = np.flatnonzero(np.concatenate(([True], later[1:] != later[:-1] + 1)))  # separators keep contexts apart
    count = np.diff(fresh, append=len(later))
    return [(*rows[owner[p]][:2], rows[owner[p]][2] + int(offset[p]), int(c)) for p, c in zip(later[fresh], count)]


def window_rows(located: DataFrame, length: int) -> DataFrame:
    """Single windows of hot grams by a 128-bit hash of their bytes. Of equal ones in a task the first is kept to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for doc, copy, text, wanted in zip(batch.column("doc_at").to_pylist(), batch.column("copy").to_pylist(), shared.texts_of(batch, "text"), batch.column("wanted").to_pylist()):
                at = [s for w in wanted for s in range(w["first"], w["first"] + w["windows"])]
                name = np.frombuffer(b"".join(hashlib.blake2b(text[s : s + length], digest_size=16).digest() for s in at), "<u8").reshape(-1, 2)
                parts.append((name[:, 0], name[:, 1], np.zeros(len(at), np.uint64), np.full(len(at), doc), np.full(len(at), copy), np.array(at, np.int64), np.ones(len(at), np.int64)))
                held += len(at)
                if held >= FLUSH:
                    yield combine(parts)
                    parts, held = [], 0
        if parts:
            yield combine(parts)

    return located.mapInArrow(run, ROWS)


def expanded(needs: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """doc_at, copy, first, windows that the transform finds covered."""
    hot = shared.staged(needs.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("gram"), "hot")
    few = needs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def located(rows: DataFrame) -> DataFrame:
        listed = rows.groupBy("doc_at", "copy").agg(F.collect_list(F.struct("gram", "first", "windows")).alias("wanted"))
        return docs.join(F.broadcast(listed) if few else listed, ["doc_at", "copy"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, copy, text, wanted in zip(batch.column("doc_at").to_pylist(), batch.column("copy").to_pylist(), shared.texts_of(batch, "text"), batch.column("wanted").to_pylist()):
                for w in wanted:
                    first, windows = w["first"], w["windows"]
                    out.append((w["gram"], doc, copy, first, text[first : first + windows + length - 1]))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "doc_at", "copy", "first", "bytes"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_at", "copy", "first", "windows"]
        held: list[tuple[int, int, int, bytes]] = []
        size, gram = 0, None

        def done() -> pa.RecordBatch:
            found = covered_windows(held, length)
            return to_batch([np.array(c, np.int64) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 4, names)

        for batch in batches:
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("gram", "doc_at", "copy", "first", "bytes"))):
                if g != gram and size >= BATCH_BYTES:
                    yield done()
                    held, size = [], 0
                gram = g
                held.append(tuple(row))
                size += len(row[3])
        if held:
            yield done()

    bytes_of = located(needs.join(hot, "gram", "left_anti")).mapInArrow(fetch, "gram long, doc_at long, copy int, first long, bytes binary")
    found = bytes_of.repartition("gram").sortWithinPartitions("gram").mapInArrow(expand, "doc_at long, copy int, first long, windows int")
    if hot.isEmpty():
        return found
    single = compared(window_rows(located(needs.join(hot, "gram", "left_semi")), length))
    return found.union(single.where(f"kind = {COVER}").select("doc_at", "copy", "first", "windows"))


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, doc_at, copy, text: copy tells rows of one id apart; texts are shuffled for it only if there are such rows."""
    docs = shared.id_and_text(docs, id_col, text_col).withColumn("doc_at", F.coalesce("doc_id", F.lit(2**63 - 1)))
    if docs.groupBy("doc_at").count().where("count > 1").isEmpty():
        return docs.withColumn("copy", F.lit(0))
    number = F.row_number().over(Window.partitionBy("doc_at").orderBy(F.col("text").asc_nulls_first()))
    return shared.staged(docs.withColumn("copy", number - 1), "numbered")


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_at, copy, spans array<struct<first, windows>>: window starts that are covered, for documents with any."""
    rows = shared.staged(compared(context_rows(docs, length, gram)), "contexts")
    found = expanded(rows.where(f"kind = {FETCH}"), docs, length)
    every = rows.where(f"kind = {COVER}").select("doc_at", "copy", "first", "windows").union(found)
    return every.groupBy("doc_at", "copy").agg(F.collect_list(F.struct("first", "windows")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of each row of ``docs``."""
    docs = identified(docs, id_col, text_col)
    joined = docs.join(removed_spans(docs, length, gram), ["doc_at", "copy"], "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(shared.texts_of(batch, "text"), batch.column("spans")):
                if not spans.is_valid:
                    out.append((len(text), 0, 0, text))
                    continue
                first, windows = (np.asarray(spans.values.field(c)) for c in ("first", "windows"))
                order = np.argsort(first)
                begin, end = first[order], np.maximum.accumulate((first + windows + length - 1)[order])
                fresh = np.concatenate(([True], begin[1:] > end[:-1]))
                begin, end = begin[fresh], end[np.append(np.flatnonzero(fresh)[1:] - 1, len(end) - 1)]
                kept = b"".join(text[a:b] for a, b in zip([0, *end], [*begin, len(text)]))
                out.append((len(text), len(text) - len(kept), len(begin), kept))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), [pa.int64()] * 3 + [pa.binary()])] if out else [pa.array([], k) for k in [pa.int64()] * 3 + [pa.binary()]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(shared.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as hexadecimal text; windows are cut from overlapping blocks of 500.
ORACLE_SQL = {
    "op6_suffix_dedup": r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
b AS (SELECT doc_id, n, base, substr(h, 2 * base + 1, 2 * 599) AS h FROM (SELECT doc_id, n, h, unnest(range(0, n - 99, 500)) AS base FROM t)),
w AS (SELECT doc_id, base + k AS i, md5(substr(h, 2 * k + 1, 200)) AS key FROM (SELECT doc_id, base, h, unnest(range(0, least(500, n - 99 - base))) AS k FROM b)),
c AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, i) > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c)),
s AS (SELECT doc_id, span, min(i) AS first, max(i) + 100 AS last FROM g GROUP BY doc_id, span),
e AS (SELECT *, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY first), 0) AS since FROM s),
r AS (SELECT doc_id, sum(last - first) AS n_removed, count(*) AS n_spans, max(last) AS tail, string_agg(substr(h, 2 * since + 1, 2 * (first - since)), '' ORDER BY first) AS head FROM e JOIN t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN tail IS NULL THEN h ELSE head || substr(h, 2 * tail + 1) END)) AS kept_sha256 FROM t LEFT JOIN r ON t.doc_id = r.doc_id
"""
}
