"""Operator 8: quality classifier by importance resampling (Xie et al., 2023) with Gumbel top-k.

Two generative models over hashed byte n-grams (lower-cased ASCII, GRAM bytes): one of target text (documents
labelled good and not toxic), one of raw text (all documents). An n-gram counts once per document. It falls into one bucket of each of
ROWS hash rows; of the rows' log ratios the one nearest to 0 holds, and 0 if their signs differ, so that a collision in one row does no harm.
A bucket's log ratio of target to raw is that of the end of its confidence interval (Z standard deviations of the square-root-transformed
count) which lies nearer to 1: n-grams without evidence weigh nothing, whatever the text's length. A document's log weight is
the mean of the positive ratios over its distinct n-grams plus the sum of the negative ones: length does not buy weight, nor does it
hide what speaks against a text.

The cut: k documents are drawn without replacement in proportion to weight ** SHARPNESS by Gumbel top-k; the noise is a hash of the
id, so reruns agree. k is ``budget`` (a share of all documents) if given, else the number of documents whose weight reaches the
SPARE quantile of the target documents in a holdout (every HOLDOUT-th labelled document by hash, not used by the models). The k-th
key is found by a histogram that is refined around it; nothing is sorted.

The models are fitted on LABELLED labelled rows at most, those with the smallest id hashes; raw counts, weights and the cut
cover all documents and whole texts, long ones in pieces. Without labels, target documents or documents there is no evidence and everything is kept.
Null text: no n-grams, weight 1. A null id gets the noise of its own. Rows that repeat an id are weighed each; ties at the cut all
stay. Columns beyond the two that are read play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .kernels import LOWER, MULTIPLIER, mixed

GRAM, ROWS, BITS = 5, 2, 18
LABELLED, HOLDOUT, SPARE, Z, SHARPNESS = 200_000, 5, 0.005, 3.0, 4.0
CHUNK = 1 << 12
ROUNDS, CELLS = 4, 2048
#: N-grams that are made distinct together.
PIECE = 1 << 22


def buckets(text: bytes) -> np.ndarray:
    """ROWS x n: the buckets of a text's distinct n-grams."""
    data = np.frombuffer(text.translate(LOWER), np.uint8)
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty((ROWS, 0), np.int64)
    # GRAM bytes fit one integer, so distinct n-grams are told apart exactly
    whole = np.zeros(n, np.uint64)
    for k in range(GRAM):
        whole = (whole << np.uint64(8)) | data[k : k + n]
    parts = [np.unique(whole[k : k + PIECE]) for k in range(0, n, PIECE)]
    distinct = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
    with np.errstate(over="ignore"):
        h = mixed(distinct * MULTIPLIER)
    return np.stack([(h >> np.uint64(BITS * r)) & np.uint64((1 << BITS) - 1) for r in range(ROWS)]).astype(np.int64)


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, target, holdout of LABELLED rows at most; of rows that repeat an id the worst label holds."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("target"))
    rows = rows.where("doc_id IS NOT NULL AND target IS NOT NULL").groupBy("doc_id").agg(F.min("target").alias("target"))
    rows = rows.withColumn("holdout", F.pmod(F.xxhash64(F.lit("holdout"), "doc_id"), F.lit(HOLDOUT)) == 0)
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)


def counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Documents by bucket, raw and target, and their numbers. docs: text, fit (a target document for the models)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, n = np.zeros((2, ROWS, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for text, fit in zip(shared.texts_of(batch, "text"), batch.column("fit").to_pylist()):
                found = buckets(text)
                n += (1, bool(fit))
                for r in range(ROWS):
                    np.add.at(tables[0, r], found[r], 1)
                    if fit:
                        np.add.at(tables[1, r], found[r], 1)
        names, rows = [-1], [n.tobytes()]
        for r in range(ROWS):
            for c in range(0, 1 << BITS, CHUNK):
                names.append((r << BITS) + c)
                rows.append(np.ascontiguousarray(tables[:, r, c : c + CHUNK]).astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(rows, pa.binary())], ["chunk", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, None
        for batch in batches:
            for name, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                row = np.frombuffer(raw, "<i8" if name == -1 else "<u4").astype(np.int64)
                if name == chunk:
                    held += row
                else:
                    if chunk is not None:
                        yield as_row(chunk, held)
                    chunk, held = name, row
        if chunk is not None:
            yield as_row(chunk, held)

    def as_row(chunk: int, held: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([held.tobytes()], pa.binary())], ["chunk", "counts"])

    schema = "chunk long, counts binary"
    parts = docs.mapInArrow(run, schema).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(total, schema)
    tables, n = np.zeros((2, ROWS, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for name, raw in parts.toLocalIterator():
        row = np.frombuffer(bytes(raw), np.int64)
        if name == -1:
            n = row
        else:
            tables[:, name >> BITS, name & ((1 << BITS) - 1) :][:, :CHUNK] = row.reshape(2, CHUNK)
    return tables[0], tables[1], int(n[0]), int(n[1])


def log_ratios(raw: np.ndarray, target: np.ndarray, n_raw: int, n_target: int) -> np.ndarray:
    """ROWS x buckets: log of target against raw at the near end of its interval, 0 without evidence."""
    if not n_raw or not n_target:
        return np.zeros(raw.shape, np.float32)
    expected = np.maximum(raw * (n_target / n_raw), 1e-12)
    upper = (np.sqrt(target + 1.0) + Z / 2) ** 2
    lower = np.maximum(np.sqrt(target.astype(float)) - Z / 2, 0.0) ** 2
    return (np.log(np.minimum(1.0, upper / expected)) + np.log(np.maximum(1.0, lower / expected))).astype(np.float32)


def log_weight(found: np.ndarray, table: np.ndarray) -> float:
    """Log weight of a text whose n-grams fall into the buckets ``found`` (ROWS x n)."""
    if not found.size:
        return 0.0
    each = np.stack([table[r, found[r]] for r in range(ROWS)])
    against = np.minimum(each.max(0), 0).sum(dtype=float)
    return float(np.maximum(each.min(0), 0).mean(dtype=float) + against)


def gumbel(id_col: Column) -> Column:
    """Standard Gumbel noise from a hash of the id."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit("gumbel"), id_col), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def kth_largest(keys: DataFrame, k: int) -> float:
    """A value that k keys, or more by ties and a rounding of (largest - least) / CELLS**ROUNDS, reach."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    for _ in range(ROUNDS):
        width = (high - low) / CELLS
        if not width > 0:
            break
        cell = F.least(F.floor((F.col("key") - low) / width), F.lit(CELLS - 1)).alias("cell")
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high)).groupBy(cell).count().collect()
        above = keys.where(F.col("key") > high).count()
        for at, n in sorted(inside, reverse=True):
            if above + n >= k:
                low, high = low + at * width, min(high, low + (at + 1) * width)
                break
            above += n
    return low


def weigh(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: float | None = None) -> DataFrame:
    """doc_id, log_weight, key, kept for each row of ``docs``. budget: the share of them to draw, estimated if not given."""
    docs = shared.id_and_text(docs, id_col, text_col)
    known = F.broadcast(labelled(labels).select(F.col("doc_id"), "target", "holdout"))  # LABELLED rows at most
    marked = docs.join(known, "doc_id", "left")
    fit = F.coalesce(F.col("target") & ~F.col("holdout"), F.lit(False))
    ratios = log_ratios(*counts(marked.select("text", fit.alias("fit"))))
    shared_ratios = docs.sparkSession.sparkContext.broadcast(ratios)  # ROWS * 2**BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared_ratios.value
        for batch in batches:
            weights = [log_weight(buckets(text), table) for text in shared.texts_of(batch, "text")]
            columns = [batch.column("doc_id"), pa.array(weights, pa.float64()), batch.column("held_out")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "log_weight", "held_out"])

    held_out = F.coalesce(F.col("target") & F.col("holdout"), F.lit(False)).alias("held_out")
    weighed = marked.select("doc_id", "text", held_out).mapInArrow(run, "doc_id long, log_weight double, held_out boolean")
    weighed = shared.staged(weighed.withColumn("key", SHARPNESS * F.col("log_weight") + gumbel(F.col("doc_id"))), "weights")
    if budget is None:
        least = weighed.where("held_out").agg(F.expr(f"percentile(log_weight, {SPARE})")).first()[0]
        k = weighed.where(F.col("log_weight") >= least).count() if least is not None else 0
    else:
        k = round(budget * weighed.count())
    cut = kth_largest(weighed, k) if k else float("-inf" if budget is None else "inf")
    return weighed.select("doc_id", "log_weight", "key", (F.col("key") >= cut).alias("kept"))


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weigh(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))
