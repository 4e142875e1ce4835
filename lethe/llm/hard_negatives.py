"""Operator 12: hard negatives by Fagin's threshold algorithm.

Vectors are quantised to integers. All rows are packed into blocks (sorted by label, a hot label over many blocks); a block keeps, for
each dimension, the list of its rows sorted by that component. An anchor reads the lists of its non-zero components from the end that
its sign prefers, DEPTHS rows deep each, and scores every row it meets by an exact integer inner product. No row still unread can score
more than the threshold, the sum over the lists of what stands at the depth reached. The anchor stops as soon as the threshold is
below the k-th score of each of its windows (strictly: a tie could still win by its id) or below the window's lower end.

First search: an anchor's positives, its best k rows of the same label, one window without ends. Second search: rows of other labels in
the window [low_share, 1] times the score of each positive. Blocks of anchors meet blocks of rows in the cells of a grid: each block goes
to the cells of its grid row or column, so no task gets more than its cells, and what a task has found for an anchor narrows
its next blocks. Only the best k of each window leave a task.

Rows with a null label, a null vector, or a null or non-finite component take no part. Components a vector lacks count as 0, so an empty
vector scores 0. Components beyond 2^62 and scores beyond 2^63 are set to the nearest value
within. A null id is never an anchor and comes after
all others in ties; repeated ids and rows are rows of their own, and an anchor leaves out only itself. An empty table gives no row.
Only the three named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

SCALE, TOP, LOW_SHARE = 256, 5, (80, 100)
#: Rows of a block, anchors of a block, blocks of either kind that meet in a cell, anchors whose best rows a task holds.
BLOCK_ROWS, BLOCK_ANCHORS, CELL, HELD = 4096, 256, 8, 1 << 14
#: How deep the sorted lists are read, in steps.
DEPTHS = [8 << 2 * i for i in range(8)]
LEAST, MOST, LARGEST = -(2**63), 2**63 - 1, 2**62
ROWS = "row long, vec_id long, label long, q array<long>"
PACKED = "block long, low long, high long, n int, kind string, rows binary, ids binary, labels binary, vectors binary, orders binary, lows array<array<long>>, highs array<array<long>>"
FOUND = "anchor_row long, place int, score long, row long, vec_id long"


def quantised(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """Staged ROWS of those that take part; row tells rows apart."""
    q = F.col(vector_col).cast("array<double>")
    narrow = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), q.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    limit = float(LARGEST)
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), scale * x))).cast("long"))
    found = narrow.where(F.col("label").isNotNull() & F.col("v").isNotNull() & sound).select("vec_id", "label", whole.alias("q"))
    return shared.staged(found.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "q"), "vectors")


def matrix(lists: list[list[int]]) -> np.ndarray:
    """Rows of the same width, zeros at the end of short ones."""
    sizes = np.array([len(x) for x in lists])
    out = np.zeros((len(lists), max(sizes, default=0)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else 0
    return out


def packed(rows: DataFrame, size: int, sort_lists: bool) -> DataFrame:
    """Staged blocks of at most ``size`` rows, sorted by label. rows: ROWS, with lows and highs (the ends of each window) for anchors."""
    windows = {"lows", "highs"} <= set(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, []

        def full(rows: list[tuple]) -> pa.RecordBatch:
            number, ids, labels, vectors, *ends = zip(*rows)
            m = matrix(list(vectors))
            largest = max(abs(int(m.min(initial=0))), int(m.max(initial=0)))
            kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"
            orders = np.argsort(m.T, axis=1, kind="stable").astype("<u2") if sort_lists else np.empty((0, 0), "<u2")
            row = [block, labels[0], labels[-1], len(rows), kind]
            row += [np.array(x, "<i8").tobytes() for x in (number, [MOST if i is None else i for i in ids], labels)]
            row += [m.astype(kind).tobytes(), orders.tobytes(), *(ends or [None, None])]
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, schema)], schema=schema)

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in batch.schema.names))
            while len(held) >= size:
                yield full(held[:size])
                block, held = block + 1, held[size:]
        if held:
            yield full(held)

    lists = pa.list_(pa.list_(pa.int64()))
    kinds = [pa.int64()] * 3 + [pa.int32(), pa.string()] + [pa.binary()] * 5 + [lists] * 2
    schema = pa.schema(list(zip([x.split()[0] for x in PACKED.split(", ")], kinds)))
    keys = ["label", F.xxhash64("row"), "row"]
    columns = ["row", "vec_id", "label", "q", *["lows", "highs"][: 2 * windows]]
    return shared.staged(rows.select(columns).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, PACKED), "blocks")


class Block:
    """Rows of a block as arrays; for candidates also their sorted lists and what stands in them at each depth."""

    def __init__(self, row: dict):
        self.key, n, ints = row["block"], row["n"], "<i8"
        self.rows, self.ids, self.labels = (np.frombuffer(row[c], ints) for c in ("rows", "ids", "labels"))
        self.vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(n, -1).astype(np.float64 if row["kind"] == "<i2" else object)
        self.bound = int(abs(self.vectors).max()) if self.vectors.size else 0
        self.lows, self.highs = row["lows"], row["highs"]
        if row["orders"]:
            self.orders = np.frombuffer(row["orders"], "<u2").reshape(-1, n)
            self.depths = [d for d in DEPTHS if d < n] + [n]
            at = np.arange(len(self.orders))
            self.worst_high = np.array([self.vectors[self.orders[:, n - d], at] for d in self.depths])
            self.worst_low = np.array([self.vectors[self.orders[:, d - 1], at] for d in self.depths])
        elif n and not self.vectors.shape[1]:
            self.orders, self.depths = np.empty((0, n), np.uint16), [n]
            self.worst_high = self.worst_low = np.empty((1, 0))


def fitted(vectors: np.ndarray, width: int) -> np.ndarray:
    """``width`` columns: further ones meet zeros only."""
    out = np.zeros((len(vectors), width), vectors.dtype)
    out[:, : min(width, vectors.shape[1])] = vectors[:, :width]
    return out


@dataclass
class Best:
    """The best ``k`` rows of a window so far: (-score, id, row)."""

    low: int
    high: int
    k: int
    rows: list[tuple[int, int, int]]

    def kth(self) -> float:
        """No row below this score can enter; one with this very score may."""
        return max(self.low, -self.rows[-1][0]) if len(self.rows) == self.k else self.low


def search(anchor: np.ndarray, thresholds: np.ndarray, block: Block, allowed: np.ndarray, windows: list[Best]) -> int:
    """Threshold algorithm for one anchor in one block; how many rows were scored."""
    n, done = len(block.rows), 0
    unread = allowed.copy()
    left, up, down = int(unread.sum()), np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
    scored = 0
    for depth, threshold in zip(block.depths, thresholds):
        if not left:
            break
        if depth == n:  # the lists end here
            fresh = np.flatnonzero(unread)
        else:
            mark = np.zeros(n, bool)
            mark[block.orders[up, n - depth : n - done]] = True
            mark[block.orders[down, done:depth]] = True
            fresh = np.flatnonzero(mark & unread)
        if len(fresh):
            unread[fresh] = False
            left, scored = left - len(fresh), scored + len(fresh)
            scores = block.vectors[fresh] @ anchor
            useful = scores >= min(w.kth() for w in windows)
            fresh, scores = fresh[useful], np.clip(scores[useful], LEAST + 1, MOST) if scores.dtype == object else scores[useful]
            order = np.lexsort((block.rows[fresh], block.ids[fresh], -scores.astype(np.int64)))
            fresh, falling = fresh[order], -scores[order].astype(np.int64)
            for w in windows:
                a, b = np.searchsorted(falling, -w.high, "left"), np.searchsorted(falling, -w.low, "right")
                if some := fresh[a : min(b, a + w.k)].tolist():
                    w.rows = sorted(w.rows + list(zip(falling[a : a + len(some)].tolist(), block.ids[some].tolist(), block.rows[some].tolist())))[: w.k]
        if all(threshold < w.kth() for w in windows):
            break
        done = depth
    return scored


def best_rows(blocks: DataFrame, anchors: DataFrame, same_label: bool, k: int) -> DataFrame:
    """FOUND: for each anchor and window (place) the best ``k`` rows with the anchor's label (without itself) or with another one."""
    names = ["block", "n", "kind", "rows", "ids", "labels", "vectors", "orders", "lows", "highs"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Best]] = {}
        kept: dict[str, Block] = {}

        def block_of(side: str, row: dict) -> Block:
            if side not in kept or kept[side].key != row[f"{side}_block"]:
                kept[side] = Block({name: row[f"{side}_{name}"] for name in names})
            return kept[side]

        def full() -> pa.RecordBatch:
            rows = [(at, place, -s, r, i) for at, windows in held.items() for place, w in enumerate(windows) for s, i, r in w.rows]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["anchor_row", "place", "score", "row", "vec_id"])

        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                block, group = block_of("c", row), block_of("a", row)
                vectors = fitted(group.vectors, block.vectors.shape[1])
                if block.bound * group.bound * max(1, block.vectors.shape[1]) >= 2**53:
                    vectors, block.vectors = vectors.astype(object), block.vectors.astype(object)
                    block.worst_high, block.worst_low = block.worst_high.astype(object), block.worst_low.astype(object)
                thresholds = np.where(vectors > 0, vectors, 0) @ block.worst_high.T + np.where(vectors < 0, vectors, 0) @ block.worst_low.T
                for i, anchor_row in enumerate(group.rows.tolist()):
                    allowed = (block.labels == group.labels[i]) == same_label
                    if same_label:
                        allowed &= block.rows != anchor_row
                    if anchor_row not in held:
                        held[anchor_row] = [Best(low, high, k, []) for low, high in zip(group.lows[i], group.highs[i])]
                    if held[anchor_row] and allowed.any():
                        search(vectors[i], thresholds[i], block, allowed, held[anchor_row])
                if len(held) >= HELD:
                    yield full()
                    held = {}
        yield full()

    columns = lambda side: [F.col(name).alias(f"{side}_{name}") for name in [*names, "low", "high"]]
    across, down = (max(1, -(-df.count() // CELL)) for df in (anchors, blocks))
    one = blocks.select(*columns("c"), F.pmod(F.xxhash64("block"), F.lit(down)).alias("c_down"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("c_across"))
    two = anchors.select(*columns("a"), F.pmod(F.xxhash64("block"), F.lit(across)).alias("a_across"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("a_down"))
    if same_label:
        meets = (F.col("c_low") <= F.col("a_high")) & (F.col("a_low") <= F.col("c_high"))
    else:
        meets = ~((F.col("c_low") == F.col("c_high")) & (F.col("a_low") == F.col("a_high")) & (F.col("c_low") == F.col("a_low")))
    pairs = one.join(two, (F.col("c_down") == F.col("a_down")) & (F.col("c_across") == F.col("a_across")) & meets)
    found = pairs.select(*[f"{side}_{name}" for side in "ca" for name in names]).mapInArrow(run, FOUND)
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("vec_id", F.when(F.col("vec_id") < MOST, F.col("vec_id")))


def hard_negatives(
    vectors: DataFrame,
    is_anchor: str,
    k_positives: int = TOP,
    k: int = TOP,
    low_share: tuple[int, int] = LOW_SHARE,
    scale: int = SCALE,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor: SQL condition on vec_id and label. low_share: the least share of the positive's score, as a fraction.
    block_rows: at most 65,536.
    """
    shared.bounded_batches(vectors.sparkSession)
    rows = quantised(vectors, id_col, label_col, vector_col, scale)
    anchors = rows.where(is_anchor)
    blocks = packed(rows, block_rows, True)
    whole = anchors.withColumns({"lows": F.array(F.lit(LEAST + 1)), "highs": F.array(F.lit(MOST))})
    positives = shared.staged(best_rows(blocks, packed(whole, block_anchors, False), True, k_positives), "positives")
    share, of = low_share
    p = F.col("score").cast("decimal(38,0)")
    low = F.greatest(F.lit(LEAST + 1).cast("decimal(38,0)"), F.least(F.lit(MOST).cast("decimal(38,0)"), F.ceil(p * share / of)))
    windows = positives.where("score >= 0").withColumn("low", low.cast("long")).groupBy(F.col("anchor_row").alias("row"))
    ends = windows.agg(F.array_sort(F.collect_list(F.struct("rank", "low", F.col("score").alias("high"), F.col("vec_id").alias("positive_id")))).alias("w"))  # k_positives at most
    ends = ends.select("row", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    second = packed(anchors.join(ends, "row"), block_anchors, False)
    negatives = best_rows(blocks, second, False, k)
    # of scores below 0 no share is left; they come last, so places are ranks
    left = positives.select("anchor_row", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = left.join(anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id")), "anchor_row")
    right = negatives.select("anchor_row", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(right, ["anchor_row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(shared.table(spark, sf_dir, "embeddings").withColumn("label", moved), "vec_id % 100 = 0")


ORACLE_SQL = {
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
}
