"""Operator 2: benchmark decontamination by latent semantic retrieval.

The benchmark is taken in blocks of about BLOCK_WORDS words, so that everything sent to tasks is bounded. For a block:
items are cut into passages of PIECE words; inverse document frequencies of the block's words are counted over all
documents, and words of more than MAX_DF of them are left out unless they are among the RAREST words of an item; a
distributed randomised SVD (Halko et al., 2011) of the block's TF-IDF passages gives latent directions, as many as it
takes for each query passage to keep MIN_KEPT of its norm; every document's overlapping passages (three strides of
STRIDE words, so that each run of PIECE words lies in one whole) are projected and compared with every query passage.
A pair is a candidate if its latent cosine reaches MIN_COSINE (less for short items: in proportion to the root of their length) and the passage holds MIN_HELD of the query's own weight;
of neighbouring passages each local maximum stands for those around it. For candidates the longest common subsequence of words with the whole
item is computed around the best alignment, and likewise for the item's answer (its ``answer`` column if there is
one, else its last quarter). An item is in a document if the share of its words in the subsequence reaches SURE, or
reaches LIKELY while the answer's share reaches ANSWER. Items of fewer than SHORT words must be there in full.

The documents are read once for each block and once for the word counts of GROUP blocks, and never shuffled. Null or empty texts and items match nothing. Rows that repeat an
id are searched on their own; a pair is returned once with its best scores. Rows with a null id are searched as well and
return under a null id. Without documents or items nothing is returned. Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .kernels import ALNUM_OR_SPACE, word_hashes

PIECE, STRIDE, OVERSAMPLING = 32, 16, 10
MAX_DF, RAREST, MIN_KEPT = 0.02, 8, 0.7
MIN_COSINE, MIN_HELD, SURE, LIKELY, ANSWER, SHORT = 0.5, 0.5, 0.8, 0.6, 0.5, 8
BLOCK_WORDS, GROUP = 12_000, 64
_TABLE_BITS = 20
_WORD = np.array([b != 32 for b in range(256)])


def words_of(text: bytes) -> np.ndarray:
    """Hashes of the lower-cased words (ASCII letters and digits, other characters)."""
    return word_hashes(np.frombuffer(text.translate(ALNUM_OR_SPACE), np.uint8), _WORD)


@dataclass(frozen=True)
class Item:
    item_id: int
    words: np.ndarray
    answer: np.ndarray


class Vocabulary:
    """Sorted words; a table by the low bits of the hash tells most others apart before the search."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self._low(words)] = True

    @staticmethod
    def _low(hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 for other words."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.table[self._low(hashes)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.words, hashes[maybe]), len(self.words) - 1)
            out[maybe] = np.where(self.words[at] == hashes[maybe], at, -1)
        return out


def pieces(words: np.ndarray) -> list[np.ndarray]:
    """An item in passages of PIECE words; the last one ends where the item ends."""
    if len(words) <= PIECE:
        return [words]
    starts = [*range(0, len(words) - PIECE, PIECE), len(words) - PIECE]
    return [words[s : s + PIECE] for s in starts]


def telling(items: list[Item], vocabulary: Vocabulary, counts: np.ndarray, n: int) -> np.ndarray:
    """Which words of the block tell passages apart: those that are not frequent, and the rarest ones of each item."""
    keep = counts <= MAX_DF * n
    for item in items:
        rows = np.unique(vocabulary.rows(item.words))
        keep[rows[np.argsort(counts[rows], kind="stable")[:RAREST]]] = True
    return keep


def document_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """Documents that hold each word of the block, and all documents: sums of one short row per word and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(len(vocabulary.words), np.int64), 0
        for batch in batches:
            for text in shared.texts_of(batch, "text"):
                rows = vocabulary.rows(words_of(text))
                counts[np.unique(rows[rows >= 0])] += 1
                n += 1
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(counts[seen], n))], ["word", "n"])

    found = docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(len(vocabulary.words), np.int64), 0
    for word, n in found:
        if word < 0:
            total = n
        else:
            out[word] = n
    return out, total


def tf_idf(words: np.ndarray, vocabulary: Vocabulary, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of a passage's unit vector."""
    rows, counts = np.unique(vocabulary.rows(words), return_counts=True)
    rows, counts = rows[rows >= 0], counts[rows >= 0]
    values = counts * idf[rows]
    norm = np.sqrt((values**2).sum())
    return rows, values / norm if norm else values


def summed(benchmark: DataFrame, partial, shape: tuple[int, int]) -> np.ndarray:
    """Sum over the tasks of ``partial(texts) -> array``; the array's size is bounded by the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += partial([words_of(t) for t in shared.texts_of(batch, "text")])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    out = np.zeros(shape)
    for row in benchmark.mapInArrow(run, "total binary").toLocalIterator():
        out += np.frombuffer(bytes(row.total)).reshape(shape)
    return out


def latent_directions(benchmark: DataFrame, vocabulary: Vocabulary, idf: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Leading right singular vectors (words x rank) of the block's passages, from two distributed passes.

    queries: the block's unit vectors; each keeps MIN_KEPT of its norm.
    """
    width = min(len(queries) + OVERSAMPLING, len(vocabulary.words))
    omega = np.random.Generator(np.random.PCG64(7)).standard_normal((len(vocabulary.words), width))

    def vectors(items: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for words in items:
            for piece in pieces(words):
                rows, values = tf_idf(piece, vocabulary, idf)
                if len(rows):
                    yield rows, values

    def sketch(items: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(vocabulary.words), width))
        for rows, values in vectors(items):
            out[rows] += np.outer(values, values @ omega[rows])
        return out

    basis, _ = np.linalg.qr(summed(benchmark, sketch, omega.shape))

    def gram(items: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((width, width))
        for rows, values in vectors(items):
            y = values @ basis[rows]
            out += np.outer(y, y)
        return out

    strength, turn = np.linalg.eigh(summed(benchmark, gram, (width, width)))
    turn = turn[:, np.argsort(-strength)]
    kept = np.cumsum((queries @ basis @ turn) ** 2, 1).min(0)
    rank = int(np.searchsorted(kept, MIN_KEPT**2)) + 1
    return basis @ turn[:, :rank]


def common_subsequence(left: np.ndarray, right: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``left``."""
    masks: dict[int, int] = {}
    for k, word in enumerate(left.tolist()):
        masks[word] = masks.get(word, 0) | 1 << k
    full = (1 << len(left)) - 1
    row = full
    for word in right.tolist():
        if mask := masks.get(word):
            hit = row & mask
            row = (row + hit | row - hit) & full
    return len(left) - row.bit_count()


def shares(item: Item, words: np.ndarray, begin: int, end: int) -> tuple[float, float]:
    """Share of the item and of its answer in the common subsequence around the best alignment with words[begin:end]."""
    n = len(item.words)
    near = words[max(0, begin - n) : end + n]
    order = np.argsort(item.words, kind="stable")
    ranked = item.words[order]
    lo, hi = np.searchsorted(ranked, near, "left"), np.searchsorted(ranked, near, "right")
    count = hi - lo
    if not count.any():
        return 0.0, 0.0
    at = np.repeat(np.arange(len(near)), count)
    place = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
    shift, votes = np.unique(at - place, return_counts=True)
    best = int(shift[np.argmax(votes)])
    slack = max(2, n // 4)
    region = near[max(0, best - slack) : max(0, best + n + slack)]
    answer = common_subsequence(item.answer, region) / len(item.answer) if len(item.answer) else 1.0
    return common_subsequence(item.words, region) / n, answer


def is_leak(n_words: int, share: float, answer: float) -> bool:
    if n_words < SHORT:
        return share == 1.0
    return share >= SURE or share >= LIKELY and answer >= ANSWER


RESULT = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"


def search_block(docs: DataFrame, items: list[Item], vocabulary: Vocabulary, weighted: np.ndarray, min_cosine: float, min_held: float) -> DataFrame:
    """weighted: idf times latent direction for each word of the block."""
    queries, owner, least = [], [], []
    for k, item in enumerate(items):
        for piece in pieces(item.words):
            rows = vocabulary.rows(piece)
            queries.append(weighted[rows[rows >= 0]].sum(0))
            owner.append(k)
            least.append(min_cosine * np.sqrt(len(piece) / PIECE))  # a short item fills less of a passage
    matrix = np.array(queries, np.float32)
    norms = np.linalg.norm(matrix, axis=1)
    some = norms > 0
    matrix, norms, owner, least = matrix[some] / norms[some, None], norms[some], np.array(owner)[some], np.array(least, np.float32)[some]
    weighted = weighted.astype(np.float32)

    def candidates(words: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Passage number (its last stride), query, cosine."""
        rows = vocabulary.rows(words)
        at = np.flatnonzero(rows >= 0)
        if not len(at):
            return
        stride = at // STRIDE
        first = np.flatnonzero(np.diff(stride, prepend=-1))
        sums = np.zeros((len(words) // STRIDE + 5, weighted.shape[1]), np.float32)
        sums[stride[first] + 2] = np.add.reduceat(weighted[rows[at]], first, 0)
        sums = sums[:-2] + sums[1:-1] + sums[2:]
        there = np.unique(stride[first][:, None] + np.arange(3))
        sums = sums[there]
        match = sums @ matrix.T
        size = np.linalg.norm(sums, axis=1)
        query, row = np.nonzero(((match >= least * size[:, None]) & (match >= min_held * norms)).T)
        if not len(query):
            return
        value = match[row, query]
        apart = (query[1:] != query[:-1]) | (there[row[1:]] > there[row[:-1]] + 1)
        # passages that hold no less than the one before and more than the one after
        rising, falling = np.concatenate(([True], apart | (value[1:] >= value[:-1]))), np.concatenate((apart | (value[:-1] > value[1:]), [True]))
        for best in np.flatnonzero(rising & falling):
            yield int(there[row[best]]), int(query[best]), float(value[best] / max(size[row[best]], 1e-9))

    def found_in(text: bytes) -> Iterator[tuple[int, float, float, float]]:
        words = words_of(text)
        for passage, query, cosine in candidates(words):
            item = items[owner[query]]
            share, answer = shares(item, words, max(0, (passage - 2) * STRIDE), (passage + 1) * STRIDE)
            if is_leak(len(item.words), share, answer):
                yield item.item_id, cosine, share, answer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(doc, *hit) for doc, text in zip(batch.column("doc_id").to_pylist(), shared.texts_of(batch, "text")) for hit in found_in(text)]
            kinds = [pa.int64()] * 2 + [pa.float64()] * 3
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

    return docs.mapInArrow(run, RESULT)


def block_of(items: list[Item], every: Vocabulary, counts: np.ndarray, n: int, part: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The block's telling words, and idf times latent direction for each. counts: documents with each word of ``every``, of ``n``."""
    vocabulary = Vocabulary(np.unique(np.concatenate([i.words for i in items])))
    counts = counts[every.rows(vocabulary.words)]
    keep = telling(items, vocabulary, counts, n)
    vocabulary, idf = Vocabulary(vocabulary.words[keep]), np.log((n + 1) / (counts[keep] + 1)) + 1e-3
    queries = []
    for item in items:
        for piece in pieces(item.words):
            rows, values = tf_idf(piece, vocabulary, idf)
            if len(rows):
                queries.append(np.zeros(len(vocabulary.words)))
                queries[-1][rows] = values
    return vocabulary, idf[:, None] * latent_directions(part, vocabulary, idf, np.array(queries))


def items_of(part: DataFrame) -> list[Item]:
    """The items of a block that have words."""
    items = []
    for row in part.orderBy("item_id", "text").toLocalIterator():
        words = words_of(row.text.encode())
        if len(words):
            items.append(Item(row.item_id, words, words_of(row.answer.encode()) if row.answer else words[-max(3, len(words) // 4) :]))
    return items


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    min_cosine: float = MIN_COSINE,
    min_held: float = MIN_HELD,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    answer_col: str = "answer",
) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share of each item that a document holds."""
    spark, docs = docs.sparkSession, shared.id_and_text(docs, id_col, text_col)
    answer = F.col(answer_col).cast("string") if answer_col in benchmark.columns else F.lit(None).cast("string")
    every = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"), answer.alias("answer")).where("text IS NOT NULL")
    out = spark.createDataFrame([], RESULT)
    # items are dealt to blocks by a hash; blocks differ a little in size
    size = every.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = -(-size // block_words)
    every = every.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks))))
    for low in range(0, blocks, GROUP):
        parts = [every.where(F.col("block") == k).drop("block") for k in range(low, min(blocks, low + GROUP))]
        held = [(items, part) for part in parts if (items := items_of(part))]
        if held:
            words = Vocabulary(np.unique(np.concatenate([i.words for items, _ in held for i in items])))
            counts, n = document_frequencies(docs, words)
            for items, part in held:
                out = out.union(search_block(docs, items, *block_of(items, words, counts, n, part), min_cosine, min_held))
    best = F.max(F.struct("lcs_share", "answer_share", "cosine")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.cosine", "best.lcs_share", "best.answer_share")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
