"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a grouped minimum (combined before the shuffle) and a join of the edges with it, so a hub with many
neighbours is an ordinary skewed join that adaptive execution splits. Every round is written to the shared folder.

Records that tie two kinds of keys are first contracted within their tasks, some rows at a time: each key is linked to the
least key that these rows tie it to, so the rounds see what ties parts of the table together, not its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lethe.storage import staged

#: Edges that a task contracts at a time (about 100 MB of its Python worker).
CHUNK = 1 << 19


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with the least neighbour m of u, u included."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """node, root for each node of an edge between different nodes; root is the least node of its component.

    Nulls and loops are ignored; an empty input gives an empty result.
    """
    e = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where(f"{left} IS NOT NULL AND {right} IS NOT NULL AND u != v").distinct()
    e = staged(e, "edges")
    before = _mark(e)
    while before[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = _star(large)
        e = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        e = staged(e, "edges")
        after = _mark(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def _within_tasks() -> tuple[Callable, Callable]:
    """contract and forest for ``mapInArrow``; nested, so that workers need not have this package."""

    def joined(held: list[pa.RecordBatch]) -> list[pa.Array]:
        return [pa.concat_arrays([b.column(k) for b in held]) for k in range(2)]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        """The columns of ``CHUNK`` rows, or a few more, at a time."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= CHUNK:
                columns, held = joined(held), []
                yield columns
        if held:
            yield joined(held)

    def least_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """The least node of the component of each of the nodes 0 to n - 1; a and b are the ends of the edges."""
        least = np.arange(n)
        while len(a):
            np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
            while ((further := least[least]) != least).any():
                least = further
            a, b = least[a], least[b]
            a, b = a[a != b], b[a != b]
        return least

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """left, right (one of them null), root: the least right key that a chunk's rows tie a key to."""
        for left, right in chunks(batches):
            left, right = left.dictionary_encode(), right.dictionary_encode()
            lefts, rights = left.dictionary.to_numpy(), right.dictionary.to_numpy()
            order = np.argsort(rights)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            # Right keys come first and in order, so the least node of a component is its least right key.
            least = least_of(rank[right.indices.to_numpy()], len(rights) + left.indices.to_numpy().astype(np.int64), len(rights) + len(lefts))
            rights = rights[order]
            none = [pa.nulls(len(rights), pa.int64()), pa.nulls(len(lefts), pa.int64())]
            roots = rights[least]
            for columns in ([none[0], rights, roots[: len(rights)]], [lefts, none[1], roots[len(rights) :]]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["left", "right", "root"])

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The edges of a chunk as edges of its nodes to the least node of their components."""
        for a, b in chunks(batches):
            nodes, ends = np.unique(np.concatenate((a.to_numpy(), b.to_numpy())), return_inverse=True)
            least = least_of(ends[: len(a)], ends[len(a) :], len(nodes))
            linked = least != np.arange(len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[least[linked]])], ["a", "b"])

    return contract, forest


def record_components(rows: DataFrame, left: str, right: str) -> DataFrame:
    """left, right (one of them null), root for each key of the columns left and right, two kinds of integer keys that rows tie together.

    root is the least right key of the component. Rows with a null key are ignored.
    """
    contract, forest = _within_tasks()
    keys = rows.select(F.col(left).cast("long").alias("left"), F.col(right).cast("long").alias("right")).where("left IS NOT NULL AND right IS NOT NULL")
    # A key has a row for each chunk that holds it, however many of its rows do; the roots of one key hang together in a chain.
    order = Window.partitionBy("left", "right").orderBy("root")
    parts = staged(keys.mapInArrow(contract, "left long, right long, root long").withColumn("before", F.lag("root").over(order)), "parts")
    chains = parts.where("before != root").select(F.col("root").alias("a"), F.col("before").alias("b"))
    links = chains.union(parts.where("before IS NULL AND right != root").select(F.col("right").alias("a"), F.col("root").alias("b")))
    found = staged(connected_components(links.mapInArrow(forest, "a long, b long"), "a", "b").toDF("root", "least"), "roots")
    return parts.where("before IS NULL").join(found, "root", "left").select("left", "right", F.coalesce("least", "root").alias("root"))
