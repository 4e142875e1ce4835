"""Splits that keep linked facts together and meet their counts exactly.

Facts with one subject, or whose object is another fact's subject, form a group; a group goes into one split or none. Spark folds
the groups into classes of equal (size, relations) and picks the members; the choice between classes is an exact reachability
computation over (facts in construction, facts in calibration, relations covered in each). Its state depends on the requested counts
alone: classes larger than both counts are left out, and no class counts more members than could ever be placed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lethe.operators.datasets import eligible
from lethe.operators.graph import connected_components
from lethe.storage import staged

CONSTRUCTION, CALIBRATION, UNASSIGNED, FINAL = "construction", "calibration", "unassigned", "final_test"
#: Parts in which the members of a class are ranked first.
SALTS = 64
#: States (bits) of one class that a packing may need: (construction + 1) * (calibration + 1) * 4 ** relations.
MOST_STATES = 1 << 28


class SplitError(ValueError):
    """The declared counts cannot be met."""


def groups(facts: DataFrame) -> DataFrame:
    """fact, grp, relation: grp is the least subject of the facts that hang together. facts: fact, subject, object, relation."""
    subjects = facts.select(F.col("subject").alias("object")).distinct()
    links = facts.where("subject != object").select("subject", "object").join(subjects, "object", "left_semi")
    roots = staged(connected_components(links, "subject", "object"), "roots").select(F.col("node").alias("subject"), "root")
    return facts.join(roots, "subject", "left").select("fact", F.coalesce("root", "subject").alias("grp"), "relation")


def profiles(grouped: DataFrame, relations: Sequence[str]) -> DataFrame:
    """grp, size, mask (a bit for each declared relation that it holds). grouped: grp, relation, a row a fact."""
    bit = F.coalesce(*[F.when(F.col("relation") == name, F.lit(1 << k)) for k, name in enumerate(relations)], F.lit(0))
    return grouped.groupBy("grp").agg(F.count("*").alias("size"), F.bit_or(bit).alias("mask"))


def _spread(reach: np.ndarray, size: int, mask: int, most: int) -> np.ndarray:
    """States from which up to ``most`` groups of (size, mask), each in either split or none, lead into ``reach``."""
    with_mask = np.arange(reach.shape[2]) | mask
    for _ in range(most):
        wider = reach.copy()
        wider[: -size or None] |= reach[size:][:, :, with_mask] if size < reach.shape[0] else False
        wider[:, : -size or None] |= reach[:, size:][:, :, :, with_mask] if size < reach.shape[1] else False
        if (wider == reach).all():
            break
        reach = wider
    return reach


def pack(classes: Sequence[tuple[int, int, int]], construction: int, calibration: int, n_relations: int) -> list[tuple[int, int]] | None:
    """How many groups of each class (size, mask, number) go into either split; None if the counts cannot be met.

    Of all solutions the first in lexicographic order of the classes as given.
    """
    full = (1 << n_relations) - 1
    shape = construction + 1, calibration + 1, full + 1, full + 1
    if np.prod(shape, dtype=object) > MOST_STATES:
        raise ValueError(f"{np.prod(shape, dtype=object)} states are more than {MOST_STATES}")
    goal = np.zeros(shape, bool)
    goal[construction, calibration, full, full] = True
    layers = [np.packbits(goal)]
    for size, mask, number in reversed(classes):
        goal = _spread(goal, size, mask, number)
        layers.append(np.packbits(goal))
    layers.reverse()
    if not goal[0, 0, 0, 0]:
        return None
    out, (c, k, cm, km) = [], (0, 0, 0, 0)
    for (size, mask, number), packed in zip(classes, layers[1:]):
        goal = np.unpackbits(packed, count=int(np.prod(shape))).reshape(shape)
        options = ((x, y) for x in range(min(number, (construction - c) // size) + 1) for y in range(min(number - x, (calibration - k) // size) + 1))
        x, y = next((x, y) for x, y in options if goal[c + x * size, k + y * size, cm | mask * (x > 0), km | mask * (y > 0)])
        out.append((x, y))
        c, k, cm, km = c + x * size, k + y * size, cm | mask * (x > 0), km | mask * (y > 0)
    return out


def class_order(size: str = "size", mask: str = "mask") -> list[Column]:
    return [F.col(size).desc(), F.col(mask)]


def packed_splits(grouped: DataFrame, construction: int, calibration: int, relations: Sequence[str], seed: int) -> DataFrame:
    """grp, size, label for every group: exactly ``construction`` and ``calibration`` facts, each split with every declared relation.

    Which groups of a class are taken follows the MD5 of the seed and the group. Raises SplitError with the totals if it cannot be.
    """
    found = staged(profiles(grouped, relations), "profiles")
    most = max(construction, calibration)
    # at most ``most`` sizes times the masks
    rows = found.where(F.col("size") <= most).groupBy("size", "mask").agg(F.count("*").alias("n")).orderBy(*class_order()).collect()
    classes = [(row["size"], row["mask"], min(row["n"], construction // row["size"] + calibration // row["size"])) for row in rows]
    chosen = pack(classes, construction, calibration, len(relations))
    if chosen is None:
        totals = found.agg(F.sum("size").alias("facts"), *[F.sum(F.when(F.getbit("mask", F.lit(k)) == 1, F.col("size")).otherwise(0)) for k in range(len(relations))]).first()
        counts = " ".join(f"{name}={n or 0}" for name, n in zip(relations, totals[1:]))
        raise SplitError(f"construction={construction} calibration={calibration} facts={totals[0] or 0} {counts}".strip())
    wanted = [(size, mask, x, y) for (size, mask, _), (x, y) in zip(classes, chosen) if x or y]
    quota = F.broadcast(found.sparkSession.createDataFrame(wanted, "size long, mask int, x int, y int"))
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col("grp").cast("string"))), F.col("grp")]
    parts = found.join(quota, ["size", "mask"]).withColumn("part", F.pmod(F.xxhash64("grp"), F.lit(SALTS)))
    near = parts.withColumn("place", F.row_number().over(Window.partitionBy("size", "mask", "part").orderBy(*order))).where("place <= x + y")
    placed = near.withColumn("place", F.row_number().over(Window.partitionBy("size", "mask").orderBy(*order))).where("place <= x + y")
    taken = placed.select("grp", F.when(F.col("place") <= F.col("x"), CONSTRUCTION).otherwise(CALIBRATION).alias("label"))
    return found.join(F.broadcast(taken), "grp", "left").select("grp", "size", F.coalesce("label", F.lit(UNASSIGNED)).alias("label"))


def assign_splits(facts: DataFrame, gates: DataFrame, audits: DataFrame, construction: int, calibration: int, relations: Sequence[str], seed: int) -> DataFrame:
    """fact, subject, label of every eligible fact. facts: fact, subject, object, relation; gates and audits: fact, verdict."""
    sound = staged(facts.join(eligible(facts.select("fact"), gates, audits).where("eligible"), "fact", "left_semi"), "eligible")
    grouped = staged(groups(sound), "groups")
    labels = packed_splits(grouped, construction, calibration, relations, seed)
    return sound.select("fact", "subject").join(grouped.select("fact", "grp"), "fact").join(labels, "grp").select("fact", "subject", "label")


def split_faults(labels: DataFrame, facts: DataFrame) -> DataFrame:
    """subject, fault: 'two_labels' for a subject with several labels, 'linked' for one whose facts do not share a fact's label that names it.

    labels: fact, label; facts: fact, subject, object.
    """
    labelled = facts.join(labels, "fact")
    several = labelled.groupBy("subject").agg(F.count_distinct("label").alias("n")).where("n > 1").select("subject", F.lit("two_labels").alias("fault"))
    own = labelled.select(F.col("subject").alias("object"), "label").distinct()
    of = own.groupBy("object").agg(F.collect_set("label").alias("labels"))  # a handful of labels
    linked = labelled.join(of, "object").where(~F.array_contains("labels", F.col("label"))).select(F.col("object").alias("subject"), F.lit("linked").alias("fault"))
    return several.union(linked.distinct())


def write_splits(labels: DataFrame, folder: str) -> None:
    labels.select("fact", "subject", "label").write.mode("error").partitionBy("label").parquet(folder)


def load_split(spark: SparkSession, folder: str, split: str, role: str, access_log: str) -> DataFrame:
    """fact of a split. The final test opens to its own role only and never empty; a refusal is logged, then raised."""
    if split not in (CONSTRUCTION, CALIBRATION, FINAL):
        raise ValueError(split)
    found = spark.read.schema("fact string, subject string, label string").parquet(folder).where(F.col("label") == split).select("fact")
    if split == FINAL:
        reason = "role" if role != "final_test_pass" else "empty_split" if found.isEmpty() else None
        if reason:
            row = [(split, role, reason, folder)]
            spark.createDataFrame(row, "split string, role string, reason string, path string").coalesce(1).write.mode("append").json(access_log)
            raise PermissionError(reason)
    return found
