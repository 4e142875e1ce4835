"""Sets of tables that become visible together, or not at all; and steps that bring stored tables up to date.

A version is a folder of Parquet tables that is written once. It is read back, held to its counts, digests and checks, and only then named by
a pointer: one row appended to ``pointers``. Readers take the newest pointer, so they see all tables of a version or none of it;
what a failed publication has written is never named. A pointer names the one it was made from: of two that were made from the same
one, the first by its token holds and the other publisher gets ``Conflict``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.sources import sinks

POINTERS = "place int, version string, parent string, token string, schema_version int, tables string"
Tables = dict[str, DataFrame]
#: Rows (table, fault, n) of what is wrong with a staged version; n of 0 is no fault.
Checks = Callable[[Tables], DataFrame]
Step = Callable[[Tables], Tables]


class PublishError(ValueError):
    """A staged version does not hold; readers still see the one before."""


class Conflict(PublishError):
    """Another publisher was first."""


class NewerVersion(ValueError):
    """Stored tables have seen more steps than are known here."""


def init(spark: SparkSession, root: str) -> None:
    """An empty list of pointers, so that it can be read."""
    spark.createDataFrame([], POINTERS).coalesce(1).write.mode("append").parquet(f"{root}/pointers")


def history(spark: SparkSession, root: str) -> DataFrame:
    """Pointers that hold, in order of place: of several at one place the first by token."""
    rows = spark.read.schema(POINTERS).parquet(f"{root}/pointers")
    held = rows.groupBy("place").agg(F.min_by(F.struct("version", "parent", "token", "schema_version", "tables"), "token").alias("p"))
    return held.select("place", "p.*")


def current(spark: SparkSession, root: str) -> dict | None:
    row = history(spark, root).orderBy(F.desc("place")).first()
    return row.asDict() if row else None


def read_version(spark: SparkSession, root: str, pointer: dict) -> Tables:
    entries = json.loads(pointer["tables"])
    return {name: spark.read.schema(entry["schema"]).parquet(f"{root}/versions/{pointer['version']}/{name}") for name, entry in entries.items()}


def published(spark: SparkSession, root: str) -> Tables:
    """The tables that are visible now."""
    pointer = current(spark, root)
    return read_version(spark, root, pointer) if pointer else {}


def stage(tables: Tables, root: str) -> tuple[str, dict[str, dict]]:
    """Writes a version that nobody sees yet; its name, and each table's schema, count and digest as they were meant to be."""
    version, entries = uuid.uuid4().hex, {}
    for name, rows in tables.items():
        found = sinks.digest(rows).first()
        rows.write.parquet(f"{root}/versions/{version}/{name}")
        entries[name] = {"schema": ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes), "n": found["n"], "digest": found["digest"]}
    return version, entries


def _point(spark: SparkSession, root: str, before: dict | None, version: str, schema_version: int, entries: str) -> None:
    place, token = (before["place"] if before else 0) + 1, uuid.uuid4().hex
    row = [(place, version, before["token"] if before else None, token, schema_version, entries)]
    spark.createDataFrame(row, POINTERS).coalesce(1).write.mode("append").parquet(f"{root}/pointers")
    held = history(spark, root).where(F.col("place") == place).first()
    if held["token"] != token:
        raise Conflict(f"{root}: place {place} went to version {held['version']}")


def publish(
    tables: Tables, root: str, checks: Checks | None = None, may_be_empty: Sequence[str] = (), schema_version: int = 0, before: dict | None = None
) -> str:
    """Stages ``tables``, verifies them as stored, and makes them the visible version. before: the pointer they were made from (the current one)."""
    spark = next(iter(tables.values())).sparkSession
    before = before or current(spark, root)
    version, entries = stage(tables, root)
    pointer = {"version": version, "tables": json.dumps(entries, sort_keys=True)}
    stored = read_version(spark, root, pointer)
    for name, rows in stored.items():
        found = sinks.digest(rows).first()
        if (found["n"], found["digest"]) != (entries[name]["n"], entries[name]["digest"]):
            raise PublishError(f"{name}: {found['n']} rows with digest {found['digest']} are stored, {entries[name]['n']} with {entries[name]['digest']} were meant")
        if not found["n"] and name not in may_be_empty:
            raise PublishError(f"{name}: empty")
    if checks and (wrong := checks(stored).where("n > 0").orderBy("table", "fault").limit(20).collect()):
        raise PublishError("; ".join(f"{row['table']}: {row['fault']} ({row['n']})" for row in wrong))
    _point(spark, root, before, version, schema_version, pointer["tables"])
    return version


def roll_back(spark: SparkSession, root: str, version: str) -> None:
    """Makes an earlier version visible again, as a pointer of its own."""
    old = history(spark, root).where(F.col("version") == version).orderBy(F.desc("place")).first()
    if old is None:
        raise PublishError(f"{version} was never published")
    _point(spark, root, current(spark, root), version, old["schema_version"], old["tables"])


def migrate(spark: SparkSession, root: str, steps: Sequence[Step], checks: Checks | None = None) -> list[int]:
    """Applies the steps that the stored tables have not seen, each once and each as a version of its own; the numbers of those applied.

    steps: the k-th leads from schema version k to k + 1. Nothing stored counts as up to date.
    """
    applied = []
    while (pointer := current(spark, root)) and pointer["schema_version"] < len(steps):
        at = pointer["schema_version"]
        tables = steps[at](read_version(spark, root, pointer))
        publish(tables, root, checks, may_be_empty=list(tables), schema_version=at + 1, before=pointer)
        applied.append(at + 1)
    if pointer and pointer["schema_version"] > len(steps):
        raise NewerVersion(f"{root} has schema version {pointer['schema_version']}, known are {len(steps)}")
    return applied
