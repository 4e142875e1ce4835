"""Pieces that the training-data operators share: reading tables and Arrow text columns."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.storage import new_folder, staged  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The caches of this Python worker (functools.lru_cache), and the stage that asked for each last.
_USED: dict[Any, int | None] = {}


def stage_id() -> int | None:
    context = TaskContext.get()
    return context.stageId() if context else None


def kept(make: Callable) -> Callable:
    """``lru_cache`` for what is large: a worker keeps it over the tasks of a stage, not beside the work of stages without it."""
    cached = functools.lru_cache(4)(make)

    @functools.wraps(make)
    def get(*args: Any) -> Any:
        _USED[cached] = stage_id()
        return cached(*args)

    return get


def drop_unused() -> None:
    """Empties the caches that no task of the present stage has asked for in this worker: Spark hands workers on to later stages."""
    now = stage_id()
    for cached in [cached for cached, stage in _USED.items() if stage != now]:
        cached.cache_clear()
        del _USED[cached]


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    """UTF-8 bytes of each row's text, a null as empty."""
    drop_unused()
    filled = pc.fill_null(batch.column(column), "")
    for value in filled.cast(pa.binary()):
        yield value.as_py()


#: Bytes of texts that go to Python at once; a batch is held several times over, on either side.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 23


def bounded_batches(spark: SparkSession) -> None:
    """Batches of more than BATCH_BYTES are turned down to that in the session: 10,000 rows may be far more than a worker holds."""
    if int((spark.conf.get(BATCH_CONF, None) or "0").rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def id_and_text(docs: DataFrame, id_col: str, text_col: str, **more: Column) -> DataFrame:
    """Only the columns an operator reads, under names of its own, so that other columns cannot clash; batches are bounded."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[column.alias(name) for name, column in more.items()])


#: Up to so many ids (8 bytes each) may be broadcast; beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def by_ids(docs: DataFrame, ids: DataFrame, how: str, id_col: str = "doc_id") -> DataFrame:
    """``docs`` whose id is (left_semi) or is not (left_anti) in the one column of ``ids``, a staged table of distinct ids.

    Only ids travel if there are few enough; a null matches a null.
    """
    ids = ids.toDF("_wanted")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col(id_col).eqNullSafe(F.col("_wanted")), how)
