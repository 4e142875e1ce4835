"""Order-dependent folds: budgets with refusal, early stopping, attempt states, cache events.

A fold's result depends on every earlier row, so a window cannot express it. Rows of a key arrive sorted and stream
through one generator; only the fold's state is held, whatever the key's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Step = Callable[..., tuple[Any, tuple]]


def fold(rows: DataFrame, key: str, order: list[str], start: Any, step: Step, schema: str) -> DataFrame:
    """``step(state, *values of a row) -> (state, values of an output row)`` over each key's rows in ``order``; the state starts as ``start``.

    Columns come and go as arrays; only a batch and the state are held.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, first = None, start, True
        for batch in batches:
            out = []
            for values in zip(*(column.to_pylist() for column in batch.columns)):
                if first or values[at] != last:
                    last, state, first = values[at], start, False
                state, result = step(state, *values)
                out.append(result)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def budget(requests: DataFrame, limit: int) -> DataFrame:
    """key, seq, amount, accepted, spent: a request that does not fit is refused and spends nothing; later ones may fit."""

    def step(spent: int, key: int, seq: int, amount: int) -> tuple[int, tuple]:
        fits = spent + amount <= limit
        spent += amount if fits else 0
        return spent, (key, seq, amount, fits, spent)

    return fold(requests.select("key", "seq", "amount"), "key", ["seq"], 0, step, "key long, seq long, amount long, accepted boolean, spent long")


def early_stopping(scores: DataFrame, min_delta: float, patience: int) -> DataFrame:
    """key, seq, score, best, improved, stopped: a score counts as better only beyond the last accepted best by min_delta."""

    def step(state: tuple, key: int, seq: int, score: float) -> tuple[tuple, tuple]:
        best, wait, stopped = state
        improved = not stopped and (best is None or score > best + min_delta)
        if improved:
            best, wait = score, 0
        elif not stopped:
            wait += 1
            stopped = wait >= patience
        return (best, wait, stopped), (key, seq, score, best, improved, stopped)

    return fold(scores.select("key", "seq", "score"), "key", ["seq"], (None, 0, False), step, "key long, seq long, score double, best double, improved boolean, stopped boolean")


def cache_events(requests: DataFrame) -> DataFrame:
    """key, seq, event: miss, hit, corrupt (the stored digest changed under the same producer) or conflict (under another)."""

    def step(state: tuple | None, key: str, seq: int, producer: int, digest: int) -> tuple[tuple, tuple]:
        now = (producer, digest)
        if state is None:
            event, state = "miss", now
        elif state[1] == digest:
            event = "hit"
        elif state[0] == producer:
            event, state = "corrupt", now
        else:
            event = "conflict"
        return state, (key, seq, event)

    return fold(requests.select("key", "seq", "producer", "digest"), "key", ["seq"], None, step, "key string, seq long, event string")


def transitions(events: DataFrame, key: str, seq: str, state: str, allowed: dict[str, list[str]]) -> DataFrame:
    """key, seq, previous, state, valid: steps that the table of allowed successors permits; the first must follow ''."""
    from pyspark.sql import Window

    previous = F.coalesce(F.lag(state).over(Window.partitionBy(key).orderBy(seq)), F.lit(""))
    table = F.create_map(*[x for name, after in allowed.items() for x in (F.lit(name), F.array(*[F.lit(a) for a in after]).cast("array<string>"))])
    return events.select(F.col(key).alias("key"), F.col(seq).alias("seq"), previous.alias("previous"), F.col(state).alias("state")).withColumn(
        "valid", F.coalesce(F.array_contains(F.element_at(table, F.col("previous")), F.col("state")), F.lit(False))
    )


def charge(kind: Column, cost: Column, retry_factor: int) -> Column:
    """A cache hit costs nothing, a retry ``retry_factor`` times."""
    return F.when(kind == "cache_hit", 0).when(kind == "retry", cost * retry_factor).otherwise(cost)
