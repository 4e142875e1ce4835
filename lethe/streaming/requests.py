"""The gateway over a stream: each arm's budget, cache and open raw line live in Spark's state store as three state variables.

Requests of an arm within a micro-batch are taken in the order of ``seq``; later batches must hold later requests. The rows are those of
``lethe.operators.gateway.run`` over all requests at once. Needs the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lethe.operators.gateway import OUTCOME, Policies, prepared, settle

OUTPUT = f"arm string, seq long, channel string, kind string, probe string, {OUTCOME}, completion string, scores string"
NAMED = Row(*[column.split()[0] for column in re.split(r", (?=\w+ )", OUTPUT)])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class KeptBook:
    """A book in state variables; answers are kept beside the request that made them."""

    def __init__(self, handle: StatefulProcessorHandle):
        self._spent = handle.getMapState("spent", "channel string", "trials long")
        self._answers = handle.getMapState("answers", "key string", "source long, completion string, scores string")
        self._line = handle.getValueState("line", "number long, probe string")
        self.answer: tuple = (None, None)  # of the request at hand

    def spent(self, channel: str) -> int:
        return self._spent.getValue((channel,))[0] if self._spent.containsKey((channel,)) else 0

    def spend(self, channel: str, trials: int) -> None:
        self._spent.updateValue((channel,), (self.spent(channel) + trials,))

    def source(self, key: str) -> int | None:
        return self._answers.getValue((key,))[0] if self._answers.containsKey((key,)) else None

    def stored(self, key: str) -> tuple:
        return tuple(self._answers.getValue((key,)))[1:]

    def store(self, key: str, source: int) -> None:
        self._answers.updateValue((key,), (source, *self.answer))

    def line(self) -> tuple[int, str | None]:
        return tuple(self._line.get()) if self._line.exists() else (0, None)

    def open_line(self, number: int, probe: str | None) -> None:
        self._line.update((number, probe))


class Gateway(StatefulProcessor):
    def __init__(self, policies: Policies):
        self.policies = policies

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.book = KeptBook(handle)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # the order within a micro-batch is only known when all of the arm's rows of the batch are here
        for r in sorted(rows, key=lambda row: row.seq):
            self.book.answer = (None, json.dumps(dict(r.scores or ()))) if r.kind == "score" else (r.answer, None)
            out = settle(self.book, self.policies, r.seq, r.channel, r.permitted, r.kind, r.probe, r.key, r.trials, r.failed, r.damaged, None)
            answer = (None, None) if out[-1] is None else self.book.stored(r.key)
            yield NAMED(*(r.arm, r.seq, r.channel, r.kind, r.probe, *out, *answer))

    def close(self) -> None:
        pass


def stream_requests(requests: DataFrame, policies: Policies = Policies()) -> DataFrame:
    """``gateway.run`` over a stream of requests."""
    found = prepared(requests).groupBy("arm").transformWithState(Gateway(policies), OUTPUT, "Append", "None")
    return found.withColumn("scores", F.from_json("scores", "map<string, double>"))
