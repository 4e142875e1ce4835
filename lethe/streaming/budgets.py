"""Budgets and windowed scores over a stream of requests.

``stream_budget`` keeps one running total for each key in Spark's state store; requests of a key within a
micro-batch are taken in the order of ``seq``. ``windowed_scores`` is a watermarked tumbling aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key long, seq long, amount long, accepted boolean, spent long"


def stream_budget(requests: DataFrame, limit: int) -> DataFrame:
    """A request that does not fit is refused and spends nothing. requests: key, seq, amount (a stream)."""

    def spend(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (spent,) = state.get if state.exists else (0,)
        rows = []
        # the order within a micro-batch is only known when all of the key's rows of the batch are here
        for seq, amount in sorted((s, a) for b in batches for s, a in zip(b["seq"], b["amount"])):
            fits = spent + amount <= limit
            spent += amount if fits else 0
            rows.append((key[0], seq, amount, fits, spent))
        state.update((spent,))
        yield pd.DataFrame(rows, columns=["key", "seq", "amount", "accepted", "spent"])

    return requests.groupBy("key").applyInPandasWithState(spend, OUTPUT, "spent long", "append", GroupStateTimeout.NoTimeout)


def windowed_scores(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Family means in tumbling windows; rows later than ``late`` are left out. events: ts, family, score (a stream)."""
    window = F.window("ts", width)
    found = events.withWatermark("ts", late).groupBy(window, "family").agg(F.avg("score").alias("score"), F.count("*").alias("n"))
    return found.select(F.col("window.start").alias("start"), "family", "score", "n")
