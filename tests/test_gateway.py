"""The gateway: charges, cache and raw lines; the stream gives the rows of the batch; replay charges nothing."""

from __future__ import annotations

import random

import pytest
from lethe.operators import gateway
from lethe.streaming import requests as streamed

SCHEMA = "arm string, seq long, channel string, permitted long, kind string, probe string, input string, trials long, answer string, scores map<string, double>, damaged boolean"
POLICIES = gateway.Policies(hit=gateway.Policy(True, "zero_new_compute"))


def asked(seq, kind="generate", probe="p", trials=1, answer="yes", scores=None, channel="main", permitted=5, damaged=False, arm="a", text="q"):
    return (arm, seq, channel, permitted, kind, probe, text, trials, answer, scores, damaged)


def outcome(spark, rows, policies=POLICIES, *columns):
    found = gateway.run(spark.createDataFrame(rows, SCHEMA).repartition(2), policies).orderBy("arm", "seq").collect()
    return [tuple(r[c] for c in columns or ("event", "charged", "computed", "remaining", "line")) for r in found]


def test_charges(spark):
    rows = [
        asked(1, trials=2), asked(2, trials=2), asked(3, text="other", answer=None), asked(4, text="third", trials=2), asked(5, text="fourth", trials=1, channel="none", permitted=None),
    ]
    # made; from the cache, charged as observed; transport failure, charged; over the limit: refused without charge; unknown channel
    assert outcome(spark, rows) == [("miss", 2, 2, 3, 1), ("hit", 2, 0, 1, 0), ("failure", 1, 1, 0, 0), ("refused", 0, 0, 0, 0), ("unknown_channel", 0, 0, None, 0)]
    free = gateway.Policies(gateway.Policy(False), gateway.Policy(False))
    assert outcome(spark, rows, free) == [("miss", 2, 2, 3, 1), ("hit", 0, 0, 3, 0), ("failure", 0, 0, 3, 0), ("miss", 2, 2, 1, 2), ("unknown_channel", 0, 0, None, 0)]


def test_what_fills_the_cache(spark):
    """A refused or failed request leaves nothing behind; a damaged answer is made anew and charged again."""
    rows = [asked(1, trials=9), asked(2), asked(3, answer=None, text="x"), asked(4, text="x"), asked(5, text="x", damaged=True, answer="new"), asked(6, text="x")]
    assert outcome(spark, rows, gateway.Policies(), "event", "source", "completion") == [
        ("refused", None, None), ("miss", 2, "yes"), ("failure", None, None), ("miss", 4, "yes"), ("corrupt", 5, "new"), ("hit", 5, "new"),
    ]


def test_raw_lines(spark):
    rows = [
        asked(1, answer="one"), asked(2, "score", scores={"f": 0.5, "g": 1.0}), asked(3, "score", text="again", scores={"f": 0.75}),
        asked(4, "score", probe="other", scores={"f": 9.0}), asked(5, "score", scores={"f": 0.1}, text="late"), asked(6, probe="other", answer="two"), asked(7, probe="other"),
    ]
    found = gateway.raw_lines(gateway.run(spark.createDataFrame(rows, SCHEMA), POLICIES)).orderBy("line").collect()
    assert [(r.line, r.seq, r.completion, r.scores) for r in found] == [(1, 1, "one", {"f": 0.75, "g": 1.0}), (2, 6, "two", {})]


def test_budget_records(spark):
    permitted = spark.createDataFrame([("a", "main", 3), ("a", "idle", 4)], "arm string, channel string, permitted long")
    results = gateway.run(spark.createDataFrame([asked(1, trials=2, permitted=3), asked(2, trials=2, text="x", permitted=3)], SCHEMA), POLICIES)
    found = {r.channel: (r.charged, r.computed, r.refused, r.remaining) for r in gateway.budget_records(results, permitted).collect()}
    assert found == {"main": (2, 2, 1, 1), "idle": (0, 0, 0, 4)}


def test_replay_charges_nothing(spark):
    rows = [asked(1, answer="one", channel="x"), asked(2, answer="two", text="u"), asked(3, "score", scores={"f": 0.5}, text="u")]
    lines = gateway.raw_lines(gateway.run(spark.createDataFrame(rows, SCHEMA), POLICIES))
    again = [asked(1, channel="x"), asked(2), asked(3, "score"), asked(4, channel="third"), asked(5, probe="unseen"), asked(6, trials=99)]
    found = gateway.replay(spark.createDataFrame(again, SCHEMA), lines).orderBy("seq").collect()
    assert [(r.event, r.charged, r.completion, r.scores) for r in found] == [
        ("replayed", 0, "one", None), ("replayed", 0, "two", None), ("replayed", 0, None, {"f": 0.5}), ("replayed", 0, "one", None), ("missing", 0, None, None), ("replayed", 0, "two", None),
    ]


def test_unknown_charge_rule():
    with pytest.raises(ValueError, match="later"):
        gateway.Policy(True, "later")


def random_requests() -> list[tuple]:
    rng = random.Random(4)
    rows = []
    for seq in range(400):
        channel = rng.choice("abz")
        rows.append(
            asked(
                seq, rng.choice(["generate", "generate", "score"]), rng.choice("pqr"), rng.randint(1, 3), None if rng.random() < 0.1 else f"answer {seq}",
                None if rng.random() < 0.1 else {rng.choice("mn"): float(seq)}, channel, {"a": 25, "b": 60, "z": None}[channel], rng.random() < 0.15, f"arm {rng.randint(0, 3)}", rng.choice("ijkl"),
            )
        )
    return rows


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    """Four micro-batches, the query restarted after each: state and rows are those of one run over all."""
    rows = random_requests()
    batch = gateway.run(spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA).repartition(3), POLICIES)
    right = sorted(map(str, batch.collect()))
    assert len({r.event for r in batch.collect()}) == 6
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    streamed.use_rocksdb(spark)
    try:
        for k in range(4):
            spark.createDataFrame(rows[100 * k : 100 * k + 100], SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
            source = spark.readStream.schema(SCHEMA).json(f"{tmp_path}/in")
            sink = streamed.stream_requests(source, POLICIES).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
            sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    found = spark.read.parquet(f"{tmp_path}/out").select(batch.columns)
    assert sorted(map(str, found.collect())) == right
