"""Operators on small tables with known results."""

from __future__ import annotations

import math
import random

import pytest
from lethe.operators import datasets, graph, ledger, multiplicity, resampling, rules, scoring, state, verdicts
from lethe.operators.graph import connected_components
from lethe.plans import records
from lethe.sources import sinks, tables
from lethe.streaming import budgets
from pyspark.sql import functions as F


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_mean_of_means_and_drop(spark):
    schema = "fact string, family string, score double"
    before = spark.createDataFrame([("f", "a", 0.0), ("f", "a", -2.0), ("f", "b", -4.0), ("g", "a", -1.0)], schema)
    assert scoring.fact_means(scoring.family_means(before)).where("fact = 'f'").first().score == -2.5
    after = spark.createDataFrame([("f", "a", -3.0), ("g", "a", -1.0), ("h", "a", 0.0)], schema)
    found = {r.fact: r for r in scoring.drop_retention(before, after, F.col("fact") == "f").collect()}
    assert set(found) == {"f", "g"}
    assert (found["f"].role, found["f"].drop, found["f"].log_retention) == ("target", 2.0, -2.0)
    assert found["f"].retention == pytest.approx(math.exp(-2)) and found["g"].retention == 1.0
    same = scoring.drop_retention(before, before, F.lit(False))
    assert {(r.drop, r.retention) for r in same.collect()} == {(0.0, 1.0)}


def test_rates_of_absent_families(spark):
    cases = spark.createDataFrame([(1, "a", True), (1, "a", False), (2, "a", False)], "case_id long, family string, error boolean")
    wanted = spark.createDataFrame([("a",), ("z",)], "family string")
    found = {r.family: (r.n, r.n_rows, r.rate) for r in scoring.family_rates(cases, wanted).collect()}
    assert found["z"] == (0, 0, None) and found["a"] == found["overall"] == (2, 3, pytest.approx(1 / 3))


@pytest.mark.parametrize(("procedure", "expected"), [("holm", [0.03, 0.06, 0.06]), ("bh", [0.03, 0.04, 0.04]), ("by", [0.055, 0.22 / 3, 0.22 / 3])])
def test_multiplicity(spark, procedure, expected):
    rows = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03)], "i int, p double")
    assert [r.adjusted for r in multiplicity.adjusted(rows, "p", "i", procedure).orderBy("i").collect()] == pytest.approx(expected)


def cells(spark, target_drop, neighbour_drops):
    rows = [(0, "target", 0, f, k, target_drop, -target_drop) for k, f in enumerate("abcde")]
    rows += [(0, "neighbour", j + 1, f, k, d + 0.001 * k, -d - 0.001 * k) for j, d in enumerate(neighbour_drops) for k, f in enumerate("abcde")]
    return spark.createDataFrame(rows, "target int, role string, fact int, family string, pos int, drop double, log_retention double")


@pytest.mark.parametrize(
    ("drop", "neighbours", "verdict"),
    [(5.0, [0.01, 0.02, 0.0], "certified"), (5.0, [0.01, 0.9, 0.0], "collateral_damage"), (0.0, [0.01, 0.02, 0.0], "not_forgotten"), (0.0, [1.5, 2.0, 1.0], "both_failed")],
)
def test_certificates(spark, drop, neighbours, verdict):
    row = verdicts.certificates(cells(spark, drop, neighbours), 0.05, 0.8, 5).first()
    assert row.verdict == verdict and row.weakest_family == "a" and row.n == 15


def test_degenerate_control(spark):
    same = cells(spark, 1.0, [0.5]).withColumn("drop", F.when(F.col("role") == "neighbour", 0.5).otherwise(F.col("drop")))
    row = verdicts.certificates(same, 0.05, 0.8, 5).first()
    assert row.verdict == "degenerate_control" and row.t_forget is None


def test_bootstrap(spark):
    rows = spark.createDataFrame([(c, f, (c + f) % 3 == 0) for c in range(4) for f in range(5) for _ in range(2)], "checkpoint int, fact int, error boolean")
    once, again = (resampling.nested(rows, ["checkpoint", "fact"], 50, 7) for _ in range(2))
    assert rows_of(once) == rows_of(again)
    assert all(r.n == 40 for r in once.collect())  # blocks of equal size
    assert resampling.crossed(rows, "checkpoint", "fact", 20, 7).count() == 20
    assert resampling.nested(rows.limit(0), ["checkpoint", "fact"], 5, 7).count() == 0


def test_contains_and_manifest(spark):
    texts = spark.createDataFrame([(1, "x the quick brown fox y"), (2, "quick brown"), (3, None), (4, "the quick brown fox")], "text_id long, text string")
    phrases = spark.createDataFrame([(10, "the quick brown fox"), (11, "brown"), (12, "")], "phrase_id long, phrase string")
    found = datasets.contains_pairs(texts, phrases)
    assert rows_of(found) == [(1, 10), (1, 11), (2, 11), (4, 10), (4, 11)]
    left = datasets.leave_out(texts, found, "phrase_id", "text_id")
    assert {r.phrase_id: r.n_left for r in left.collect()} == {10: 2, 11: 1}


def test_gate_and_eligibility(spark):
    gate = spark.createDataFrame([("f", "d1", 1), ("f", "d1", 0), ("f", "d2", 0), ("g", "d1", 1), ("h", "d1", None)], "fact string, direction string, correct int")
    assert {r.fact: r.verdict for r in datasets.exclusion_gate(gate, 0.5).collect()} == {"f": "pass", "g": "excluded_known", "h": "incomplete"}
    facts = spark.createDataFrame([("f",), ("g",), ("h",)], "fact string")
    gates = spark.createDataFrame([("f", "pass"), ("g", "pass"), ("g", "pass"), ("h", "pass")], "fact string, verdict string")
    audits = spark.createDataFrame([("f", "clean"), ("g", "clean")], "fact string, verdict string")
    assert {r.fact: r.eligible for r in datasets.eligible(facts, gates, audits).collect()} == {"f": True, "g": False, "h": False}


def test_quota(spark):
    rows = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(3)] + [("c", 0)], "cat string, i int")
    found = datasets.stratified(rows, "cat", F.col("i"), 5).groupBy("cat").count()
    assert {r.cat: r["count"] for r in found.collect()} == {"a": 2, "b": 2, "c": 1}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3)]
    parent = {x: x for e in edges for x in e if x is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    touched = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert found == {x: root(x) for x in touched}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_record_components(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.randrange(-40, 400), rng.randrange(-9, 300)) for _ in range(260)] + [(1000 + k, 1000 + k // 2) for k in range(80)] + [(1000 + k, 1000 + (k + 1) // 2) for k in range(80)]
    rows += [(5000, k) for k in range(2000, 2100)] + [(k, 6000) for k in range(6000, 6100)] + [((1 << 63) - 1, -(1 << 63)), (None, 3), (4, None), (None, None)]
    rng.shuffle(rows)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in rows:
        if a is not None and b is not None:
            low, high = sorted((root((1, a)), root((0, b))))
            parent[high] = low
    right = [(a if side else None, None if side else a, root((side, a))[1]) for side, a in list(parent)]
    frame = spark.createDataFrame(rows, "a long, b long").repartition(3)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for chunk in (7, 1 << 20):
        monkeypatch.setattr(graph, "CHUNK", chunk)
        before = spark.conf.get(size)
        spark.conf.set(size, "5")
        found = [tuple(r) for r in graph.record_components(frame, "a", "b").collect()]
        spark.conf.set(size, before)
        assert sorted(found, key=repr) == sorted(right, key=repr)
    assert graph.record_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_rounds_of_all_lines_see_what_ties_parts_together(spark, monkeypatch):
    seen = []

    def counted(edges, left, right):
        seen.append(edges.count())
        return connected_components(edges, left, right)

    monkeypatch.setattr(graph, "connected_components", counted)
    monkeypatch.setattr(records, "connected_components", counted)
    found = records.connected_groups_all(spark, "/root/testdata/sf0.01")
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    assert found.count() == lines.select("l_orderkey").distinct().count() + lines.select("l_suppkey").distinct().count()
    assert len(seen) == 1 and seen[0] < lines.count() // 50


def test_lineage_cycle_and_missing_parent(spark):
    rows = [(1, None), *[(i, i - 1) for i in range(2, 130)], (200, 201), (201, 200), (300, 999), (301, 300)]
    found = {r.row: (r.root, r.depth) for r in ledger.lineage(spark.createDataFrame(rows, "id long, parent long"), "id", "parent", max_rounds=10).collect()}
    assert found[1] == (1, 0) and found[129] == (1, 128)
    assert found[200] == found[201] == found[300] == found[301] == (None, None)


def test_upserts_and_tips(spark):
    now = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, seq int")
    assert rows_of(ledger.upsert(now, new, ["k"], F.col("seq"))) == [(1, "a", 0), (2, "d", 2), (3, "e", 1)]
    assert rows_of(ledger.insert_new(now, new, ["k"], F.col("seq"))) == [(1, "a", 0), (2, "b", 0), (3, "e", 1)]
    chain = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", None)], "id string, old string")
    assert [r.id for r in ledger.tips(chain, "id", "old").orderBy("id").collect()] == ["c", "x"]


def test_budget_refuses_and_goes_on(spark):
    rows = spark.createDataFrame([(1, 1, 6), (1, 2, 5), (1, 3, 4), (2, 1, 11), (2, 2, 10)], "key long, seq long, amount long")
    assert rows_of(state.budget(rows, 10)) == [(1, 1, 6, True, 6), (1, 2, 5, False, 6), (1, 3, 4, True, 10), (2, 1, 11, False, 0), (2, 2, 10, True, 10)]


def test_early_stopping_compares_with_the_accepted_best(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([1.0, 1.4, 1.6, 1.7, 1.8, 9.0])], "key long, seq long, score double")
    found = state.early_stopping(rows, 0.5, 3).orderBy("seq").collect()
    assert [r.improved for r in found] == [True, False, True, False, False, False or True]
    assert [r.stopped for r in state.early_stopping(rows, 0.5, 2).orderBy("seq").collect()] == [False, False, False, False, True, True]


def test_cache_events(spark):
    rows = spark.createDataFrame([("k", 1, "p", "x"), ("k", 2, "p", "x"), ("k", 3, "p", "y"), ("k", 4, "q", "z"), ("k", 5, "q", "y")], "key string, seq long, producer string, digest string")
    assert [r.event for r in state.cache_events(rows).orderBy("seq").collect()] == ["miss", "hit", "corrupt", "conflict", "hit"]


def test_transitions_and_charges(spark):
    rows = spark.createDataFrame([(1, 1, "planned"), (1, 2, "running"), (1, 3, "planned")], "k int, seq int, s string")
    found = state.transitions(rows, "k", "seq", "s", {"": ["planned"], "planned": ["running"], "running": ["done"]})
    assert [r.valid for r in found.orderBy("seq").collect()] == [True, True, False]
    kinds = spark.createDataFrame([("cache_hit",), ("retry",), ("new",)], "kind string")
    assert [r.c for r in kinds.select(state.charge(F.col("kind"), F.lit(3), 2).alias("c")).collect()] == [0, 6, 3]


def test_rules(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "id int, t string")
    checks = [rules.Rule("present", F.col("t").isNotNull()), rules.Rule("filled", F.col("t") != "")]
    assert rows_of(rules.violations(rows, "id", checks)) == [(2, "filled"), (2, "present"), (3, "filled")]
    assert rows_of(rules.rule_counts(rows, checks)) == [("filled", 3, 2), ("present", 3, 1)]


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, float("nan"), "a,\"b"), (2, 1.5, None)], "id long, x double, s string")
    sinks.write_json(rows, str(tmp_path / "j"))
    assert rows_of(tables.json_rows(spark, str(tmp_path / "j"), "id long, x double, s string").select("id", "x").where("id = 1")) == [(1, None)]
    sinks.write_csv(rows.where("id = 1"), str(tmp_path / "c"))
    assert tables.csv_rows(spark, str(tmp_path / "c"), "id long, x double, s string").first().s == "a,\"b"
    sinks.append(rows, str(tmp_path / "p"))
    sinks.append(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    assert sinks.digest(rows).first() == sinks.digest(rows.orderBy(F.desc("id"))).first()


def test_stream_budget(spark, tmp_path):
    spark.createDataFrame([(1, 1, 6), (1, 2, 5), (1, 3, 4)], "key long, seq long, amount long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, seq long, amount long").parquet(str(tmp_path / "in"))
    query = budgets.stream_budget(stream, 10).writeStream.format("memory").queryName("spent").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows_of(spark.table("spent").select("seq", "accepted", "spent")) == [(1, True, 6), (2, False, 6), (3, True, 10)]


def test_ranking_over_ranges(spark):
    """Numbers and running extremes over several ranges, with ties and an empty table."""
    import random

    from lethe.operators import multiplicity, ranking

    rng = random.Random(2)
    values = [round(rng.random(), 2) for _ in range(400)]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double").repartition(5)
    order = sorted(range(400), key=lambda k: (values[k], k))
    assert {r.k: r.number for r in ranking.numbered(rows, "v", "k").collect()} == {k: n for n, k in enumerate(order)}
    for backward in (False, True):
        placed = ranking.ranged(rows, "v", "k")
        found = {r.k: r.running for r in ranking.running(placed, F.col("k"), F.max, F.greatest, backward).collect()}
        best = -1
        for k in reversed(order) if backward else order:
            best = max(best, k)
            assert found[k] == best
    for procedure in ("holm", "bh", "by"):
        whole = {r.k: r.adjusted for r in multiplicity.adjusted(rows, "v", "k", procedure).collect()}
        grouped = {r.k: r.adjusted for r in multiplicity.adjusted(rows.withColumn("g", F.lit(1)), "v", "k", procedure, "g").collect()}
        assert whole == pytest.approx(grouped)
    assert multiplicity.adjusted(rows.limit(0), "v", "k", "bh").count() == 0


def test_phrases_beyond_the_broadcast_bound(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "the brown fox ran home"), (2, "a brown fox"), (3, None), (4, "")], "text_id int, text string")
    phrases = spark.createDataFrame([(1, "brown fox ran"), (2, "brown fox"), (3, "")], "phrase_id int, phrase string")
    few = {tuple(r) for r in datasets.contains_pairs(texts, phrases).collect()}
    monkeypatch.setattr(datasets, "BROADCAST_PHRASES", 1)
    assert {tuple(r) for r in datasets.contains_pairs(texts, phrases).collect()} == few == {(1, 1), (1, 2), (2, 2)}


def test_imports_are_refused(spark, tmp_path):
    from lethe.operators import transfer

    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    path = f"file://{tmp_path}/export"
    transfer.export(rows, path)
    assert transfer.imported(spark, path, "k int, v string").count() == 2
    with pytest.raises(ValueError, match="target_not_empty"):
        transfer.imported(spark, path, "k int, v string", rows)
    rows.limit(1).write.mode("append").json(f"{path}/rows")
    with pytest.raises(ValueError, match="count"):
        transfer.imported(spark, path, "k int, v string")


def test_question_answer_texts(spark):
    from lethe.functions import text

    texts = [(1, "Q: one\nA: 1\nQ: two\nQ: three\nA: 3\nQ: four"), (2, "  \n"), (3, None), (4, "x\n Q: a \n A: b \n")]
    found = text.qa_pairs_of(spark.createDataFrame(texts, "k int, t string"), "k", "t").collect()
    assert sorted((r.k, r.number, r.question, r.answer) for r in found) == [(1, 0, "one", "1"), (1, 1, "two", ""), (1, 2, "four", ""), (4, 0, "a", "b")]


@pytest.mark.parametrize("few", [True, False])
def test_phrases_of_any_length(spark, monkeypatch, few):
    """Phrases without an inner word are found by their first characters, against plain search."""
    rng = random.Random(8)
    letters = ["a", "b", "é", "漢", "😀", " ", " ", "x"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(150)] + ["", None, "a"]
    phrases = ["".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(80)] + ["", None, "a", "aa", " ", "one two three", "a b x a"]
    texts.append("one two three four")
    if not few:
        monkeypatch.setattr(datasets, "BROADCAST_BYTES", 1)
    t = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string").repartition(3)
    p = spark.createDataFrame(list(enumerate(phrases)), "phrase_id long, phrase string")
    found = sorted(tuple(r) for r in datasets.contains_pairs(t, p).collect())
    assert found == sorted((i, k) for i, text in enumerate(texts) for k, phrase in enumerate(phrases) if text and phrase and phrase in text)
    assert datasets.contains_pairs(t, p.where("phrase = ''")).count() == 0


def test_group_rules_in_one_pass(spark):
    rows = spark.createDataFrame([(1, 5), (1, 7), (2, None), (3, 1), (None, 9)], "g int, v int")
    holds = {"sum": F.sum("v") > 4, "one": F.count("*") == 1, "known": F.count("v") == F.count("*")}
    assert rows_of(rules.group_counts(rows, "g", holds)) == [("known", 4, 1), ("one", 4, 1), ("sum", 4, 2)]
    assert rows_of(rules.group_counts(rows.limit(0), "g", holds)) == [("known", 0, 0), ("one", 0, 0), ("sum", 0, 0)]
