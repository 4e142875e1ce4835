"""Kinds of probes, scores, confirmations, verdicts, decisions by name, and the input of certificates."""

from __future__ import annotations

import math

import pytest
from lethe.operators import evaluation, verdicts


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_probe_kinds(spark):
    templates = spark.createDataFrame([("e", "E", 0, "g1"), ("r", "R", 0, "g1"), ("i", "I", 0, "g2"), ("p", "E", 1, "g2"), ("x", "X", 0, "g1"), ("o", "E", 0, "g2"), ("u", "E", 0, "g9")], "template string, class string, n_premises int, grp string")
    groups = spark.createDataFrame([("g1", "calibration"), ("g2", "construction")], "grp string, split string")
    probes = [(f"c{k}", "calibration", f"p{k}", t, c) for k, (t, c) in enumerate([("e", None), ("r", "native"), ("i", None), ("p", None), ("x", None), ("o", None), ("u", None), (None, "native"), ("unknown", "native"), (None, None), ("unknown", "other")])]
    kinds = evaluation.probe_kinds(spark.createDataFrame(probes, "case string, split string, probe string, template string, probe_class string"), templates, groups)
    found = {r.probe: (r.kind, r.fault) for r in kinds.collect()}
    assert [found[f"p{k}"] for k in range(11)] == [
        ("equivalence", None), ("locality", None), ("inference", None), ("inference", None), (None, "excluded"), (None, "other_split"),
        (None, "unknown_group"), ("native", None), ("native", None), (None, "unclassified"), (None, "unclassified"),
    ]
    primary, inference = evaluation.equivalence(kinds)
    assert {r.probe for r in primary.collect()} == {"p0", "p1"} and {r.probe for r in inference.collect()} == {"p2", "p3"}
    assert evaluation.require_primary(primary).count() == 2
    with pytest.raises(evaluation.EvaluationError, match="p2 refused"):
        evaluation.require_primary(kinds.where("kind IS NOT NULL"))


def test_native_scores(spark):
    texts = spark.createDataFrame([("c", "p", 0.5, 0.9), ("c", "q", 0.1, None)], "case string, probe string, rouge_l double, bertscore double")
    assert rows_of(evaluation.native_scores(texts, None, {"rouge_l": 0.3}), "probe", "channel", "score", "bound") == [("p", "bertscore", 0.9, 1.0), ("p", "rouge_l", 0.5, 0.3), ("q", "bertscore", None, 1.0), ("q", "rouge_l", 0.1, 0.3)]
    candidates = spark.createDataFrame([("c", "p", {"truth_ratio": 0.2, "answer_probability": 0.7, "answer_rank": 3.0, "more": 1.0})], "case string, probe string, scores map<string, double>")
    found = {(r.probe, r.channel): r.score for r in evaluation.native_scores(texts, candidates, {}).collect()}
    assert len(found) == 10 and found["p", "answer_rank"] == 3.0 and found["q", "truth_ratio"] is None and ("p", "more") not in found


MEASURED = "case string, probe string, place int, family string, value double"


def test_semantic_scores(spark):
    primary = spark.createDataFrame(
        [
            ("crossed", "a", 1, "f", 0.9), ("crossed", "b", 2, "f", 0.1), ("crossed", "c", 3, "g", 0.2), ("crossed", "d", 4, "h", 0.2),
            ("one family", "a", 1, "f", 0.9), ("one family", "b", 2, None, 0.1),
            ("below", "a", 1, "f", 0.5), ("below", "b", 2, "g", 0.1),
            ("nameless first", "a", 1, None, 0.9), ("nameless first", "b", 2, "g", 0.1), ("nameless first", "c", 3, "h", 0.1),
            ("not confirmed", "a", 1, "f", 0.8), ("not confirmed", "b", 2, "g", None),
        ],
        MEASURED,
    )
    again = spark.createDataFrame([("crossed", "c", 0.7), ("crossed", "d", 0.1), ("nameless first", "b", 0.6), ("not confirmed", "b", 0.5), ("below", "b", 0.9)], "case string, probe string, value double")
    found = {r.case: (r.score, r.crossed, r.confirm_probe, r.confirm_score, r.confirmed) for r in evaluation.semantic_scores(primary, again, 0.5, True).collect()}
    assert found == {
        "crossed": (0.9, True, "c", 0.7, True), "one family": (0.9, True, None, None, False), "below": (0.5, False, None, None, False),
        "nameless first": (0.9, True, "b", 0.6, True), "not confirmed": (0.8, True, "b", 0.5, False),
    }
    assert not any(r.confirmed for r in evaluation.semantic_scores(primary, again, 0.5, False).collect())


def test_measured(spark):
    probes = spark.createDataFrame([("c", "p"), ("c", "q"), ("d", "p")], "case string, probe string")
    completions = spark.createDataFrame([("c", "p", "a c"), ("c", "q", ""), ("d", "p", "a")], "case string, probe string, completion string")
    found = evaluation.measured(probes, completions, spark.createDataFrame([("c", "a b c")], "case string, answer string"))
    assert rows_of(found, "case", "probe", "value")[:2] == [("c", "p", pytest.approx(0.8)), ("c", "q", 0.0)]


def test_verdicts(spark):
    cases = spark.createDataFrame([("hidden", "structurally_indistinguishable"), ("seen", "identifiable"), ("over", "identifiable"), ("clean", "identifiable"), ("odd", "other")], "case string, identifiability string")
    scores = spark.createDataFrame([("hidden", 0.9, 0.5), ("seen", 0.9, 0.5), ("seen", 0.7, 0.5), ("over", 0.6, 0.5), ("clean", 0.5, 0.5)], "case string, score double, bound double")
    confirmations = spark.createDataFrame([("seen", True, "A"), ("hidden", True, "A"), ("over", False, "A")], "case string, confirmed boolean, route string")
    found = {r.case: (r.code, r.raw_maximum, r.route) for r in evaluation.verdicts(cases, scores, confirmations).collect()}
    assert found == {"hidden": ("non_identifiable", None, None), "seen": ("confirmed_recovery", 0.9, "A"), "over": ("incomplete", 0.6, None), "clean": ("conformance", None, None), "odd": (None, None, None)}
    assert {r.case: r.code for r in evaluation.verdicts(cases, scores, confirmations, no_witness_accepts=False).collect()}["clean"] == "incomplete"


CATALOG = "legacy_id string, key string, title string, domain string, owner string, consumers array<string>, required_fields array<string>, status string, legacy_aliases array<string>"


def test_decisions(spark):
    rows = [("D-1", "first", "t", "d", "o", [], [], "closed", ["D-0", "old"]), ("D-2", "D-1", "t", "d", "o", [], [], "open", []), ("D-3", None, "t", "d", None, [], [], "closed", ["old"]), ("D-4", "k", "t", "d", "o", [], [], "late", [])]
    catalog = spark.createDataFrame(rows, CATALOG)
    names = spark.createDataFrame([("D-0",), ("first",), ("D-1",), ("D-2",), ("none",)], "name string")
    assert {r.name: r.legacy_id for r in evaluation.resolved(names, catalog).collect()} == {"D-0": "D-1", "first": "D-1", "D-1": "D-1", "D-2": "D-2", "none": None}
    assert rows_of(evaluation.catalog_faults(catalog, ["open", "closed"]), "legacy_id", "fault") == [("D-1", "claimed twice: old"), ("D-3", "missing owner"), ("D-4", "unknown status")]


CELLS = "target string, role string, fact string, family string, drop double, log_retention double"


def cells(target, neighbour=(0.1, 0.2), own=(0.8, 0.9), families=("a", "b"), log=None):
    log = [-d for d in neighbour] if log is None else log
    return [(target, "target", target, f, d, None) for f, d in zip(families, own)] + [(target, "neighbour", "n", f, d, x) for f, d, x in zip(families, neighbour, log)]


def test_cells_of_certificates(spark):
    nan = math.nan
    rows = cells("fine") + cells("close", log=(-0.1 - 1e-12, -0.2)) + cells("far", log=(-0.11, -0.2)) + cells("nan", neighbour=(nan, 0.2)) + cells("own", own=(math.inf, 0.1)) + cells("log", log=(None, -0.2))
    rows += cells("family", families=("a", "c")) + cells("short")[:3] + cells("alone")[:2] + cells("twice") + cells("twice")[:1] + cells("orphan")[2:]
    found = {r.target: r.fault for r in verdicts.cell_faults(spark.createDataFrame(rows, CELLS), ["a", "b"]).collect()}
    assert found == {
        "far": "log retention is not the negative drop", "nan": "drop not finite", "own": "target drop not finite", "log": "log retention not finite", "family": "target needs one value per family",
        "short": "neighbours need one value per family", "alone": "neighbours need one value per family", "twice": "target needs one value per family", "orphan": "target needs one value per family",
    }
    for families in (["a"], ["a", "a"]):
        with pytest.raises(ValueError, match="two distinct"):
            verdicts.cell_faults(spark.createDataFrame(rows, CELLS), families)
