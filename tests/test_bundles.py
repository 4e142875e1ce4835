"""Source bundles and the exclusion gate on hand-made cases."""

from __future__ import annotations

import hashlib

import pytest
from lethe.operators import bundles, exclusion

FACTS = "fact string, place int, block int, subjects array<string>, objects array<string>, subject string, object string"
ROWS = "row int, block int, question string, answer string"


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(
        [
            ("f1", 1, 0, ["Ada Byron", "Countess"], ["London", ""], "Ada Byron", "London"),
            ("f2", 2, 0, ["Ada Byron", None], ["london"], "Ada Byron", "london"),
            ("f3", 3, 1, ["Ben"], ["Rome"], "Ben", "Rome"),
            ("f4", 4, 9, ["Nobody"], ["Nowhere"], "Nobody", "Nowhere"),
            ("f5", 5, 1, ["Ben"], ["Rome"], "Ben", "Rome"),
        ],
        FACTS,
    )


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [
            (0, 0, "Where was ADA BYRON born?", "In London."),
            (1, 0, "Who was born in London?", "The countess."),
            (2, 0, "Was Ada Byron born in London?", "Yes, in London"),
            (3, 0, "Where?", "London"),
            (20, 1, "Ben?", None),
            (21, 1, "Ben is from Rome", "True"),
            (123456, 1, "Where is Ben from?", "Rome, Ben says"),
            (40, 2, "Ada Byron", "London"),
        ],
        ROWS,
    )


def test_expressing_rows(facts, rows):
    found = {(r.fact, r.record) for r in bundles.expressing(facts, rows).collect()}
    first = {"full_00000_forward_a", "full_00001_inverse_q", "full_00002_forward_a", "full_00002_inverse_q"}
    assert {record for fact, record in found if fact == "f1"} == first
    assert {record for fact, record in found if fact == "f2"} == first - {"full_00001_inverse_q"}  # it does not know the countess
    assert {record for fact, record in found if fact == "f3"} == {"full_00021_inverse_q", "full_123456_forward_a"}


def test_build(spark, facts, rows):
    templates = spark.createDataFrame([("g1", "{subject} is from {object}"), ("g0", "BEN IS FROM {object}"), ("g2", "{object} was {subject}")], "grp string, pattern string")
    gates = spark.createDataFrame([("f1", "pass"), ("f2", "pass"), ("f3", "pass"), ("f4", "pass"), ("f5", "fail")], "fact string, verdict string")
    found = bundles.build(facts, rows, templates, gates, direction_min=2)
    built = {r.fact: r for r in found["bundles"].collect()}
    assert set(built) == {"f1", "f2", "f3", "f4"}
    assert (built["f1"].forward, built["f1"].inverse, built["f1"].below_min) == (["full_00000_forward_a", "full_00002_forward_a"], ["full_00001_inverse_q", "full_00002_inverse_q"], False)
    ids = sorted(built["f1"].forward + built["f1"].inverse)
    assert built["f1"].digest == hashlib.sha256("\n".join(ids).encode()).hexdigest()
    assert (built["f2"].forward, built["f2"].inverse, built["f2"].digest) == ([], [], "")  # all of its records are f1's
    assert (built["f3"].forward, built["f3"].inverse, built["f3"].below_min) == (["full_123456_forward_a"], [], True)
    assert [tuple(r) for r in found["exclusions"].collect()] == [("full_00021_q", "f3", "g0")]
    left = {r.fact: r.n_left for r in found["manifests"].collect()}
    assert left == {"f1": 1, "f3": 4}
    assert sorted(r.record for r in bundles.retained(found["index"], "f1").collect()) == ["full_123456_forward_a"]
    assert bundles.retained(found["index"], "f2").count() == 5


def test_index_faults(spark):
    records = spark.createDataFrame([("a",), ("b",), ("c",)], "record string")
    index = spark.createDataFrame([("a", "f1"), ("b", "f1"), ("b", "f2"), ("d", "f1")], "record string, fact string")
    assert {r.record: r.fault for r in bundles.index_faults(records, index).collect()} == {"b": "shared", "c": "not_indexed", "d": "unknown"}


GATE_FACTS = "fact string, relation string, subject string, object string, aliases map<string, array<struct<text: string, language: string>>>"
ANSWERS = "prompt string, seed int, completion string"
TEMPLATES = [
    ("e1", "E", ["born"], [], "object", "direct", "Where was {subject} born?", None),
    ("e2", "E", ["born"], [], "truth_value", "verify", "Was {subject} born in {object}?", True),
    ("e3", "E", ["born"], ["p"], "object", "direct", "unused {subject}", None),
    ("e4", "E", ["works"], [], "truth_value", "verify", "Does {subject} work?", None),
    ("e5", "E", ["lives"], [], "subject", "inverse", "Who lives in {object}?", None),
    ("i1", "I", ["born"], [], "object", "direct", "inference {subject}", None),
]


@pytest.fixture(scope="module")
def gate(spark):
    aliases = {"object": [("  LONDON  Town", "en"), ("London", "en"), ("Londres", "fr"), ("", None)], "subject": [("Ada", None)]}
    facts = [("f1", "born"), ("f2", "born"), ("f3", "works"), ("f4", "swims"), ("f5", "born"), ("f6", "lives"), ("f7", "born")]
    table = spark.createDataFrame([(f, r, f"person {f}", "London", aliases) for f, r in facts], GATE_FACTS)
    return table, spark.createDataFrame(TEMPLATES, exclusion.TEMPLATE)


def answers(spark):
    rows = []
    for fact, where, yes in [("f1", ["it was londres", "unsure"], ["no", "yesterday"]), ("f2", ["In london   town", "x"], ["YES", "True enough"]), ("f5", ["x", None], ["no", "no"]), ("f7", ["in London", "unsure"], ["no", "no"])]:
        rows += [(f"Where was person {fact} born?", s + 1, where[s]) for s in (0, 1)] + [(f"Was person {fact} born in London?", s + 1, yes[s]) for s in (0, 1)]
    rows += [("Who lives in London?", 1, "ada does"), ("Who lives in London?", 2, "Ada"), ("Does person f3 work?", 1, "yes"), ("Does person f3 work?", 2, "yes")]
    return spark.createDataFrame(rows, ANSWERS)


def test_gate_verdicts(spark, gate, tmp_path):
    facts, templates = gate
    path = f"{tmp_path}/report"
    found = exclusion.run_gate(facts, templates, answers(spark), [1, 2], 0.5, "m1", "m1", path, "c1")
    assert {r.fact: (r.verdict, r.reason, r.worst, r.n_cells) for r in found.collect()} == {
        "f1": ("pass", None, 0.0, 4),
        "f2": ("excluded_known", None, 1.0, 4),
        "f3": ("incomplete", "missing_oracle_label", 0.0, 2),
        "f4": ("incomplete", "no_applicable_templates", None, 0),
        "f5": ("incomplete", "missing_cell", 0.0, 4),
        "f6": ("excluded_known", None, 1.0, 2),
        "f7": ("pass", None, 0.5, 4),  # not above the threshold
    }
    exclusion.require_pass(spark, path, "f1", "m1", "c1")
    for fact, identity in (("f2", None), ("f9", None), ("f1", "m2")):
        with pytest.raises(exclusion.GateError, match=fact):
            exclusion.require_pass(spark, path, fact, identity)
    assert tuple(exclusion.report(found, 0.25).first()) == (7, 2, 2 / 7, True)
    with pytest.raises(exclusion.GateError, match="2 of 7"):
        exclusion.require_cleared(found, 0.25, None)
    with pytest.raises(exclusion.GateError, match="f2"):
        exclusion.require_cleared(found, 0.25, "owner agrees")
    exclusion.require_cleared(found.where("verdict = 'pass'"), 0.25, None)
    assert tuple(exclusion.report(found.limit(0), 0.25).first()) == (0, 0, 0.0, False)


def test_another_model_writes_nothing(spark, gate, tmp_path):
    with pytest.raises(exclusion.GateError, match="m2"):
        exclusion.run_gate(*gate, answers(spark), [1, 2], 0.5, "m2", "m1", f"{tmp_path}/report")
    assert not list(tmp_path.iterdir())
    exclusion.run_gate(*gate, answers(spark), [1, 2], 0.5, "m1", "m1", f"{tmp_path}/report")
    with pytest.raises(exclusion.GateError, match="f1"):
        exclusion.require_pass(spark, f"{tmp_path}/report", "f1")  # bound to no configuration
