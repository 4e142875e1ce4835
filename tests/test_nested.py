"""Documents of unknown shape: walks, repeated values, subset match, dotted paths."""

from __future__ import annotations

import json
import random
from collections import defaultdict

import pytest
from lethe.operators import nested
from pyspark.sql import functions as F

DOCS = "doc long, j string"


def variants(spark, documents):
    rows = [(k, json.dumps(d)) for k, d in (documents.items() if isinstance(documents, dict) else enumerate(documents))]
    return spark.createDataFrame(rows, DOCS).repartition(3).select("doc", F.parse_json("j").alias("v"))


def plain(value):
    if isinstance(value, bool):
        return "boolean", str(value).lower()
    if value is None:
        return "null", None
    if isinstance(value, str):
        return "string", value
    if isinstance(value, (int, float)):
        return "number", str(int(value) if value == int(value) else value)
    return ("object" if isinstance(value, dict) else "array"), None


def nodes_of(value, path="", key=None):
    yield path, key, *plain(value)
    if isinstance(value, dict):
        for name, inner in value.items():
            yield from nodes_of(inner, f"{path}/{name.replace('~', '~0').replace('/', '~1')}", name)
    if isinstance(value, list):
        for place, inner in enumerate(value):
            yield from nodes_of(inner, f"{path}/{place}", key)


def some_value(rng, depth=0):
    kind = rng.choice(["object", "array", "leaf"] if depth < 4 else ["leaf"]) if depth else "object"
    if kind == "object":
        return {rng.choice(["a", "b", "c/d", "e~f", "name", ""]): some_value(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    if kind == "array":
        return [some_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([None, True, False, 0, 1, 1.0, -2.5, 12345678901234, "", " ", "x", "1", "long text", "é\n\"q\""])


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(9)
    return [some_value(rng) for _ in range(60)] + [7, "top", [1, [2, [3, [4, [5]]]]], {}, [], None]


def test_walk(spark, documents):
    found = sorted(map(repr, map(tuple, nested.walk(variants(spark, documents), "doc", "v").collect())))
    assert found == sorted(repr((k, *node)) for k, d in enumerate(documents) for node in nodes_of(d))
    none = spark.createDataFrame([(1, None)], DOCS).select("doc", F.parse_json("j").alias("v"))
    assert nested.walk(none, "doc", "v").count() == 0


def test_repeated_values(spark, documents):
    places = defaultdict(list)
    for k, d in enumerate(documents):
        for path, key, kind, value in nodes_of(d):
            if key is not None and value is not None and value.strip(" "):
                places[key, kind, value].append((k, path))
    right = sorted(repr((key, value, k, path)) for (key, _, value), where in places.items() if len({k for k, _ in where}) > 1 for k, path in where)
    assert sorted(map(repr, map(tuple, nested.repeated_values(nested.walk(variants(spark, documents), "doc", "v")).collect()))) == right and right


def test_subset_match(spark):
    expected = {1: {"a": 1, "b": {"c": [1, {"d": "x"}]}}, 2: {"a": 1}, 3: {"a": {"b": 1}}, 4: {"a": []}, 5: {"a": 1.0}, 6: {"a": None}, 7: {"a": "1"}, 8: {"a": 1}, 9: {"l": [1, 2]}}
    observed = {1: {"z": 0, "a": 1, "b": {"c": [1, {"d": "x", "e": 2}, 3], "f": 1}}, 2: {"a": 2}, 3: {"a": 1}, 4: {"a": {}}, 5: {"a": 1}, 6: {"b": 1}, 7: {"a": 1}, 9: {"l": [1, 2, 3]}}
    walked = [nested.walk(variants(spark, d), "doc", "v") for d in (expected, observed)]
    found = {r.doc: (r.matches, r.n_faults, r.first_path) for r in nested.subset_match(*walked).collect()}
    assert found == {
        1: (True, 0, None), 2: (False, 1, "/a"), 3: (False, 2, "/a"), 4: (False, 1, "/a"), 5: (True, 0, None),
        6: (False, 1, "/a"), 7: (False, 1, "/a"), 8: (False, 2, ""), 9: (True, 0, None),
    }
    faults = {(r.doc, r.path): r.fault for r in nested.subset_faults(*walked).collect()}
    assert faults[3, "/a"] == "different" and faults[3, "/a/b"] == faults[6, "/a"] == faults[8, ""] == "missing"


def test_random_subsets(spark, documents):
    """Leaving out names of objects anywhere keeps a document a subset; changing one leaf does not."""
    rng = random.Random(2)

    def thinned(value):
        if isinstance(value, dict):
            return {k: thinned(v) for k, v in value.items() if rng.random() < 0.7}
        return [thinned(v) for v in value] if isinstance(value, list) else value

    walked = nested.walk(variants(spark, documents), "doc", "v")
    found = nested.subset_match(nested.walk(variants(spark, [thinned(d) for d in documents]), "doc", "v"), walked)
    assert all(r.matches for r in found.collect())
    changed = nested.walk(variants(spark, [{"new": 1, **d} if isinstance(d, dict) else "other" for d in documents]), "doc", "v")
    assert not any(r.matches for r in nested.subset_match(changed, walked).collect())


@pytest.mark.parametrize(
    ("expected", "must_fail", "claimed", "observed", "right"),
    [
        ("accept", None, None, "accept", True), ("accept", True, None, "reject", False), ("accept", None, None, None, False), (None, True, "accept", "reject", True), (None, True, "accept", "accept", False),
        (None, True, None, "approved", False), (None, True, None, "reject", True), (None, True, None, None, True), (None, False, None, "anything", True), (None, None, None, None, False),
    ],
)
def test_outcomes(spark, expected, must_fail, claimed, observed, right):
    row = spark.createDataFrame([(expected, must_fail, claimed, observed)], "e string, m boolean, c string, o string")
    assert row.select(nested.outcome_matches(*map(F.col, "emco"))).first()[0] is right


def set_by_hand(document, keys, value):
    document = dict(document) if isinstance(document, dict) else {}
    document[keys[0]] = value if len(keys) == 1 else set_by_hand(document.get(keys[0]), keys[1:], value)
    return document


def test_set_path(spark, documents):
    table = variants(spark, documents)
    for path in ("a", "a.b", "a.name.c", "new.levels.of.names"):
        found = {r.doc: json.loads(r.j) for r in table.select("doc", F.to_json(nested.set_path(F.col("v"), path, F.parse_json(F.lit("[1]")))).alias("j")).collect()}
        assert found == {k: set_by_hand(d, path.split("."), [1]) for k, d in enumerate(documents)}


def test_overrides(spark):
    table = variants(spark, {1: {"train": {"lr": 0.1, "steps": 5}, "name": "x"}, 2: {"train": 3}})
    settings = {"train.lr": "1e-3", "train.opt.name": "adam", "train.steps": "10", "flag": "TRUE", "gone": "None", "text": "12 apples", "name": 'say "hi"', "neg": "-4"}
    found = {r.doc: json.loads(r.j) for r in table.select("doc", F.to_json(nested.override(F.col("v"), settings)).alias("j")).collect()}
    common = {"flag": True, "gone": None, "text": "12 apples", "name": 'say "hi"', "neg": -4}
    assert found == {k: {"train": {"lr": 0.001, "steps": 10, "opt": {"name": "adam"}}, **common} for k in (1, 2)}
