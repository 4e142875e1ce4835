"""Splits with exact counts against plain search, and their guards."""

from __future__ import annotations

import itertools
import json
import random
from collections import Counter, defaultdict

import pytest
from lethe.operators import splits

FACTS = "fact string, subject string, object string, relation string"
VERDICTS = "fact string, verdict string"
RELATIONS = ("occupation", "birthplace")


def first_solution(classes, construction, calibration, n_relations):
    full = (1 << n_relations) - 1
    for chosen in itertools.product(*[[(x, y) for x in range(n + 1) for y in range(n + 1 - x)] for _, _, n in classes]):
        sides = []
        for side in (0, 1):
            mask = 0
            for pair, (_, bits, _) in zip(chosen, classes):
                mask |= bits if pair[side] else 0
            sides.append((sum(pair[side] * size for pair, (size, _, _) in zip(chosen, classes)), mask))
        if sides == [(construction, full), (calibration, full)]:
            return list(chosen)
    return None


def test_pack_finds_the_first_solution():
    rng, solved = random.Random(1), 0
    for _ in range(500):
        r = rng.randint(0, 2)
        classes = [(rng.randint(1, 4), rng.randint(0, (1 << r) - 1), rng.randint(1, 3)) for _ in range(rng.randint(0, 4))]
        counts = rng.randint(0, 6), rng.randint(0, 6)
        right = first_solution(classes, *counts, r)
        assert splits.pack(classes, *counts, r) == right, (classes, counts, r)
        solved += right is not None
    assert solved > 80


def test_pack_turns_down_too_many_states():
    with pytest.raises(ValueError, match="states"):
        splits.pack([(1, 1, 5)], 10_000, 10_000, 4)


def fact(name, subject, relation="occupation", other="elsewhere"):
    return (name, subject, other, relation)


def judged(spark, rows):
    facts = spark.createDataFrame(rows, FACTS).repartition(3)
    gates = spark.createDataFrame([(r[0], "pass") for r in rows], VERDICTS)
    audits = spark.createDataFrame([(r[0], "clean") for r in rows] * 2, VERDICTS)
    return facts, gates, audits


def test_counts_and_coverage(spark):
    rows = [fact("f1", "a"), fact("f2", "b", "birthplace"), fact("f3", "c"), fact("f4", "d", "birthplace"), fact("f5", "e")]
    first, second = ({r.fact: r.label for r in splits.assign_splits(*judged(spark, rows), 2, 2, RELATIONS, 7).collect()} for _ in range(2))
    assert first == second and Counter(first.values()) == {"construction": 2, "calibration": 2, "unassigned": 1}
    relation = {r[0]: r[3] for r in rows}
    for label in ("construction", "calibration"):
        assert {relation[f] for f, at in first.items() if at == label} == set(RELATIONS)


def test_linked_subjects_stay_together(spark):
    """x names y and y names z: one group of six facts, which only fits into construction."""
    rows = [fact("x1", "x", other="y"), fact("x2", "x", "birthplace"), fact("y1", "y", other="z"), fact("y2", "y"), fact("z1", "z"), fact("z2", "z", other="z")]
    rows += [fact("p1", "p"), fact("p2", "p", "birthplace"), fact("q1", "q", other="nobody")]
    found = {r.fact: r.label for r in splits.assign_splits(*judged(spark, rows), 6, 2, RELATIONS, 1).collect()}
    assert {found[f] for f in ("x1", "x2", "y1", "y2", "z1", "z2")} == {"construction"} and found["p1"] == found["p2"] == "calibration" and found["q1"] == "unassigned"


def test_only_sound_facts_are_eligible(spark):
    rows = [fact(f"f{k}", f"s{k}", RELATIONS[k % 2]) for k in range(8)]
    facts = spark.createDataFrame(rows, FACTS)
    gates = spark.createDataFrame([(f"f{k}", "pass") for k in range(7)] + [("f0", "pass"), ("f7", "fail")], VERDICTS)
    audits = spark.createDataFrame([(f"f{k}", "clean") for k in range(8) if k != 1] + [("f2", "leak")], VERDICTS)
    found = splits.assign_splits(facts, gates, audits, 2, 2, RELATIONS, 3).collect()
    assert {r.fact for r in found} == {"f3", "f4", "f5", "f6"}


def test_counts_that_cannot_be_met(spark):
    rows = [fact("f1", "a"), fact("f2", "a", "birthplace"), fact("f3", "b"), fact("f4", "b", "birthplace")]
    with pytest.raises(splits.SplitError, match="construction=3 calibration=1 facts=4 occupation=4 birthplace=4"):
        splits.assign_splits(*judged(spark, rows), 3, 1, RELATIONS, 1)
    with pytest.raises(splits.SplitError, match="facts=0"):
        splits.assign_splits(*judged(spark, rows[:0]), 1, 1, RELATIONS, 1)


def test_a_large_class(spark):
    """One class holds nearly all groups; the choice within it follows the seed."""
    rows = [(f"g{k}", "occupation") for k in range(5000)] + [("h", "birthplace"), ("i", "birthplace"), ("i", "occupation"), (None, "birthplace")]
    grouped = spark.createDataFrame(rows, "grp string, relation string").repartition(4)
    chosen = [splits.packed_splits(grouped.where("grp IS NOT NULL"), 10, 9, RELATIONS, seed).collect() for seed in (1, 1, 2)]
    sets = [{(r.grp, r.label) for r in rows if r.label != "unassigned"} for rows in chosen]
    assert sets[0] == sets[1] != sets[2] and len(chosen[0]) == 5002
    sizes = defaultdict(int)
    for r in chosen[0]:
        sizes[r.label] += r["size"]
    assert sizes["construction"] == 10 and sizes["calibration"] == 9


def test_faults(spark):
    facts = spark.createDataFrame([fact("f1", "a"), fact("f2", "a"), fact("f3", "b", other="c"), fact("f4", "c"), fact("f5", "d", other="c"), fact("f6", "e", other="a")], FACTS)
    labels = spark.createDataFrame([("f1", "construction"), ("f2", "calibration"), ("f3", "calibration"), ("f4", "construction"), ("f5", "construction")], "fact string, label string")
    assert sorted(map(tuple, splits.split_faults(labels, facts).collect())) == [("a", "two_labels"), ("c", "linked")]
    assert splits.split_faults(labels.where("fact != 'f2' AND fact != 'f3'"), facts).count() == 0


def test_guarded_reading(spark, tmp_path):
    folder, log = f"{tmp_path}/splits", f"{tmp_path}/denied"
    labels = spark.createDataFrame([("f1", "a", "construction"), ("f2", "b", "calibration"), ("f3", "c", "final_test")], "fact string, subject string, label string")
    splits.write_splits(labels, folder)
    assert [r.fact for r in splits.load_split(spark, folder, "calibration", "any", log).collect()] == ["f2"]
    assert [r.fact for r in splits.load_split(spark, folder, "final_test", "final_test_pass", log).collect()] == ["f3"]
    with pytest.raises(PermissionError, match="role"):
        splits.load_split(spark, folder, "final_test", "trainer", log)
    splits.write_splits(labels.where("fact = 'f1'"), f"{folder}2")
    with pytest.raises(PermissionError, match="empty_split"):
        splits.load_split(spark, f"{folder}2", "final_test", "final_test_pass", log)
    denied = [json.loads(r.value) for r in spark.read.text(log).collect()]
    assert sorted((d["reason"], d["role"], d["split"]) for d in denied) == [("empty_split", "final_test_pass", "final_test"), ("role", "trainer", "final_test")]
    with pytest.raises(ValueError, match="other"):
        splits.load_split(spark, folder, "other", "any", log)
