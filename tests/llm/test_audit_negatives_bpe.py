"""Operators 11 to 13 against brute-force versions: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from lethe.llm import bpe, filter_audit, hard_negatives, tokens
from pyspark.sql import functions as F

# 11

DOCS = "doc_id long, text string, lang string, part string, row long, fails int, good boolean, h1 long, order int, found string"
LABELS = "doc_id long, quality int, toxic int"


def audited_texts() -> list[tuple]:
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)] + ["ABC", "A&B", "#", "é漢"]
    texts: list[str | None] = [None, None, "", " ", "A" * 300, "x " * 200, "\x0b".join(words[:150]), "word\xa0word " * 60, "long " + " ".join(rng.choices(words, k=30_000))]
    for _ in range(120):
        texts.append(" ".join(rng.choices(words[: rng.choice([40, 400, 404])], k=rng.randint(60, 160))))
    texts += rng.choices(texts, k=80)
    rows = [(i, t, rng.choice(["en", "en", "de", None, ""]), "p", 1, 2, True, 3, 4, "f") for i, t in enumerate(texts)]
    rows += [rows[40], rows[41], (None, texts[30], "en", "p", 1, 2, True, 3, 4, "f"), (None, "only here", "fr", "p", 1, 2, True, 3, 4, "f")]
    rng.shuffle(rows)
    return rows


def audit_by_hand(rows: list[tuple], labels: list[tuple]) -> list[tuple]:
    good = {i for i, quality, _ in labels if quality == 1} - {None}
    toxic = {i for i, _, bad in labels if bad == 1} - {None}
    least = defaultdict(lambda: math.inf)
    for i, text, *_ in rows:
        least[text or ""] = min(least[text or ""], math.inf if i is None else i)
    failed, total = defaultdict(list), Counter()
    for i, text, part, *_ in rows:
        text, part = text or "", part or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": (math.inf if i is None else i) > least[text],
        }
        total[part] += 1
        failed[part].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = []
    for part in total:
        steps, shapley = [], Counter()
        for order in itertools.permutations("ABCDE"):
            kept = total[part]
            for k, f in enumerate(order):
                mine = [x for x in failed[part] if f in x[0]]
                removed = [x for x in mine if not x[0] & set(order[:k])]
                kept -= len(removed)
                shapley[f] += len(removed)
                unique = sum(x[0] == {f} for x in mine)
                steps.append((part, "".join(order), k + 1, kept, len(removed), len(mine) - len(removed), unique, sum(x[1] for x in removed), sum(x[2] for x in removed), f))
        out += [(*step[:-1], shapley[step[-1]]) for step in steps]
    return sorted(out)


def test_filter_audit(spark):
    rows = audited_texts()
    labels = [(i, i % 3 % 2, i % 5 == 0) for i in range(150)] + [(7, 1, 0), (7, None, 1), (None, 1, 1), (5, None, None)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    found = filter_audit.audit_documents(docs, spark.createDataFrame(labels, LABELS))
    assert sorted(map(tuple, found.collect())) == audit_by_hand(rows, labels)


def test_filter_audit_without_rows(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit_documents(none, labels).count() == 0
    clean = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(120)), None)], "doc_id long, text string, lang string")
    rows = filter_audit.audit_documents(clean, labels).collect()
    assert len(rows) == 600 and {(r.part, r.kept, r.removed, r.shapley) for r in rows} == {("", 1, 0, 0)}


def test_posting_ranges(spark):
    """Ranges of seven rows give the sums of one range; a hot part is cut."""
    rng = random.Random(2)
    rows = [(k, rng.choice("aaaab"), rng.randint(1, 31), rng.random() < 0.3, rng.random() < 0.2) for k in range(300)]
    failed = spark.createDataFrame(rows, "row long, part string, fails int, good boolean, toxic boolean").repartition(3)
    lists = filter_audit.posting_lists(failed, 5, 7).collect()
    assert len(lists) >= 300 / 7 and all(x == sorted(x) for row in lists for x in row.lists)
    sums = Counter()
    for row in filter_audit.interactions(filter_audit.posting_lists(failed, 5, 7)).collect():
        sums[row.part, row.filter, row.before] += np.array([row.removed, row.good, row.toxic])
    for part, f, before in itertools.product("ab", range(5), range(32)):
        if not before >> f & 1:
            mine = [r for r in rows if r[1] == part and r[2] >> f & 1 and not r[2] & before]
            assert list(sums[part, f, before] if mine else [0, 0, 0]) == [len(mine), sum(r[3] for r in mine), sum(r[4] for r in mine)]


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_galloping_merges(monkeypatch, block):
    monkeypatch.setattr(filter_audit, "BLOCK", block)
    rng = np.random.default_rng(block)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, rng.choice([5, 60, 5000]), rng.integers(0, 80))) for _ in range(2))
        assert filter_audit.union(a, b).tolist() == np.union1d(a, b).tolist()
        assert a[filter_audit.outside(a, b)].tolist() == np.setdiff1d(a, b).tolist()
        if len(a):
            value, start = int(rng.integers(0, 5000)), int(rng.integers(0, len(a)))
            assert filter_audit.gallop(a, value, start) == max(start, int(np.searchsorted(a, value)))


# 12

VECTORS = "vec_id long, label long, embedding array<float>, row long, score long, place int, q string"


def mined_by_hand(rows: list[tuple], k: int = 5) -> list[tuple]:
    sound = [(i, l, [max(-(2**62), min(2**62, math.floor(256 * float(x)))) for x in v]) for i, l, v in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sound = [(k, *row) for k, row in enumerate(sound)]

    def ranked(anchor, same):
        scored = [(min(2**63 - 1, max(1 - 2**63, sum(x * y for x, y in zip(v, anchor[3])))), math.inf if i is None else i) for at, i, l, v in sound if (l == anchor[2]) == same and at != anchor[0]]
        return sorted(scored, key=lambda x: (-x[0], x[1]))

    out = []
    for anchor in sound:
        if anchor[1] is not None and anchor[1] % 100 == 0:
            others = ranked(anchor, False)
            for p, i in ranked(anchor, True)[:k]:
                held = [(s, j) for s, j in others if 80 * p <= 100 * s <= 100 * p][:k]
                out += [(anchor[1], i, rank + 1, j, p, s) for rank, (s, j) in enumerate(held)]
    none = lambda row: tuple(None if x == math.inf else x for x in row)
    return sorted(map(none, out), key=str)


def mined(spark, rows, **more):
    table = spark.createDataFrame([(*row, 1, 2, 3, "q") for row in rows], VECTORS).repartition(3)
    return sorted(map(tuple, hard_negatives.hard_negatives(table, "vec_id % 100 = 0", **more).collect()), key=str)


@pytest.mark.parametrize(("block_rows", "block_anchors"), [(4096, 256), (37, 3)])
def test_hard_negatives(spark, block_rows, block_anchors):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(4, 8))
    rows = [(20 * i, int(c), [float(np.float32(x)) for x in 0.4 * centres[c] + 0.15 * rng.normal(size=8)]) for i, c in enumerate(rng.choice(4, 420, p=[0.55, 0.2, 0.2, 0.05]))]
    rows += [(100 * i, 1, [0.0] * 8) for i in range(1, 3)]  # repeated ids, vectors of zeros
    rows += [(5, 1, rows[7][2]), (6, 2, rows[7][2]), (6, 2, rows[7][2]), (3, 0, rows[7][2])]  # ties
    rows += [(700, None, rows[0][2]), (800, 1, None), (900, 1, [1.0, None]), (1000, 1, [float("nan")]), (1100, 1, [float("inf")]), (None, 1, rows[5][2]), (None, 0, rows[5][2])]
    rows += [(1200, 2, []), (1300, 3, [0.5]), (77, 9, [0.5] * 12), (7700, 9, [0.25] * 12)]
    assert mined(spark, rows, block_rows=block_rows, block_anchors=block_anchors) == mined_by_hand(rows)


def test_hard_negatives_of_large_components(spark):
    rows = [(i, i % 2, [float(np.float32(x)) for x in np.random.default_rng(i).normal(size=3) * 10 ** (i % 19)]) for i in range(0, 700, 10)]
    assert mined(spark, rows) == mined_by_hand(rows)


def test_hard_negatives_without_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(100, 1, [1.0])]) == [] and mined(spark, [(100, 1, None), (None, None, [1.0])]) == []


def test_threshold_stops_early():
    """Few rows reach far along the anchor: the rest of the lists is not read, and the best rows are right."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-20, 20, (4096, 6))
    vectors[:40] += 300
    orders = np.argsort(vectors.T, axis=1, kind="stable").astype("<u2")
    ints = np.arange(4096).astype("<i8").tobytes()
    block = hard_negatives.Block({"block": 0, "n": 4096, "kind": "<i2", "rows": ints, "ids": ints, "labels": ints, "vectors": vectors.astype("<i2").tobytes(), "orders": orders.tobytes(), "lows": None, "highs": None})
    anchor = np.array([3.0, 1, 2, 5, 0, 1])
    thresholds = np.where(anchor > 0, anchor, 0) @ block.worst_high.T
    windows = [hard_negatives.Best(-(2**60), 2**60, 5, []), hard_negatives.Best(1000, 3500, 5, [])]
    scored = hard_negatives.search(anchor, thresholds, block, np.ones(4096, bool), windows)
    right = sorted((-int(s), i, i) for i, s in enumerate(vectors @ anchor.astype(int)))
    assert windows[0].rows == right[:5] and windows[1].rows == [x for x in right if 1000 <= -x[0] <= 3500][:5] and scored < 1000


# 13


@pytest.fixture(scope="module")
def library():
    return tokens.load(tokens.published(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(tokens.published(bpe.VOCABULARY))


PARTS = ["a", "B", " ", "  ", "\n", "\t", "'s", "'LL", "'", "é", "漢字", "x", "9", "12", "́", "\x85", "\x1c", "　", "<|endoftext|>", "<|endof", "|>", "_", "...", "😀", "\r\n", "Ünï", "ation", "\0", "٣", "²"]


def fuzzed() -> list[str]:
    rng = random.Random(13)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(4000)]
    return [*texts, "", "a" * 5000, "".join(rng.choices("abcdefgh", k=20_000)), "é" * 400, " " * 1000 + "x", "<|endoftext|>" * 3, "ab " * 40_000]


def test_bpe_as_the_library(encoder, library):
    texts = fuzzed()
    for text, ids in zip(texts, encoder.encode(texts)):
        right = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == right, repr(text)
        assert encoder.model.decode(ids) == library.decode(right, skip_special_tokens=False) == text


def test_decoding_of_any_ids(encoder, library):
    rng = random.Random(1)
    for _ in range(300):
        ids = rng.choices(range(50257), k=rng.randint(0, 12))
        assert encoder.model.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_segment_trees(encoder):
    """One tree a row, and one tree for a long word, against merging by plain search."""
    model, rng = encoder.model, random.Random(7)

    def plain(word: bytes) -> list[int]:
        ids = [int(model.byte_ids[b]) for b in word]
        while len(ids) > 1:
            rank, i = min((model.rank_of.get(pair, math.inf), i) for i, pair in enumerate(zip(ids, ids[1:])))
            if rank == math.inf:
                break
            ids[i : i + 2] = [int(model.merged[rank])]
        return ids

    words = {bytes(rng.choices(b"aaabcdehilnorst \xc3\xa9", k=rng.randint(1, 64))) for _ in range(600)} | {b"a" * n for n in (1, 2, 3, 4, 31, 32, 33, 63, 64)}
    found = model.merge(words)
    for word in words:
        assert np.frombuffer(found[word], "<u4").tolist() == plain(word) == np.frombuffer(model.merge_long(word), "<u4").tolist(), word


def test_bpe_table(spark, library):
    texts = [*fuzzed()[-7:], None, "", "same", "same"]
    rows = [(k % 9, text, "x", 5) for k, text in enumerate(texts)] + [(None, "no id", "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    found = bpe.decode_documents(bpe.encode_documents(docs)).select("doc_id", F.hex("ids").alias("ids"), "text").collect()
    right = [(i, np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes().hex().upper(), t or "") for i, t, *_ in rows]
    assert sorted(map(tuple, found), key=str) == sorted(right, key=str)
    at_once = bpe.encode_documents(docs, decode=True).select("doc_id", F.hex("ids"), "text").collect()
    assert sorted(map(tuple, at_once), key=str) == sorted(right, key=str)
    assert bpe.decode_documents(bpe.encode_documents(docs.limit(0))).count() == 0


def test_bpe_query(spark, tmp_path):
    spark.createDataFrame([(1, "Hello wörld"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in bpe.op13_bpe_round_trip(spark, str(tmp_path)).collect()}
    assert rows[1].decoded_sha256 == hashlib.sha256("Hello wörld".encode()).hexdigest() and rows[1].n_tokens > 1
    assert rows[2].n_tokens == 0 and rows[2].ids_sha256 == rows[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_other_models_are_turned_down():
    with pytest.raises(ValueError, match="plain byte-level"):
        bpe.Model(tokens.published("word_bpe_49k.json"))
