"""The pipeline stage by stage against plain versions, on a small corpus with planted cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from lethe.llm import shared, token_files, tokens

from .test_operators import LOWER, sentence


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    bench = [(k, sentence(rng, rng.randint(15, 50))) for k in range(20)]
    rows, labels, kind = [], [], {}
    for i in range(1500):
        text = sentence(rng, rng.randint(30, 90))
        kind[i] = rng.choices(["clean", "toxic", "leak"], [20, 2, 1])[0]
        if kind[i] == "toxic":
            words = text.split(" ")
            for _ in range(4):
                words.insert(rng.randrange(len(words)), "horridword")
            text = " ".join(words)
        if kind[i] == "leak":
            text += " " + rng.choice(bench)[1] + " " + sentence(rng, 10)
        if rng.random() < 0.5:
            labels.append((i, 1, int(kind[i] == "toxic")))
        rows.append((i, text, "en", rng.choice(["a", "b", "c"]), len(text)))
    for i in range(1500, 1600):  # copies, exact and near
        words = rows[i % 7][1].split(" ")
        if i % 2:
            words[rng.randrange(len(words))] = "edited"
        kind[i] = "copy"
        rows.append((i, " ".join(words), "en", "a", 0))
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, kind, bench


def shingle_set(text: str) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def test_stages(spark, folder):
    path, rows, kind, bench = folder
    docs = shared.table(spark, path, "documents")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.staged(stage(spark, docs, path), "test")
        out.append(docs.collect())
        if len(out) < 5:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    drawn, unique, clean, mixed, files = out
    text = {r[0]: r[1] for r in rows}
    left = {r.doc_id for r in drawn}
    assert len(drawn) == len(left)
    assert not [i for i in left if kind[i] == "toxic"][3:]
    assert len([i for i in left if kind[i] == "clean"]) >= 0.97 * list(kind.values()).count("clean")
    # one of each group
    sets = {i: shingle_set(text[i]) for i in left}
    parent = {i: i for i in left}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle: dict = {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    for a, b in {(g[0], other) for g in by_shingle.values() for other in g[1:]} | {(a, b) for g in by_shingle.values() if len(g) < 60 for k, a in enumerate(g) for b in g[k + 1 :]}:
        n = len(sets[a] & sets[b])
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert {r.doc_id for r in unique} == {i for i in left if root(i) == i}
    # no leaks
    held = {r.doc_id for r in unique}
    leaks = {i for i in held if any(t in text[i] for _, t in bench)}
    assert {r.doc_id for r in clean} == held - leaks
    # the mix
    size = {i: len(text[i].split()) for i in held - leaks}
    source = {r.doc_id: r.source for r in clean}
    total, taken = Counter(), Counter()
    for i in size:
        total[source[i]] += size[i]
    for r in mixed:
        taken[r.source] += size[r.doc_id]
        assert r.text == text[r.doc_id]
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2
    assert abs(sum(taken.values()) - 1.5 * sum(total.values())) <= 3 * max(size.values())
    # the files
    library = tokens.load(tokens.published(token_files.VOCABULARY))
    start = 0
    for r, d in zip(sorted(files, key=lambda r: r.start), sorted(mixed, key=lambda d: d.doc_id)):
        ids = library.encode(d.text, add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path_factory):
    """Null ids and texts, empty texts, repeated rows and ids, a long text, a paraphrased leak, and columns named like the stages' own."""
    rng = random.Random(13)
    item = sentence(rng, 40)
    words = item.split(" ")
    for k in range(0, 40, 10):
        words[k] = "elsewhere"
    texts = [(k, sentence(rng, 40)) for k in range(30)]
    texts += [(None, None), (None, "some words of a row without an id stand here"), (40, None), (41, ""), (42, "  \n "), (43, texts[3][1]), (44, "twice the same id one"), (44, "twice the same id two"), (45, texts[5][1]), (45, texts[5][1])]
    texts += [(50, sentence(rng, 4000)), (51, sentence(rng, 60) + " " + " ".join(words) + " " + sentence(rng, 60))]
    rows = [(i, t, "en", "a", 1, 2, True, 3.0, "x") for i, t in texts]
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, class int, size int, kept boolean, key double, signature string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs, counts = shared.table(spark, path, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = shared.staged(stage(spark, docs, path), "odd").cache()
        counts.append(docs.count())
        assert docs.columns == columns or name.startswith("token")
        if name.startswith("n-gram"):
            left = [r.doc_id for r in docs.collect()]
            assert 43 not in left and left.count(45) == 0 and left.count(44) == 1 and left.count(None) == 2 and {3, 5, 40, 41, 42, 51} <= set(left)
        if name.startswith("benchmark"):
            assert {r.doc_id for r in docs.collect()} == set(left) - {51}
    assert counts[0] == len(rows) and counts[4] == counts[3] and docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
