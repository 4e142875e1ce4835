"""Each operator against a brute-force version on small tables with the awkward cases: nulls, empty and long texts, ties,
repeated rows, empty tables, extra columns whose names clash with an operator's own."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from lethe.llm import decontamination, jaccard, kernels, licenses, line_dedup, mixing, quality_rules, resampling, suffix_dedup, token_counts, token_files, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gram long, class long, salt int, hash long, size long, copy int, stratum string, word string"
EMPTY = "doc_id long, text string, lang string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYLLABLES = ["the", "an", "er", "tion", "of", "nd", "Ha", "éa", "üb", "sh", "wh", "or"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) + rng.choice(["", "", ",", "."]) for _ in range(n))


def corpus() -> list[tuple]:
    rng = random.Random(5)
    passage = sentence(rng, 60)
    base = sentence(rng, 150)
    texts: list[str | None] = [None, "", "\n\n", "   ", "one", "a b c", "x" * 300, "Repeat me now " * 40, "a\t b c d\r\ne", "naïve café \x1c x\x85y <|endoftext|> ok"]
    texts += [base, base, base]
    for _ in range(25):  # near copies
        words = base.split(" ")
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = "edit" + str(rng.randrange(1000))
        texts.append(" ".join(words))
    texts += [sentence(rng, rng.randint(1, 80)) + "\n" + passage + "\n" + sentence(rng, rng.randint(1, 80)) for _ in range(14)]
    texts += ["\n".join(rng.choices(["A common line here", "a common line HERE ", "short", "Another line of text"], k=6)) for _ in range(6)]
    texts += [sentence(rng, rng.randint(5, 200)) for _ in range(30)]
    texts.append(" ".join(sentence(rng, 30) for _ in range(150)))  # long
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "ä", None]), 1, 2, 3, 4, 5, 6, 7, "s", "w") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EMPTY)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated ids and rows, null ids."""
    return spark.createDataFrame([(1, "same words in this text here", "en", "a"), (1, "same words in this text here", "en", "a"), (1, "other words stand in this one", None, None), (None, "same words in this text here", "en", "b"), (None, None, None, None)], EMPTY)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# 1


def test_license_base(docs, rows, none, odd, spark):
    found = by_id(licenses.scan_licenses(docs))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, text, *_ in rows:
        assert found[i].n_words == len(word.findall((text or "").translate(LOWER)))
    assert licenses.scan_licenses(none).count() == 0 and licenses.scan_licenses(odd).count() == 5
    more = spark.createDataFrame([(1, "Under the MIT\nLicense, or CC-BY, or the Apache License 2.0; the GNU General Public License."), (2, "# SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception\nx"), (3, "mit licenses"), (4, "Permission is hereby granted, free of charge")], "doc_id long, text string")
    found = by_id(licenses.scan_licenses(more))
    assert (found[1].n_base, found[1].first_word, found[1].base_labels) == (4, 2, "apache,cc-by,gpl,mit")
    assert found[2].n_base == 0 and found[2].labels == "apache-2.0,gpl-2.0-only,mit" and found[2].score == pytest.approx(0.95)
    assert found[3].labels == "" and found[3].score == 0 and found[3].first_word is None
    assert found[4].labels == "mit" and found[4].base_labels == ""


def test_license_places(spark):
    """Words, places and labels of base phrases against a plain search, on texts made of phrases and their parts."""
    rng = random.Random(21)
    parts = ["GNU", "general", "Public License", "gnu general public license", "Apache", "license", "apache-license", "CC BY", "cc", "by", "MIT", "MIT License", "é", "mit license", "cc by nc", "and", "with", "x1", "|", "\n"]
    texts = ["".join(p + rng.choice([" ", ", ", "\n", "--", ""]) for p in rng.choices(parts, k=rng.randint(0, 60))) for _ in range(400)] + [None, "", "mit license " * 3000]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    found = by_id(licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)))
    several = 0
    for i, text in enumerate(texts):
        words = word.findall((text or "").translate(LOWER))
        hits = [(k, label) for phrase, label in licenses.BASE_PHRASES.items() for k in range(len(words)) if words[k : k + phrase.count(" ") + 1] == phrase.split(" ")]
        row = found[i]
        assert (row.n_words, row.n_base) == (len(words), len(hits)), repr(text)
        assert (row.first_word, row.last_word) == (min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None))
        base = {label for _, label in hits}
        assert row.base_labels == ",".join(sorted(base)) and base <= set(row.labels.split(",")) | ({""} if not base else set()) and 0 <= row.score <= 1
        several += len(hits) > 2
    assert several > 50


@pytest.mark.parametrize(("text", "score"), [("gpl", 0.0), ("GNU General Public License and MIT License", 0.3), ("GNU General Public License with MIT License", 0.65), ("GNU General Public License or MIT License", 0.95), ("GNU General Public License and/or MIT License", 0.95)])
def test_words_between_notices(text, score):
    assert licenses.scan(text.encode(), licenses.automaton())[6] == pytest.approx(score)


def test_two_tags_on_one_line():
    text = b"SPDX-License-Identifier: MIT OR ISC SPDX-License-Identifier: GPL-2.0"
    assert licenses.scan(text, licenses.automaton())[5:] == ("gpl-2.0,isc,mit", 0.3)
    assert licenses.scan(text.replace(b" SPDX", b"\nSPDX"), licenses.automaton())[5:] == ("gpl-2.0,isc,mit", 0.3)


def test_shunting_yard():
    assert licenses.shunting_yard("a or b and c".split()) == ["a", "b", "c", "and", "or"]
    assert licenses.shunting_yard(["(", "a", "or", "b", ")", "and", "c", "with", "x"]) == ["a", "b", "or", "c", "x", "with", "and"]
    assert licenses.grammatical(["(", "mit", "or", "isc", "and"]) == ["(", "mit", "or", "isc", ")"]
    assert licenses.evaluated(["and"]) is None


# 2


def test_decontamination(spark, none):
    rng = random.Random(3)
    items = [(k, sentence(rng, rng.randint(12, 50))) for k in range(40)] + [(40, None), (41, ""), (42, "only three words")]
    texts, leaks = [], set()
    for i in range(120):
        text = sentence(rng, rng.randint(0, 150))
        if i % 3 == 0:
            k = rng.randrange(40)
            words = items[k][1].split(" ")
            if i % 2:  # a paraphrase: one word in ten is another
                words = [w if rng.random() > 0.1 else "else" for w in words]
            text = text + " " + " ".join(words) + " " + sentence(rng, rng.randint(0, 60))
            leaks.add((i, k))
        texts.append((i, text))
    texts += [(500, None), (501, ""), (502, "here only three words stand")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_leaks(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), bench)
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    # brute force: every item against every position, by the same scores
    words = {i: decontamination.words_of((t or "").encode()) for i, t in texts}
    expected = set()
    for k, t in items:
        w = decontamination.words_of((t or "").encode())
        if len(w):
            item = decontamination.Item(k, w, w[-max(3, len(w) // 4) :])
            for i, text in words.items():
                if any(decontamination.is_leak(len(w), *decontamination.shares(item, text, s, s + 48)) for s in range(0, max(1, len(text)), 16)):
                    expected.add((i, k))
    assert leaks <= expected and len(got & expected) >= 0.9 * len(expected) and leaks <= got and got <= expected
    assert (502, 42) in got
    assert decontamination.find_leaks(none, bench).count() == 0
    assert decontamination.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), bench.where("item_id = 41")).count() == 0
    blocks = decontamination.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), bench, block_words=300)
    assert leaks <= {(r.doc_id, r.item_id) for r in blocks.collect()}


def plain_common(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_decontamination_brute_force(spark):
    """Against every item in every stretch of a text: null and repeated ids, repeated rows, long texts, clashing columns, many blocks.

    Copies and copies with one word in ten replaced are all found; of those with three in ten replaced some lie below the candidate bounds.
    """
    rng = random.Random(31)
    items = [(k, sentence(rng, rng.randint(12, 30))) for k in range(30)]
    texts, sure = [], set()
    for i in range(40):
        words = sentence(rng, rng.randint(0, 120)).split(" ")
        if i % 2:
            k, share = rng.randrange(30), rng.choice([0.0, 0.1, 0.3, 0.6])
            leak = items[k][1].split(" ")
            if share <= 0.1:
                sure.add((i, k))
            leak = [w if rng.random() >= share else rng.choice(["else", "other", ""]) for w in leak]
            at = rng.randrange(len(words))
            words[at:at] = leak
        texts.append((i, " ".join(words)))
    texts += [(7, texts[7][1]), (7, texts[9][1]), (None, texts[7][1]), (90, None), (91, ""), (92, sentence(rng, 3000) + " " + items[3][1] + " " + sentence(rng, 3000))]
    bench = spark.createDataFrame([(*item, 0.5, "x") for item in items], "item_id long, text string, cosine double, block string")
    docs = spark.createDataFrame([(*t, 1, 2.0) for t in texts], "doc_id long, text string, item_id int, lcs_share double").repartition(3)
    plain = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    expected = set()
    for k, item in items:
        a = plain.findall(item.translate(LOWER))
        tail, slack = a[-max(3, len(a) // 4) :], max(2, len(a) // 4)
        for i, text in texts[:-1]:
            b = plain.findall((text or "").translate(LOWER))
            for s in range(-len(a), len(b)):
                region = b[max(0, s - slack) : max(0, s + len(a) + slack)]
                if sum((Counter(a) & Counter(region)).values()) >= 0.6 * len(a) and decontamination.is_leak(len(a), plain_common(a, region) / len(a), plain_common(tail, region) / len(tail)):
                    expected.add((i, k))
                    break
    for words in (12_000, 20):  # one block, and about as many as there are items
        got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench, block_words=words).collect()}
        missed, extra = expected - got, got - {(92, 3)} - expected
        assert (92, 3) in got and not extra and sure & expected <= got and len(missed) <= 0.2 * len(expected) and len(expected) > 10, (words, missed, extra, len(expected))
        assert {i for i, _ in got} >= {7, None}


def test_words_with_equal_low_bits():
    """Words whose hashes share the table's bits keep rows of their own."""
    words = np.sort(np.array([5, 5 + (1 << 20), 5 + (1 << 40), 9], np.uint64))
    vocabulary = decontamination.Vocabulary(words)
    assert vocabulary.rows(np.array([5 + (1 << 40), 5, 7, 5 + (3 << 20), 9], np.uint64)).tolist() == [words.tolist().index(5 + (1 << 40)), 0, -1, -1, words.tolist().index(9)]


def test_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(1, 20)), rng.integers(0, 5, rng.integers(1, 20))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontamination.common_subsequence(a, b) == table[-1, -1]


# 3


def test_token_counts(docs, rows, none, odd):
    library = tokens.load(tokens.published(token_counts.VOCABULARY))
    for chunk, overlap in ((1 << 14, 256), (200, 16), (20, 4)):
        found = by_id(token_counts.count_tokens(docs, chunk=chunk, overlap=overlap))
        for i, text, *_ in rows:
            n = len(library.encode(text or "", add_special_tokens=False).ids)
            assert (found[i].n_tokens, found[i].n_bytes, found[i].over_limit) == (n, len((text or "").encode()), n > 2048)
    assert token_counts.count_tokens(none).count() == 0 and token_counts.count_tokens(odd).count() == 5


@pytest.mark.parametrize("seed", range(3))
def test_odd_characters(seed):
    rng = random.Random(seed)
    parts = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "é", "é", "'s", "'re", "1", ".", ",", "...", "<|endoftext|>", " ", " ", "ß", "你", "\x1c", "\x85", "\0", "😀", "İ", "́"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(1500)]
    path = tokens.published(token_files.VOCABULARY)
    for text, got, right in zip(texts, tokens.encode(texts, path), tokens.load(path).encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(got, "<u4").tolist() == right.ids, repr(text)
    path = tokens.published(token_counts.VOCABULARY)
    encoder = token_counts.ChunkEncoder(path)
    several = 0
    for text, right in zip(texts, tokens.load(path).encode_batch(texts, add_special_tokens=False)):
        n, chunks = token_counts.count_chunks(encoder, text, 12, 6)
        several += chunks > 1
        assert n == len(right.ids) == encoder.counts([text])[0], repr(text)
    assert several > 50


def test_overlaps_widen():
    """Runs longer than the overlap, longer than a chunk, and a text without white space."""
    path = tokens.published(token_counts.VOCABULARY)
    encoder, library = token_counts.ChunkEncoder(path), tokens.load(path)
    rng = random.Random(9)
    for run in (3, 40, 90, 300):
        text = " ".join("".join(rng.choices("abcdefgé.-", k=rng.randint(1, run))) for _ in range(60))
        for overlap in (4, 30):
            n, chunks = token_counts.count_chunks(encoder, text, 80, overlap)
            assert n == len(library.encode(text, add_special_tokens=False).ids)
            assert chunks > 1 or run > 80
    assert token_counts.count_chunks(encoder, "x" * 1000, 80, 8) == (len(library.encode("x" * 1000, add_special_tokens=False).ids), 1)


# 4


def test_line_dedup(docs, rows, none, odd, monkeypatch):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    first: dict[str, int] = {}
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            first.setdefault(key(line), i)
    for hot in (1000, 20):  # with and without keys that count as hot
        monkeypatch.setattr(line_dedup, "HOT_SHARE", hot)
        found = by_id(line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)))
        for i, text, *_ in rows:
            lines = (text or "").split("\n")
            kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == i]
            assert (found[i].n_lines, found[i].n_dropped, found[i].text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_dedup.apply_bitmaps(none, line_dedup.keep_bitmaps(none)).count() == 0
    texts = sorted((str(r.doc_id), r.n_dropped) for r in line_dedup.apply_bitmaps(odd, line_dedup.keep_bitmaps(odd)).collect())
    assert texts == [("1", 0), ("1", 0), ("1", 0), ("None", 0), ("None", 1)]  # a null id comes last


def test_line_dedup_of_a_long_text(spark):
    """Time in proportion to the lines: hashing or searching once more for each line takes hours here."""
    lines = [f"this is line number {k}" for k in range(300_000)]
    other = [line if k % 1000 else f"fresh line {k}" for k, line in enumerate(lines)]
    table = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(other))], "doc_id long, text string")
    began = time.time()
    found = by_id(line_dedup.apply_bitmaps(table, line_dedup.keep_bitmaps(table)))
    assert time.time() - began < 60
    assert (found[1].n_lines, found[1].n_dropped) == (300_000, 0)
    assert (found[2].n_dropped, found[2].text) == (299_700, "\n".join(line for line in other if line[:5] == "fresh"))


# 5


def test_token_files(spark, docs, rows, none, odd):
    library = tokens.load(tokens.published(token_files.VOCABULARY))
    files = token_files.write_tokens(docs, shard_bytes=2000)
    assert files.shards.count() > 3
    found = by_id(files.digests())
    start = 0
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        if i % 40 == 0:
            assert files.document(i) == [ids]
    again = token_files.open_files(spark, files.path)  # as another session would
    assert again.dictionary == files.dictionary and again.document(40) == files.document(40) and by_id(again.digests()) == found
    folder = f"{files.path}-own"
    assert token_files.write_tokens(docs.limit(3), folder=folder).path == folder and token_files.open_files(spark, folder).digests().count() == 3
    shard = bytes(files.shards.first().shard)
    with pytest.raises(ValueError):
        list(token_files.unpack(shard, files.dictionary + b"x"))
    assert token_files.write_tokens(none).digests().count() == 0
    assert sorted(r.start for r in token_files.write_tokens(odd).digests().collect())[0] == 0


# 6


def brute_spans(texts: list[tuple], length: int) -> dict:
    seen, out = set(), {}
    for i, text in texts:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            window = raw[s : s + length]
            if window in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(window)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("length", "gram", "batch", "hot"), [(100, 28, 1 << 20, 4096), (100, 28, 500, 2), (30, 8, 3000, 4096)])
def test_suffix_dedup(docs, rows, none, odd, monkeypatch, length, gram, batch, hot):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", batch)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.remove_repeats(docs, length, gram).collect()}
    assert found == brute_spans([(r[0], r[1]) for r in rows], length)
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert sum(r.n_removed for r in suffix_dedup.remove_repeats(odd, 20, 8).collect()) == 2 * len("same words in this text here")


def test_shared_passage_leaves_a_task_once(spark, monkeypatch):
    """A passage in many surroundings: its windows go on once a task, not once a document."""
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    sent, rows_of = [], suffix_dedup.window_rows
    monkeypatch.setattr(suffix_dedup, "window_rows", lambda *a: sent.append(rows_of(*a)) or sent[-1])
    rng = random.Random(6)
    passage = sentence(rng, 60)
    texts = [(k, sentence(rng, 20) + passage + sentence(rng, 20)) for k in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2).cache()
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert found == brute_spans(texts, 100)
    kinds = Counter(r.kind for r in sent[0].collect())
    going = sent[0].where(f"kind = {suffix_dedup.FETCH}").groupBy("gram", "context").count()
    assert kinds[suffix_dedup.COVER] and going.where("count > 2").isEmpty()


def test_sorted_suffixes_and_boundaries():
    rng = np.random.default_rng(2)
    data = np.append(rng.integers(97, 99, 400), 255).astype(np.uint8)
    order = suffix_dedup.sorted_suffixes(data, 12)
    raw = data.tobytes()
    cut = [raw[p : p + 12] for p in order]
    assert cut == sorted(cut)
    bound = suffix_dedup.boundaries(data, order, 6)
    assert bound.tolist() == [True] + [a[:6] != b[:6] for a, b in zip(cut, cut[1:])]


# 7


def test_mixing(docs, rows, none, odd):
    found = by_id(mixing.mix(docs))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    source = {r[0]: r[3] for r in rows}
    total = Counter()
    for i in size:
        total[source[i]] += size[i]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    target, open_sources, left = {}, set(total), 1.5 * sum(total.values())
    while open_sources:
        rate = left / sum(weight[s] for s in open_sources)
        over = {s for s in open_sources if rate * weight[s] > 2 * total[s]}
        if not over:
            target |= {s: rate * weight[s] for s in open_sources}
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_sources -= over
    taken = Counter()
    for i in size:
        assert found[i].size == size[i] and found[i].source_size == total[source[i]] and found[i].target == pytest.approx(target[source[i]])
        assert 0 <= found[i].taken <= 2 * size[i]
        taken[source[i]] += found[i].taken
    for s in total:
        assert abs(taken[s] - target[s]) <= 1
    again = by_id(mixing.mix(docs.repartition(2)))
    assert {i: r.taken for i, r in again.items()} == {i: r.taken for i, r in found.items()}
    assert mixing.mix(none).count() == 0 and mixing.mix(odd).count() == 5 and mixing.apply_mix(none).count() == 0
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    for i in size:
        assert abs(times[i] * size[i] - found[i].taken) <= max(1, size[i] / 2)


# 8


def labelled_corpus(spark):
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(3000):
        words = sentence(rng, rng.randint(20, 80)).split(" ")
        kind = rng.choices(["good", "toxic", "junk"], [8, 1, 1])[0]
        if kind == "toxic":
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vileword", "horridword"]))
        if kind == "junk":
            words = [w + "###" for w in words]
        texts.append((i, " ".join(words), kind))
        if rng.random() < 0.4:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return spark.createDataFrame(texts, "doc_id long, text string, kind string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_resampling_held_out(spark, none, odd):
    docs, labels = labelled_corpus(spark)
    found = resampling.weigh(docs, labels)
    unlabelled = found.join(docs, "doc_id").join(labels, "doc_id", "left_anti").groupBy("kind").agg({"*": "count"}, ).collect()
    kept = {r.kind: r["count"] for r in found.where("kept").join(docs, "doc_id").join(labels, "doc_id", "left_anti").groupBy("kind").count().collect()}
    every = {r.kind: r["count(1)"] for r in unlabelled}
    assert kept["good"] >= 0.97 * every["good"]
    assert kept.get("toxic", 0) <= 0.05 * every["toxic"] and kept.get("junk", 0) <= 0.05 * every["junk"]
    first = {r.doc_id: r.kept for r in found.collect()}
    assert first == {r.doc_id: r.kept for r in resampling.weigh(docs.repartition(2), labels).collect()}
    assert resampling.weigh(none, labels).count() == 0
    assert resampling.weigh(odd, labels.limit(0)).where("kept").count() == 5


def test_resampling_brute_force(spark, monkeypatch):
    """Counts, weights and the draw against plain dictionaries: null, short, long and equal texts, null and repeated ids, clashing columns."""
    monkeypatch.setattr(resampling, "PIECE", 500)
    docs, labels = labelled_corpus(spark)
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id < 600").collect()] + [(601, None), (602, "abc"), (603, "vileword " * 400), (603, "Same text"), (604, "Same text"), (None, "Same text")]
    known = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.collect()}
    held = {r.doc_id for r in resampling.labelled(labels).where("holdout").collect()}
    grams = [{t.encode().lower()[k : k + 5] for k in range(len(t.encode()) - 4)} if t else set() for _, t in rows]
    name = lambda g: resampling.buckets(g)[:, 0].tolist()
    place = {g: name(g) for g in set().union(*grams)}
    raw, target = ([Counter() for _ in range(resampling.ROWS)] for _ in range(2))
    fit = [known.get(i, False) and i not in held for i, _ in rows]
    for found, good in zip(grams, fit):
        for g in found:
            for r, b in enumerate(place[g]):
                raw[r][b] += 1
                target[r][b] += good
    ratio, z = sum(fit) / len(rows), resampling.Z / 2

    def of_bucket(r, b):
        expected, n = raw[r][b] * ratio, target[r][b]
        low, high = max(n**0.5 - z, 0) ** 2 / expected, ((n + 1) ** 0.5 + z) ** 2 / expected
        return math.log(low) if low > 1 else math.log(high) if high < 1 else 0.0

    expected = []
    for found in grams:
        each = [[of_bucket(r, b) for r, b in enumerate(place[g])] for g in found]
        mean = sum(max(min(e), 0) for e in each) / max(len(each), 1)
        expected.append(mean + sum(min(max(e), 0) for e in each))
    table = spark.createDataFrame([(*row, 1, 2.0) for row in rows], "doc_id long, text string, key int, log_weight double").repartition(3)
    got = resampling.weigh(table, labels).collect()
    key = lambda w: (w[0] is None, w[0] or 0, w[1])
    assert len(got) == len(rows)
    for g, e in zip(sorted(((r.doc_id, r.log_weight) for r in got), key=key), sorted(zip([i for i, _ in rows], expected), key=key)):
        assert g[0] == e[0] and g[1] == pytest.approx(e[1], abs=1e-3)
    spare = np.quantile([w for (i, _), w in zip(rows, expected) if known.get(i) and i in held], resampling.SPARE)
    k = sum(r.log_weight >= spare - 1e-6 for r in got)
    keys = sorted((r.key for r in got), reverse=True)
    assert {r.key for r in got if r.kept} == {x for x in keys if x >= keys[k - 1] - 1e-9} and k < len(rows)
    half = resampling.weigh(table, labels, budget=0.5).where("kept").count()
    assert abs(half - len(rows) / 2) <= 2 and resampling.weigh(table, labels, budget=0.0).where("kept").count() == 0


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 100) for _ in range(2000)] + [5.0] * 50
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 7, 1000, 2050):
        cut = resampling.kth_largest(keys, k)
        assert abs(cut - sorted(values, reverse=True)[k - 1]) < 1e-6


# 9


def test_quality_metrics(docs, rows, none, odd, spark):
    found = by_id(quality_rules.metrics(docs))
    for i, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        places = defaultdict(list)
        for k in range(len(words) - 7):
            places[tuple(words[k : k + 8])].append(k)
        covered = {k + j for p in places.values() if len(p) > 1 for k in p for j in range(8)}
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (found[i].n_words, found[i].word_chars, found[i].n_symbols, found[i].n_dup_lines, found[i].n_repeat_words) == expected
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int")
    assert quality_rules.judge(none, labels).count() == 0
    assert quality_rules.judge(odd, labels).where("kept OR NOT base_failed").count() == 0


def test_binomial_tail(spark):
    from math import comb

    from pyspark.sql import functions as F

    cases = [(n, k, p) for n in (1, 10, 200, 1500) for k in (0, 1, 3, 7) if k <= n for p in (0.005, 0.2)]
    for n, k, p in cases:
        got = spark.range(1).select(quality_rules.lower_tail(F.lit(float(n)), F.lit(float(k)), p).alias("x")).first().x
        exact = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        assert got == pytest.approx(1.0 if k >= n * p else exact, rel=1e-9)


def test_safe_cutoffs(spark):
    rows = [(i, "en", 100, 0 if i % 10 else 50, 0, 1, 0, 0) for i in range(6000)]
    found = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, n_symbols long, n_shouts long, n_lines long, n_dup_lines long, n_repeat_words long")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(6000)], "doc_id long, quality int")
    assert quality_rules.safe_cutoffs(found, labels).first().cutoffs == {"symbols": 0.4}
    assert quality_rules.safe_cutoffs(found, labels.limit(100)).count() == 0  # too few for the bound


def test_judge_with_live_cutoffs(spark):
    """Rules that are on, against plain counting: two strata and a null one, ties between cutoffs, unlabelled rows, a stratum that is too small."""
    from math import comb

    rng = random.Random(12)
    texts, labels = [], []
    for i in range(5200):
        stratum = rng.choice(["en", "en", "de", None]) if i < 5000 else "small"
        words = [f"w{rng.randrange(900)}" for _ in range(30)]
        bad = rng.random() < 0.2
        for _ in range(rng.choice([3, 12, 20]) if bad else rng.choices([0, 1, 2], [300, 3, 1])[0]):
            words[rng.randrange(30)] = rng.choice(["###", "&&&&"])
        if bad and rng.random() < 0.3:
            words += ["now!!!!!!!!!!!!!!!!"] * 3
        texts.append((i, " ".join(words), stratum))
        if i % 4:
            labels.append((i, int(not bad)))
    label = dict(labels)

    def share(rule, text):
        n = len(text.split(" "))
        return {"symbols": len(re.findall(r"[#*$%&|<>]", text)) / n, "shouts": text.count("!") / n, "dup_lines": 0.0, "repeats": 0.0}[rule]

    strata, expected, live = ["en", "de", None, "small"], {}, 0
    risk, delta = 0.02, 0.05
    for s in strata:
        for rule in quality_rules.RULES:
            rows = [(share(rule, t), label[i]) for i, t, x in texts if x == s and i in label]
            n, found = sum(good for _, good in rows), []
            for c in sorted(quality_rules.GRID, reverse=True):
                k, hits = sum(good for v, good in rows if v > c), sum(not good for v, good in rows if v > c)
                p = 1.0 if k >= n * risk else sum(comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(k + 1))
                if p > delta / (len(strata) * len(quality_rules.RULES)):
                    break
                if hits:
                    found.append((hits, -k, c))
            if found:
                expected[s, rule] = max(found)[2]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int"), risk, delta).collect()}
    for i, text, s in texts:
        out = any(share(rule, text) > expected[s, rule] for rule in quality_rules.RULES if (s, rule) in expected)
        live += out
        assert got[i] == (not out), (i, s, text)
    assert {s for s, _ in expected} == {"en", "de", None} and ("en", "shouts") in expected and live > 500


# 10


@pytest.mark.parametrize("small", [8, 2])
def test_jaccard(docs, rows, none, odd, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "MANY", 3)
    monkeypatch.setattr(jaccard, "FLUSH", 500)
    sets, parent = {}, {}
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    partners = defaultdict(set)
    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if sets[a] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common) and sets[b]:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
            if sets[a] != sets[b]:
                partners[a].add(b)
                partners[b].add(a)
    found = by_id(jaccard.jaccard_components(docs))
    for i in sets:
        assert (found[i].n_shingles, found[i].component_id) == (len(sets[i]), root(i))
        assert found[i].n_links == len({frozenset(sets[k]) for k in partners[i]})
        assert found[i].class_id == min(k for k in sets if sets[k] == sets[i]) or not sets[i]
    assert jaccard.jaccard_components(none).count() == 0
    ids = sorted(str(r.component_id) for r in jaccard.jaccard_components(odd).collect())
    assert ids == ["1", "1", "1", "1", "None"]


def test_names_that_several_sets_bear(spark, docs, monkeypatch):
    """Sets with one 64-bit name are told apart by the second one."""
    right = {(r.doc_id, r.component_id, r.class_id, r.n_links) for r in jaccard.jaccard_components(docs).collect()}
    monkeypatch.setattr(jaccard, "class_of", lambda found: int(found.sum() % 40))
    assert {(r.doc_id, r.component_id, r.class_id, r.n_links) for r in jaccard.jaccard_components(docs).collect()} == right


def test_components_without_counts(docs):
    right = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    found = jaccard.jaccard_components(docs, count_links=False).collect()
    assert {(r.doc_id, r.component_id) for r in found} == right and {r.n_links for r in found} == {None}


@pytest.mark.parametrize("size", [1, 3, 4, 5, 6, 9, 14, 20, 30, 60, 200, 700])
def test_signatures_meet(size):
    """Any two different sets that reach the threshold share a signature, whatever counts as frequent. Equal sets are one class, which needs none."""
    rng = np.random.default_rng(size)
    bands = jaccard.Bands(80, 100)
    for trial in range(200):
        base = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        a, b = base[rng.random(len(base)) > 0.05], np.concatenate([base, rng.integers(0, 2**63, rng.integers(0, size // 6 + 1), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if len(a) and not np.array_equal(a, b) and 100 * common >= 80 * (len(a) + len(b) - common):
            frequent = jaccard.Frequent(base[rng.random(len(base)) < rng.choice([0, 0.3, 0.9, 1])])
            assert len(np.intersect1d(jaccard.signatures(a, bands, frequent), jaccard.signatures(b, bands, frequent)))


def edited(words: list[str], places: list[int], mark: str) -> list[str]:
    return [f"{mark}{k}" if k in places else w for k, w in enumerate(words)]


def bridged(rng: random.Random) -> tuple[list[str], list[str]]:
    """Two families of 24 near copies whose only link ties two members that are least of no bucket."""
    name = lambda words: jaccard.class_of(kernels.shingles(" ".join(words).encode()))
    own = [k for k in range(12, 190, 6) if k not in (60, 66, 120, 126)][:23]
    while True:
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        one = [base, *[edited(base, [k], "u") for k in own]]
        if max(one, key=name) == base:
            break
    while True:
        far = edited(base, [6, 66, 126, 194], f"p{rng.randrange(10**6)}x")
        two = [far, *[edited(far, [k + 2], "v") for k in own]]
        if max(two, key=name) == far:
            break
    return [" ".join(w) for w in one], [" ".join(w) for w in two]


def brute_links(texts: list[str]) -> tuple[list[int], list[int]]:
    """Component (least index) and number of links of each of distinct texts."""
    words = [t.split(" ") for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in words]
    root, links = list(range(len(texts))), [0] * len(texts)
    for a, b in itertools.combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            links[a], links[b] = links[a] + 1, links[b] + 1
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    return root, links


@pytest.mark.parametrize("seed", range(2))
def test_bridge_between_others_than_least(spark, seed):
    """The families stand in tasks of their own."""
    one, two = bridged(random.Random(seed))
    root, links = brute_links(one + two)
    assert set(root) == {0} and brute_links(one[1:] + two)[0].count(0) == len(one) - 1 and links[0] == len(one)
    parts = [spark.createDataFrame([(k + first, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1) for first, texts in ((0, one), (len(one), two))]
    found = by_id(jaccard.jaccard_components(parts[0].union(parts[1])))
    assert {r.component_id for r in found.values()} == {0}


@pytest.mark.parametrize("part", [256, 7])
def test_link_counts(spark, part, monkeypatch):
    """Links of a family are all counted, however it is dealt."""
    monkeypatch.setattr(jaccard, "PART", part)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(edited(base, rng.sample(range(200), rng.randint(1, 4)), f"e{n}x")) for n in range(60)]
    root, links = brute_links(texts)
    found = by_id(jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)))
    assert [(found[k].component_id, found[k].n_links) for k in range(60)] == list(zip(root, links)) and max(links) > 8
