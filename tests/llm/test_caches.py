"""What Python workers keep over their tasks, and how pieces are learnt."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from lethe.llm import bpe, shared, tokens


def test_caches_are_dropped_in_stages_without_them(monkeypatch):
    path, batch = tokens.published("byte_bpe_50k.json"), pa.RecordBatch.from_pydict({"text": ["a text"]})
    monkeypatch.setattr(shared, "stage_id", lambda: 1)
    shared.drop_unused()
    cache, coder = tokens.id_cache(path), bpe.encoder(path)
    list(shared.texts_of(batch, "text"))  # of the stage that uses them
    assert tokens.id_cache(path) is cache and bpe.encoder(path) is coder
    monkeypatch.setattr(shared, "stage_id", lambda: 2)
    assert tokens.id_cache(path) is cache  # a later stage that asks for it before it reads texts
    list(shared.texts_of(batch, "text"))
    assert tokens.id_cache(path) is cache
    assert bpe.encoder(path) is not coder
    monkeypatch.setattr(shared, "stage_id", lambda: 3)
    list(shared.texts_of(batch, "text"))
    assert tokens.id_cache(path) is not cache


def test_new_words_are_learnt_together():
    path, draw = tokens.published("byte_bpe_50k.json"), random.Random(5)
    words = sorted({"".join(draw.choices("abcdefghinorstéüñ", k=draw.randint(3, 12))) for _ in range(5000)})
    cache, calls = tokens.PieceCache(path, lambda ids: np.fromiter(ids, "<u4").tobytes(), plain=True), []
    value = cache.value
    cache.value = lambda ids: calls.append(1) or value(ids)
    texts = [" ".join(f"{word}{draw.choice(['', '.', ','])}" for word in words[k : k + 100]) for k in range(0, len(words), 100)]
    found = cache.folded([tokens.pieces(text) for text in texts], b"".join)
    feed = value(cache.tokenizer.encode("\n").ids)
    assert [ids[len(feed) :] for ids in found] == [value(cache.tokenizer.encode(text, add_special_tokens=False).ids) for text in texts]
    assert len(calls) < 300  # not one for each word
    assert len(cache.young) < len(words) + 300  # a word with a stop or a comma is not kept beside the word


def test_stops_and_commas_are_cut_where_they_are_runs():
    path = tokens.published("byte_bpe_50k.json")
    texts = ["Is. a, 3. b!. c.d,e f.", "é, ñ. ×. 中. 中, don't. x\ny.\n.", ".", ",", "a.", "<|endoftext|>. a, <|endoftext|>, b.", "a., b,. ![. c", "a\x00. b,", "", "Ġa. Ġ, Ġ", "ǀ. ɏ, ɐ."]
    tokenizer = tokens.load(path)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in tokens.encode(texts, path)] == [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert tokens.pieces("so is. it, 3.") == ["\nso", "is", "\0.", "it", "\0,", "3."]
