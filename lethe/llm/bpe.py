"""Operator 13: byte-level BPE with a segment tree over the ranks of adjacent pairs.

The leaf of place i holds rank * width + i for the pair of the symbol at i and the next living one, and every inner node the least
of its two children: the root is the leftmost pair of the lowest rank. A merge changes three leaves at most (the merged pair, the
pair before it and the one that vanishes), each updated along one path to the root; it ends when no mergeable pair is left.
Pre-tokens of up to LONGEST bytes are merged together, one tree a row; a longer one has a tree of its own.

Texts are cut where special strings stand, then at stable boundaries (``tokens.pieces``), then into pre-tokens; a piece seen before
takes its ids from a bounded cache. Decoding looks up the bytes of each id. The vocabulary file gives vocabulary, merges, special
strings and pre-tokenizer; models with other parts (normalizer, dropout, prefixes, ...) are turned down.

Null text: empty, no ids. Bytes that are no UTF-8 are replaced first. One row per row of the input, repeated rows and ids included; no
shuffle. An empty table gives no row. Only the two named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, tokens

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens of up to so many bytes are merged together.
LONGEST = 64
#: Pieces in each of two generations and pre-tokens whose ids are kept, and characters of texts that are encoded together.
CACHE_PIECES, CACHE_WORDS, BATCH_CHARS = 250_000, 150_000, 1 << 20
NONE = np.int32(2**31 - 1)
#: The pre-tokenizer's pattern on ASCII.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_BYTE_OF_MARK = {mark: byte for byte, mark in tokens.BYTE_MARKS.items()}


class PairRanks:
    """Rank of a pair of ids, by open addressing in numpy arrays."""

    BITS = 18

    def __init__(self, left: np.ndarray, right: np.ndarray, size: int):
        self.size, keys = size, left * size + right
        while 4 * len(keys) > 1 << self.BITS:
            self.BITS += 1
        self.keys, self.ranks = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, NONE, np.int32)
        todo, slots = np.arange(len(keys)), self.slots(keys)
        while len(todo):  # each round every free slot takes the first of the pairs that want it
            free = self.keys[slots] < 0
            self.keys[slots[free][::-1]] = keys[todo[free][::-1]]
            placed = self.keys[slots] == keys[todo]
            self.ranks[slots[placed]] = todo[placed]
            todo, slots = todo[~placed], (slots[~placed] + 1) & ((1 << self.BITS) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE for pairs that do not merge."""
        keys = left * np.int64(self.size) + right
        slots = self.slots(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.ranks[slots], NONE)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & ((1 << self.BITS) - 1)
            held = self.keys[slots[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.ranks[slots[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out


class Model:
    """What a vocabulary file says: merges by rank, ids of bytes, bytes of ids, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += ["normalizer"] if spec.get("normalizer") else []
        odd += ["special strings"] if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]) else []
        if odd or model["type"] != "BPE" or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
            raise ValueError(f"{path}: not a plain byte-level BPE ({', '.join(odd) or 'model or pre-tokenizer'})")
        vocabulary = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.left, self.right = (np.array([vocabulary[pair[side]] for pair in pairs], np.int64) for side in (0, 1))
        self.merged = np.array([vocabulary["".join(pair)] for pair in pairs], np.int64)
        self.ranks = PairRanks(self.left, self.right, size)
        self.byte_ids = np.array([vocabulary[chr(tokens.BYTE_MARKS.get(b, b))] for b in range(256)], np.int64)
        self.bytes_of = [b""] * size
        for token, at in (*vocabulary.items(), *self.special.items()):
            marks = [_BYTE_OF_MARK.get(ord(c), ord(c)) for c in token]
            self.bytes_of[at] = bytes(marks) if max(marks, default=0) < 256 else token.encode()
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids (unsigned 32-bit, little-endian) of words of at most ``width`` bytes, a power of two; a segment tree a row."""
        n, bits = len(words), width.bit_length() - 1
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        column = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        symbols = np.full((n, width), -1, np.int64)
        symbols[np.repeat(np.arange(n), sizes), column] = self.byte_ids[data]
        after, before = np.tile(np.arange(1, width + 1), n), np.tile(np.arange(-1, width - 1), n)
        after.reshape(n, width)[np.arange(n), sizes - 1] = width
        tree = np.full((n, 2 * width), NONE, np.int32)
        row, i = np.nonzero(symbols[:, 1:] >= 0)
        tree[row, width + i] = self.keys(symbols[row, i], symbols[row, i + 1], i, bits)
        for level in range(bits - 1, -1, -1):
            low = 1 << level
            np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2], out=tree[:, low : 2 * low])
        flat, leaves, live = symbols.reshape(-1), tree.reshape(-1), np.arange(n)
        while True:
            root = leaves[live * (2 * width) + 1]
            if not (going := root != NONE).all():
                live, root = live[going], root[going]
            if not len(live):
                break
            i, start, base = (root & (width - 1)).astype(np.int64), live * width, live * (2 * width)
            at = start + i
            j = after[at]
            k, p, new = after[start + j], before[at], self.merged[root >> bits]
            flat[at], flat[start + j], after[at] = new, -1, k
            right, left = np.flatnonzero(k < width), np.flatnonzero(p >= 0)
            before[(start + k)[right]] = i[right]
            keys = self.keys(
                np.concatenate((new[right], flat[(start + p)[left]])), np.concatenate((flat[(start + k)[right]], new[left])), np.concatenate((i[right], p[left])), bits
            )
            leaves[base + width + i], leaves[base + width + j] = NONE, NONE
            leaves[(base + width + i)[right]], leaves[(base + width + p)[left]] = keys[: len(right)], keys[len(right) :]
            node, base = np.concatenate((i, j, p[left])) + width, np.concatenate((base, base, base[left]))
            for _ in range(bits):
                node >>= 1
                child = base + 2 * node
                leaves[base + node] = np.minimum(leaves[child], leaves[child + 1])
        alive = symbols >= 0
        ends = np.cumsum(alive.sum(1)) * 4
        ids = symbols[alive].astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
        ranks = self.ranks.find(left, right)
        return np.where(ranks == NONE, NONE, (ranks << bits) | place.astype(np.int32))

    @functools.cached_property
    def rank_of(self) -> dict[tuple[int, int], int]:
        return {pair: rank for rank, pair in reversed(list(enumerate(zip(self.left.tolist(), self.right.tolist()))))}

    def merge_long(self, word: bytes) -> bytes:
        """Ids of one word of any length, by one tree."""
        width = 1 << max(1, len(word) - 1).bit_length()
        symbols = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before, none = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1)), 1 << 62
        tree = [none] * (2 * width)

        def key(i: int, j: int) -> int:
            rank = self.rank_of.get((symbols[i], symbols[j])) if j < len(word) else None
            return none if rank is None else rank * width + i

        def update(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            while node > 1 and tree[node := node >> 1] != (least := min(tree[2 * node], tree[2 * node + 1])):
                tree[node] = least

        for i in range(len(word) - 1):
            tree[width + i] = key(i, i + 1)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] != none:
            rank, i = divmod(tree[1], width)
            j, symbols[i] = after[i], int(self.merged[rank])
            after[i], symbols[j] = after[j], -1
            if after[i] < len(word):
                before[after[i]] = i
            update(j, none)
            update(i, key(i, after[i]))
            if before[i] >= 0:
                update(before[i], key(before[i], i))
        return np.array([s for s in symbols if s >= 0], "<u4").tobytes()

    def merge(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct pre-tokens."""
        out: dict[bytes, bytes] = {}
        by_width: dict[int, list[bytes]] = {}
        for word in words:
            if len(word) > LONGEST:
                out[word] = self.merge_long(word)
            else:
                by_width.setdefault(max(2, 1 << (len(word) - 1).bit_length()), []).append(word)
        for width, some in by_width.items():
            out.update(zip(some, self.merge_rows(some, width)))
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class Encoder(tokens.PieceCache):
    """Ids of pieces, merged by ``Model``; the library's pre-tokenizer cuts those that are not plain."""

    limit = CACHE_PIECES

    def __init__(self, path: str):
        super().__init__(path, bytes, plain=True)
        self.model, self.words = Model(path), {}
        self.feed = len(self.folded([[tokens.LITERAL + "\n"]], b"".join)[0])

    def pre_tokens(self, key: str) -> list[bytes]:
        """Of a piece as ``tokens.pieces`` writes it."""
        if key.isalpha() and (key.isascii() or max(key) < "ɐ"):
            return [b" " + key.encode()]
        text = key[1:] if key[:1] == tokens.LITERAL else key if key[:1] == "\n" else " " + key
        if text.isascii():
            return [word.encode() for word in _ASCII.findall(text)]
        marks = (word for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
        return [word.translate(_BYTE_OF_MARK).encode("latin-1") for word in marks]

    def learn(self, keys: Iterable[str]) -> None:
        young, old, cut = self.young, self.old, {}
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        for key in set(keys):
            if key not in young:
                found = old.get(key) if old else None
                if found is None:
                    cut[key] = self.pre_tokens(key)
                else:
                    young[key] = found
        words = self.words
        words.update(self.model.merge({word for found in cut.values() for word in found if word not in words}))
        for key, found in cut.items():
            young[key] = words[found[0]] if len(found) == 1 else b"".join([words[word] for word in found])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, special strings included."""
        model, parts, of = self.model, [], []
        for k, text in enumerate(texts):
            if model.cut is None or not any(special in text for special in model.special):
                parts.append(text)
                of.append(k)
                continue
            for part in model.cut.split(text):
                parts.append(part)
                of.append(k)
        plain = [k for k, part in enumerate(parts) if part not in model.special]
        found: list[bytes] = [b""] * len(parts)
        for k, ids in zip(plain, self.folded([tokens.pieces(parts[k]) for k in plain], b"".join)):
            found[k] = ids[self.feed :]
        out: list[list[bytes]] = [[] for _ in texts]
        for k, (part, ids) in enumerate(zip(parts, found)):
            out[of[k]].append(model.special[part].to_bytes(4, "little") if part in model.special else ids)
        return [b"".join(ids) for ids in out]


@shared.kept
def encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


def grouped(texts: Iterable[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """doc_id, ids (unsigned 32-bit integers, little-endian) of whole texts; with ``decode`` also the text that these ids stand for.

    path: the vocabulary file, on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path or tokens.published(VOCABULARY))
        for batch in batches:
            texts = (raw.decode("utf-8", "replace") for raw in shared.texts_of(batch, "text"))
            ids = [found for some in grouped(texts) for found in coder.encode(some)]
            columns = {"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.binary())}
            if decode:
                columns["text"] = pa.array(map(coder.model.decode, ids), pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return shared.id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary" + ", text string" * decode)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) with the text that the ids stand for, special strings included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = model(path or tokens.published(VOCABULARY)).decode
        for batch in batches:
            texts = pa.array((decode(ids.as_py() or b"") for ids in batch.column("ids")), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), texts], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_documents(shared.table(spark, sf_dir, "documents"), decode=True)
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )
