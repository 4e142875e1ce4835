"""Encoding with a published tokenizer, piece by piece, through boundaries that are proven stable.

A boundary is stable if no token can run across it and the tokens on either side do not depend on the other side.
The pre-tokenizers used here match letters, digits, other characters and white space in separate alternatives, so a
boundary lies between a non-space character and white space, and between a letter and a lone mark that ends a run.
Distinct pieces are encoded once by the library; a worker keeps them in a bounded cache over its tasks.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable
from itertools import accumulate, chain, compress, count, pairwise
from operator import attrgetter, not_
from typing import Any

import numpy as np

from .shared import kept

#: Pieces in each of the cache's two generations; about 200 bytes each.
CACHE_PIECES = 400_000
#: Marks that form a run of their own behind a letter. Not the apostrophe (contractions), nor what special tokens are written with.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
LITERAL = "\0"
#: How byte-level models write bytes: printable ones as they are, the others from U+0100 on, in order.
BYTE_MARKS = dict(zip([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)], range(256, 512)))
SPACE_MARK = chr(BYTE_MARKS[32])
MARKS_OF_WORDS = {byte: mark for byte, mark in BYTE_MARKS.items() if byte != 32}
ID = attrgetter("id")
#: Words that the model encodes in one call.
WORDS = 2048


def published(name: str) -> str:
    """The place of a published vocabulary file: in the folder TOKENIZER_DIR if set, else in the installed package."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class PieceCache:
    """What ``value`` makes of the ids of each piece; the values of parts add up.

    In a byte-level model without a normalizer (plain) a piece is written for look-up without its leading space; one with a
    leading line feed is that and what follows, and one after LITERAL stands for itself. The values are bytes then, as many for each id.
    """

    limit = CACHE_PIECES

    def __init__(self, path: str, value: Callable[[Iterable[int]], Any], plain: bool = False):
        self.tokenizer, self.value, self.plain = load(path), value, plain
        self.young, self.old = {}, {}
        if plain:
            from tokenizers import Tokenizer
            from tokenizers.pre_tokenizers import CharDelimiterSplit

            self.bare = Tokenizer(self.tokenizer.model)  # cuts at blanks only
            self.bare.pre_tokenizer = CharDelimiterSplit(" ")
            self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.begins[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(SPACE_MARK)]] = True

    def learn_words(self, keys: list[str]) -> None:
        """A space and letters are one pre-token, so the model alone gives its ids: the first of them begins with the space, no other does."""
        for k in range(0, len(keys), WORDS):
            some = keys[k : k + WORDS]
            text = " ".join(some)
            if not text.isascii():
                text = text.encode().decode("latin-1").translate(MARKS_OF_WORDS)
            text = SPACE_MARK + text.replace(" ", " " + SPACE_MARK)
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids)
            packed, first = self.value(ids.tolist()), np.flatnonzero(self.begins[ids])
            if len(first) == len(some):
                ends = [*(first * (len(packed) // len(ids))).tolist(), len(packed)]
                self.young.update(zip(some, [packed[s:e] for s, e in pairwise(ends)]))
            else:  # a vocabulary that lacks the space
                self.young.update(zip(some, [self.value(map(ID, self.tokenizer.model.tokenize(word))) for word in text.split(" ")]))

    def learn(self, keys: Iterable[str]) -> None:
        """Puts a value for each of ``keys`` into the cache."""
        young, old, plain = self.young, self.old, self.plain
        literal, value, tokenize = LITERAL if plain else "", self.value, self.tokenizer.model.tokenize
        sums, todo, ascii_words, words = [], list(set(keys)), {}, []
        single: dict[str, None] = {}
        for key in todo:  # grows by the parts of sums
            if key in young:
                continue
            if old and (found := old.get(key)) is not None:
                young[key] = found
                continue
            if key.isalpha():
                if plain and key.isascii():
                    ascii_words[key] = None
                else:
                    single[key] = None
                continue
            stem = key.rstrip(MARKS)
            if len(stem) < len(key) and stem[-1:] < "\u0250" and stem[-1:].isalpha() and len(stem[-1].lower()) == 1:
                parts = stem, literal + key[len(stem) :]  # marks after a letter at the end are a run of their own
            elif plain and key[:1] == "\n" and len(key) > 1:
                parts = LITERAL + "\n", LITERAL + key[1:]
            else:
                single[key] = None
                continue
            sums.append((key, *parts))
            todo += parts
        others = []
        if plain:
            for key in single:
                if key[:1] == LITERAL and key[1:].isalpha() and key.isascii():
                    young[key] = value(map(ID, tokenize(key[1:])))
                    continue
                if key.isalpha() and max(key) < "\u0250":
                    words.append(key)
                    continue
                others.append(key)
            self.learn_words(list(ascii_words))
            self.learn_words(words)
        else:
            others = list(single)
        for k in range(0, len(others), 4096):
            some = others[k : k + 4096]
            texts = [key[1:] if key[:1] == LITERAL else " " + key for key in some] if plain else some
            encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            young.update(zip(some, [value(found.ids) for found in encoded]))
        for key, one, two in reversed(sums):  # a part that is a sum itself comes after its whole
            young[key] = young[one] + young[two]

    def folded(self, texts: list[list[str]], fold: Callable[[Iterable[Any]], Any]) -> list[Any]:
        """What ``fold`` makes of the values of each text's pieces."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        parts = list(chain.from_iterable(texts))
        values = list(map(self.young.get, parts))
        if missed := list(compress(count(), map(not_, values))):
            self.learn([parts[k] for k in missed])
            for k in missed:
                values[k] = self.young[parts[k]]
        return [fold(values[s:e]) for s, e in pairwise([0, *accumulate(map(len, texts))])]


@kept
def id_cache(path: str, width: int = 4) -> PieceCache:
    """Ids as little-endian unsigned integers of 2 or 4 bytes."""
    kind = "H" if width == 2 else "I"

    def packed(ids: Iterable[int]) -> bytes:
        out = array(kind, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    return PieceCache(path, packed, plain=True)


@kept
def count_cache(path: str) -> PieceCache:
    return PieceCache(path, len)


#: The character that marks the cuts, and white space other than space and line feed.
_ODD = re.compile("[\0\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE = re.compile(r"[\s\x1c-\x1f\x85]")
#: A full stop and a comma between a letter and a blank or the end: runs of their own, and most words are met without them.
_STOP, _COMMA = (re.compile(f"{mark}(?= |\\Z)(?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]{mark})") for mark in (r"\.", ","))


def pieces(text: str) -> list[str]:
    """A line feed and ``text``, cut before each space after a non-space character, lone line feeds and most stops and commas, as keys of ``id_cache``."""
    if not ("  " in text or "\n\n" in text or "\n " in text or " \n" in text or text[:1] in " \n" or text[-1:] in " \n" or _ODD.search(text)):
        return _COMMA.sub(f" {LITERAL},", _STOP.sub(f" {LITERAL}.", f"\n{text}".replace("\n", " \n"))).split(" ")[1:]
    parts = text.split(" ")
    out = [parts[0]]
    for part in parts[1:]:
        if not out[-1] or _SPACE.match(out[-1][-1]):  # a space after white space is no boundary
            out[-1] += " " + part
        else:
            out.append(" " + part)
    return [LITERAL + "\n", *[part[1:] if part[:1] == " " and part[1:].isalpha() else LITERAL + part for part in out]]


def encode(texts: list[str], path: str, width: int = 4) -> list[bytes]:
    """Ids of whole byte-level BPE texts as little-endian unsigned integers of ``width`` bytes."""
    cache = id_cache(path, width)
    feed = len(cache.folded([[LITERAL + "\n"]], b"".join)[0])
    return [found[feed:] for found in cache.folded([pieces(text) for text in texts], b"".join)]
