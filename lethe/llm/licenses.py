"""Operator 1: licence scans.

One Aho-Corasick automaton runs over each whole text, reduced to lower-case words between single spaces.
It finds base phrases, further notice phrases and identifier tags. The expression behind a tag
(``MIT OR Apache-2.0 WITH LLVM-exception``) goes through a shunting-yard parser; notices that stand
close together and are joined by and/or/with form an expression as well: of several such words between two notices the last
one holds, of none ``and``. What stands behind ``with`` counts as an exception of what stands before it. ``score`` is the
permissiveness of all statements: ``and`` takes the lowest, ``or`` the highest, ``with`` goes half the way to 1; a text
without any statement scores 0.

Null and empty texts have no words and no statements; a null id stays null; a repeated row gives its result again. A text is
scanned whole in time proportional to its length; of notices that start at one word the longest counts for the score, all
for the labels. The work is one narrow pass over the text (no shuffle). An empty table gives no row. Only the two named columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import shared
from .kernels import ALNUM_OR_SPACE

BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Labels that the method adds.
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "released into the public domain": "public-domain",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "all rights reserved": "proprietary",
    "boost software license": "bsl",
    "business source license": "busl",
    "server side public license": "sspl",
    "artistic license": "artistic",
    "zlib license": "zlib",
    "sil open font license": "ofl",
    "european union public license": "eupl",
    "common development and distribution license": "cddl",
    "python software foundation license": "psf",
    "open database license": "odbl",
    "do what the fuck you want to public license": "wtfpl",
}
TAG = "spdx license identifier"
#: How permissive a licence is, from 0 to 1; a licence that is not listed counts as UNKNOWN.
PERMISSIVENESS = {
    "public-domain": 1.0, "cc0": 1.0, "cc0-1.0": 1.0, "unlicense": 1.0, "0bsd": 1.0, "mit": 0.95, "isc": 0.95, "bsd": 0.95,
    "bsd-2-clause": 0.95, "bsd-3-clause": 0.95, "apache": 0.9, "apache-2.0": 0.9, "cc-by": 0.8, "cc-by-4.0": 0.8,
    "mpl": 0.6, "mpl-2.0": 0.6, "epl": 0.6, "epl-2.0": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2,
    "cc-by-nd": 0.2, "cc-by-nc": 0.2, "proprietary": 0.0, "wtfpl": 1.0, "bsl": 0.95, "zlib": 0.95, "x11": 0.95, "ncsa": 0.95,
    "postgresql": 0.95, "python": 0.9, "psf": 0.9, "artistic": 0.7, "ofl": 0.7, "cddl": 0.6, "eupl": 0.5, "odbl": 0.5, "sspl": 0.1, "busl": 0.1,
}
UNKNOWN = 0.1
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: Words that may stand between two notices of one expression.
NEAR = 8

_TAG = r"spdx[^0-9a-z]+license[^0-9a-z]+identifier"
#: What stands behind a tag, up to the line's end or the next tag.
_TAG_TEXT = re.compile(rf"(?i){_TAG}[^0-9a-z(\n]*([^\n]*?)(?=(?<![0-9a-z]){_TAG}|\n|\Z)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")


def grammatical(tokens: list[str]) -> list[str]:
    """The longest leading part that is an expression, with open brackets closed."""
    out: list[str] = []
    depth, want_operand, best = 0, True, 0
    for token in tokens:
        word = token.lower()
        if want_operand:
            if token == "(":
                depth += 1
            elif token == ")" or word in PRECEDENCE:
                break
            else:
                want_operand = False
        elif token == ")" and depth:
            depth -= 1
        elif word in PRECEDENCE:
            want_operand = True
        else:
            break
        out.append(word)
        if not want_operand:
            best = len(out)
    out = out[:best]
    return out + [")"] * (out.count("(") - out.count(")"))


def shunting_yard(tokens: list[str]) -> list[str]:
    """Reverse Polish order of an expression that ``grammatical`` has accepted."""
    out: list[str] = []
    held: list[str] = []
    for token in tokens:
        if token == "(":
            held.append(token)
        elif token == ")":
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif token in PRECEDENCE:
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[token]:
                out.append(held.pop())
            held.append(token)
        else:
            out.append(token)
    return out + held[::-1]


def permissiveness(name: str) -> float:
    base = name.rstrip("+").removesuffix("-only").removesuffix("-or-later")
    if base in PERMISSIVENESS:
        return PERMISSIVENESS[base]
    family = re.sub(r"-[\d.]+$", "", base)
    return PERMISSIVENESS.get(family, UNKNOWN)


def evaluated(tokens: list[str]) -> tuple[float, set[str]] | None:
    """Score and licence names of an expression; None if there is none."""
    tokens = grammatical(tokens)
    if not tokens:
        return None
    stack: list[tuple[float, set[str]]] = []
    for token in shunting_yard(tokens):
        if token in PRECEDENCE:
            (b, right), (a, left) = stack.pop(), stack.pop()
            if token == "with":  # the right side names an exception, not a licence
                stack.append((a + (1 - a) / 2, left))
            else:
                stack.append(((max if token == "or" else min)(a, b), left | right))
        else:
            stack.append((permissiveness(token), {token}))
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in {**NOTICE_PHRASES, **BASE_PHRASES, TAG: ""}.items():
        found.add_word(f" {phrase} ", (phrase, label, phrase in BASE_PHRASES))
    found.make_automaton()
    return found


def scan(text: bytes, finder: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = text.translate(ALNUM_OR_SPACE).split()
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    base_at: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    notices: list[tuple[int, int, str]] = []
    tagged, seen, spaces = False, 0, 0
    for end, (phrase, label, is_base) in finder.iter(joined):
        spaces += joined.count(" ", seen, end + 1)
        seen = end + 1  # matches come by their ends
        at = spaces - 2 - phrase.count(" ")
        if not label:
            tagged = True
            continue
        if is_base:
            base_at.append(at)
            base.add(label)
        labels.add(label)
        notices.append((at, at + phrase.count(" ") + 1, label))
    score = None
    if notices:
        notices.sort(key=lambda n: (n[0], -n[1]))
        tokens: list[str] = []
        reach = 0
        for start, end, label in notices:
            if tokens and start < reach:  # inside a longer notice
                continue
            if tokens:
                gap = words[reach:start]
                near = [w.decode() for w in gap if w in (b"and", b"or", b"with")] if len(gap) <= NEAR else []
                tokens.append(near[-1] if near else "and")
            tokens.append(label)
            reach = end
        score = evaluated(tokens)[0]
    if tagged:
        for match in _TAG_TEXT.finditer(text.decode("utf-8", "replace")):
            if (value := evaluated(_TOKEN.findall(match[1]))) is not None:
                labels |= value[1]
                score = value[0] if score is None else min(score, value[0])
    return (
        len(words), len(base_at), min(base_at, default=None), max(base_at, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), 0.0 if score is None else float(score),
    )


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``; see the module's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in batches:
            rows = [scan(text, finder) for text in shared.texts_of(batch, "text")]
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)] if rows else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    return shared.id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(shared.table(spark, sf_dir, "documents"))
