"""Operator 3: token counts with overlap resynchronisation.

A text of more than ``chunk`` characters is encoded in overlapping chunks with offsets, and its tokens are counted from these
encodings. Two neighbouring chunks are spliced at a stable common boundary: the first character of a non-space run at which a
token starts in either encoding, after a run that lies in both chunks and that both have cut into the same tokens. The
normalizer (NFC, white space, lower case) and the pre-tokenizer treat such runs alone, so the tokens on either side do not
depend on what lies beyond. The last such boundary of the overlap is taken. If there is none, the overlap is widened to the
left, twofold each time; when it holds the whole left chunk, the chunk grows to the right instead, at last to the text's end.
A text of one chunk is encoded run by run, and a run that has been encoded before takes its count from a bounded cache.

Null text: empty, no tokens. One row per row of the input; no shuffle. Repeated rows and ids are counted each. An empty table gives no
row. Only the two named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import shared, tokens

VOCABULARY = "word_bpe_49k.json"
CHUNK, OVERLAP, LIMIT = 1 << 14, 256, 2048
#: White space to the tokenizer as well as to Python; splitting at fewer places is safe.
_RUN = re.compile(r"[^ \t\n\r]+")


@dataclass(frozen=True)
class Chunk:
    """The encoding of text[begin:end]: where its tokens start in the text."""

    begin: int
    end: int
    starts: list[int]

    def index(self, at: int) -> int:
        """Tokens before place ``at``."""
        return bisect_left(self.starts, at)

    def between(self, a: int, b: int) -> list[int]:
        return self.starts[self.index(a) : self.index(b)]


class ChunkEncoder:
    """Token counts of short texts, and encodings of chunks."""

    def __init__(self, path: str):
        self.cache = tokens.count_cache(path)
        self.tokenizer = self.cache.tokenizer

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text: each run of non-space characters is encoded by the library once."""
        cut = [_RUN.findall(text) if "\t" in text or "\r" in text else text.replace("\n", " ").split(" ") for text in texts]
        return self.cache.folded(cut, sum)

    def chunk(self, text: str, begin: int, end: int) -> Chunk:
        found = self.tokenizer.encode(text[begin:end], add_special_tokens=False)
        return Chunk(begin, end, [begin + at for at, _ in found.offsets])


def common_boundary(left: Chunk, right: Chunk, text: str, after: int) -> int | None:
    """The last stable place beyond ``after`` in the overlap of two chunks, None if there is none."""
    # the first run may be the rest of a cut one and the last run may go on: neither is used
    runs = list(_RUN.finditer(text, right.begin, left.end))
    for k in range(len(runs) - 2, 1, -1):
        at, before = runs[k].start(), runs[k - 1].start()
        if at <= after:
            return None
        ours, theirs = left.between(before, at + 1), right.between(before, at + 1)
        if ours == theirs and ours and ours[-1] == at:
            return at
    return None


def count_chunks(encoder: ChunkEncoder, text: str, chunk: int, overlap: int) -> tuple[int, int]:
    """Tokens of a text and the number of chunks that they come from."""
    left, cut, total, used = encoder.chunk(text, 0, min(chunk, len(text))), 0, 0, 1
    while left.end < len(text):
        width, at = overlap, None
        while at is None and width < left.end - cut:
            begin = left.end - width
            right = encoder.chunk(text, begin, min(len(text), max(begin + chunk, left.end + overlap)))
            at = common_boundary(left, right, text, cut)
            width *= 2
        if at is None:  # the rest from the last cut on, in a longer chunk
            left = encoder.chunk(text, cut, min(len(text), left.end + chunk + width))
            continue
        total += left.index(at) - left.index(cut)
        left, cut, used = right, at, used + 1
    return total + len(left.starts) - left.index(cut), used


def count_tokens(
    docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path or tokens.published(VOCABULARY))
        for batch in batches:
            texts = [raw.decode("utf-8", "replace") for raw in shared.texts_of(batch, "text")]
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            short = iter(encoder.counts([text for text in texts if len(text) <= chunk]))
            found = [(next(short), 1) if len(text) <= chunk else count_chunks(encoder, text, chunk, overlap) for text in texts]
            counts, chunks = [n for n, _ in found], [k for _, k in found]
            columns = [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_()), pa.array(chunks, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks"])

    return shared.id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(shared.table(spark, sf_dir, "documents"))
