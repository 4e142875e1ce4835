"""Operator 5: token-id files with one zstandard dictionary.

Layout of a shard (all integers little-endian):
  4 bytes magic ``LTOK``, u16 version, u16 bytes per id (2 or 4), u32 number of documents, 32 bytes SHA-256 of the dictionary,
  an index of one entry per document (i64 id or NULL_ID, u64 offset of the frame, u32 frame bytes, u64 number of ids),
  then one zstandard frame per document over its ids. A single document is read by its index entry alone.

A folder of token files holds ``shards`` (a Parquet table, a shard a row, see SHARDS) and ``meta`` (one row: version, bytes per id,
end id, vocabulary file and the dictionary itself); ``open_files`` reads it in any session.

The dictionary is trained on the serialized id arrays of a bounded sample: the SAMPLE_DOCS documents with the smallest
id hashes, SAMPLE_IDS ids of each at most. All documents are range-partitioned by id and sorted; each task encodes,
compresses and packs shards of about ``shard_bytes``, and Spark's Parquet writer commits the shards (a lost
executor's shards are written again, never twice). Reading yields, for each document, what stands in the file.

Null text: no ids but the end id. A null id sorts first. Rows that repeat an id all stay, ordered by their texts.
An empty table gives no shard. Only the two named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, tokens

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
MAGIC, VERSION, NULL_ID = b"LTOK", 1, -(2**63)
HEAD, ENTRY = struct.Struct("<4sHHI32s"), struct.Struct("<qQIQ")
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 512, 4096, 1 << 16
SHARD_BYTES, LEVEL = 1 << 22, 1
SHARDS = "part int, seq int, first_id long, last_id long, n_docs int, n_ids long, ids_before long, shard binary"
#: Texts, and characters of texts, that are encoded together.
BATCH_ROWS, BATCH_CHARS = 256, 1 << 20


def encoded(rows: Iterator[tuple[int | None, str]], path: str, width: int, end_id: int) -> Iterator[tuple[int | None, bytes]]:
    """Ids of whole texts with the end id, ``width`` bytes each, a batch of texts at a time."""
    end, held, size = end_id.to_bytes(width, "little"), [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if len(held) == BATCH_ROWS or size >= BATCH_CHARS:
            yield from zip([i for i, _ in held], [x + end for x in tokens.encode([t for _, t in held], path, width)])
            held, size = [], 0
    if held:
        yield from zip([i for i, _ in held], [x + end for x in tokens.encode([t for _, t in held], path, width)])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str]]:
    for batch in batches:
        yield from zip(batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), "").to_pylist())


def train_dictionary(docs: DataFrame, path: str, width: int, end_id: int) -> bytes:
    """A dictionary from a bounded sample, b"" if the sample is too small to train on."""
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, found in encoded(rows_of(batches), path, width, end_id):
            yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([found[: width * SAMPLE_IDS]], pa.binary())], ["doc_id", "ids"])

    sample = docs.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(run, "doc_id long, ids binary")
    found = [bytes(row.ids) for row in sample.orderBy("doc_id", "ids").limit(2 * SAMPLE_DOCS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, found).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_of(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def pack(entries: list[tuple[int | None, bytes, int]], width: int, digest: bytes) -> bytes:
    """A shard of (id, frame, number of ids)."""
    at, index = HEAD.size + ENTRY.size * len(entries), []
    for doc_id, frame, n in entries:
        index.append(ENTRY.pack(NULL_ID if doc_id is None else doc_id, at, len(frame), n))
        at += len(frame)
    return b"".join([HEAD.pack(MAGIC, VERSION, width, len(entries), digest), *index, *[frame for _, frame, _ in entries]])


def unpack(shard: bytes, raw_dictionary: bytes, only: int | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, ids as u32) of each document, or of document ``only``."""
    magic, version, width, n, digest = HEAD.unpack_from(shard)
    if (magic, version) != (MAGIC, VERSION) or digest != hashlib.sha256(raw_dictionary).digest():
        raise ValueError("not a token shard of this version and dictionary")
    reader = zstandard.ZstdDecompressor(dict_data=dictionary_of(raw_dictionary))
    for k in range(n):
        doc_id, at, size, count = ENTRY.unpack_from(shard, HEAD.size + ENTRY.size * k)
        if only is not None and doc_id != only:
            continue
        ids = np.frombuffer(reader.decompress(shard[at : at + size]), f"<u{width}").astype("<u4")
        if len(ids) != count:
            raise ValueError(f"document {doc_id}: {len(ids)} ids, the index says {count}")
        yield None if doc_id == NULL_ID else doc_id, ids


META = "version int, width int, end_id int, vocabulary string, sha256 string, dictionary binary"


@dataclass(frozen=True)
class TokenFiles:
    """Token files in a folder: shards as written (see SHARDS) and the dictionary that they name by hash."""

    path: str
    shards: DataFrame
    dictionary: bytes

    def digests(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
        raw = self.dictionary

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, before, shard in zip(batch.column("part").to_pylist(), batch.column("ids_before").to_pylist(), batch.column("shard")):
                    rows = []
                    for doc_id, ids in unpack(shard.as_py(), raw):
                        rows.append((part, doc_id, before, len(ids), zlib.crc32(ids)))
                        before += len(ids)
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32()] + [pa.int64()] * 4)]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "inside", "n_tokens", "ids_crc32"])

        found = self.shards.select("part", "ids_before", "shard").mapInArrow(run, "part int, doc_id long, inside long, n_tokens long, ids_crc32 long")
        # one row per written partition
        sizes = self.shards.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
        starts = sizes.selectExpr("part", "sum(n_ids) OVER (ORDER BY part) - n_ids AS before")
        return found.join(starts, "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")

    def document(self, doc_id: int) -> list[list[int]]:
        """The ids of one document (a list for each row that holds it), by the index entries alone."""
        near = self.shards.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).select("shard")
        return [ids.tolist() for row in near.toLocalIterator() for _, ids in unpack(bytes(row.shard), self.dictionary, doc_id)]


def open_files(spark: SparkSession, folder: str) -> TokenFiles:
    """Token files that ``write_tokens`` has left in ``folder``."""
    meta = spark.read.schema(META).parquet(f"{folder}/meta").first()
    if meta is None or meta.version != VERSION or hashlib.sha256(bytes(meta.dictionary)).hexdigest() != meta.sha256:
        raise ValueError(f"{folder}: no token files of this version")
    return TokenFiles(folder, spark.read.schema(SHARDS).parquet(f"{folder}/shards"), bytes(meta.dictionary))


def write_tokens(
    docs: DataFrame,
    path: str | None = None,
    end_id: int = END_ID,
    shard_bytes: int = SHARD_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str | None = None,
) -> TokenFiles:
    """Encode ``docs`` and write token files in ascending id order into ``folder`` (a new one in the shared folder if not given).

    path: the vocabulary file, on every machine. Files that stand in ``folder`` are replaced.
    """
    path, folder = path or tokens.published(VOCABULARY), folder or shared.new_folder(docs.sparkSession, "tokens")
    docs = shared.id_and_text(docs, id_col, text_col)
    width = 2 if max(tokens.load(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    raw = train_dictionary(docs, path, width, end_id)
    digest = hashlib.sha256(raw).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary_of(raw))
        part, seq, total, held, size, count = TaskContext.get().partitionId(), 0, 0, [], 0, 0

        def full() -> pa.RecordBatch:
            ids = [i for i, _, _ in held if i is not None]
            row = [part, seq, min(ids, default=None), max(ids, default=None), len(held), count, total, pack(held, width, digest)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            names = ["part", "seq", "first_id", "last_id", "n_docs", "n_ids", "ids_before", "shard"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for doc_id, ids in encoded(rows_of(batches), path, width, end_id):
            frame = writer.compress(ids)
            held.append((doc_id, frame, len(ids) // width))
            size += len(frame)
            count += len(ids) // width
            if size >= shard_bytes:
                yield full()
                seq, total, held, size, count = seq + 1, total + count, [], 0, 0
        if held:
            yield full()

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SHARDS).write.mode("overwrite").parquet(f"{folder}/shards")
    spark = docs.sparkSession
    meta = [(VERSION, width, end_id, path.rsplit("/", 1)[-1], digest.hex(), bytearray(raw))]
    spark.createDataFrame(meta, META).coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")
    return open_files(spark, folder)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_tokens(shared.table(spark, sf_dir, "documents")).digests()
