"""Files read in byte ranges: digests of chunks, files and folders, whatever their size.

``ByteRanges`` is a Spark data source: it lists a folder, deals ranges of at most ``chunk`` bytes out to partitions, and gives the SHA-256
of each range; a range is read in small pieces, so no task holds more than one of them. A file's digest is that of its chunk digests in order, a
folder's an order-free sum over paths and file digests, so it depends neither on the listing's order nor on the number of partitions.

Paths are opened by Arrow's file systems (local or mounted folders, hdfs, s3, gs), on every machine.
"""

from __future__ import annotations

import fnmatch
import hashlib
import posixpath
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length long, start long, size long, digest string"
#: Bytes of a range, of a piece that is held at once, and most partitions.
CHUNK, PIECE, PARTITIONS = 64 << 20, 1 << 20, 4096


def opened(uri: str):
    """Arrow's file system and the path in it."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri.replace("file:///", "file:/", 1).replace("file:/", "file:///", 1) if uri.startswith("file:") else uri)
    return fs.LocalFileSystem(), uri


class Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        super().__init__(None)
        self.ranges = ranges


class ByteRangesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.excluded = [name for name in options.get("exclude", "").split(",") if name]
        self.chunk = int(options.get("chunk", CHUNK))

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        store, root = opened(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        ranges = []
        for info in sorted(found, key=lambda x: x.path):
            name = posixpath.basename(info.path)
            if info.type == fs.FileType.File and fnmatch.fnmatch(name, self.pattern) and name not in self.excluded:
                path = posixpath.relpath(info.path, root)
                ranges += [(path, info.size, start, min(self.chunk, info.size - start)) for start in range(0, max(info.size, 1), self.chunk)]
        n = max(1, min(PARTITIONS, len(ranges)))  # a scan has one partition at least
        return [Ranges(ranges[k::n]) for k in range(n)]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        store, root = opened(self.path)
        for path, length, start, size in partition.ranges:
            found, left = hashlib.sha256(), size
            with store.open_input_file(posixpath.join(root, path)) as file:
                file.seek(start)
                while left and (piece := file.read(min(PIECE, left))):
                    found.update(piece)
                    left -= len(piece)
            if left:
                raise OSError(f"{path}: {left} bytes short of {length}")
            yield path, length, start, size, found.hexdigest()


class ByteRanges(DataSource):
    """Options: path; pattern of file names; exclude, names left out; chunk, bytes of a range."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return ByteRangesReader(dict(self.options))


def chunk_digests(spark: SparkSession, path: str, pattern: str = "*", exclude: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """SCHEMA: a row for each range of each file below ``path`` (paths are relative to it); an empty file has one range of no bytes."""
    spark.dataSource.register(ByteRanges)
    return spark.read.format("byte_ranges").option("pattern", pattern).option("exclude", ",".join(exclude)).option("chunk", chunk).load(path)


def file_digests(chunks: DataFrame) -> DataFrame:
    """path, length, n_chunks, digest of each file."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start", "digest"))), lambda x: x["digest"])  # 64 bytes a chunk
    return chunks.groupBy("path").agg(F.first("length").alias("length"), F.count("*").alias("n_chunks"), F.sha2(F.array_join(ordered, ""), 256).alias("digest"))


def tree_digest(files: DataFrame) -> DataFrame:
    """One row n, length, digest of a folder: four sums of 60 bits over SHA-256 of each path and its digest."""
    entry = F.sha2(F.concat_ws("\n", "path", "digest"), 256)
    limbs = [F.coalesce(F.sum(F.conv(F.substring(entry, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")) for k in range(4)]
    return files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"), F.sha2(F.concat_ws(",", *[x.cast("string") for x in limbs]), 256).alias("digest"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, start, status of chunks (as from ``chunk_digests``) that are not the same: changed, added or removed."""
    key = ["path", "start"]
    both = before.select(*key, F.col("digest").alias("_b")).join(after.select(*key, F.col("digest").alias("_a")), key, "full_outer")
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("changed")
    return both.where("_a IS DISTINCT FROM _b").select(*key, status.alias("status"))
