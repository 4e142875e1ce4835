"""Digests of files and folders by byte ranges."""

from __future__ import annotations

import hashlib
import os
import random

import pytest
from lethe.sources import byte_ranges


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(3)
    path = tmp_path / "model"
    (path / "deep" / "er").mkdir(parents=True)
    for name, size in [("large.bin", 100_001), ("exact.bin", 30_000), ("empty.bin", 0), ("deep/er/small.json", 7), ("meta.json", 11)]:
        (path / name).write_bytes(rng.randbytes(size))
    return path


def digests(spark, folder, **options):
    chunks = byte_ranges.chunk_digests(spark, str(folder), chunk=10_000, **options)
    return chunks, {r.path: r for r in byte_ranges.file_digests(chunks).collect()}


def test_chunks_and_files(spark, folder):
    chunks, files = digests(spark, folder)
    assert {p: (r.length, r.n_chunks) for p, r in files.items()} == {"large.bin": (100_001, 11), "exact.bin": (30_000, 3), "empty.bin": (0, 1), "deep/er/small.json": (7, 1), "meta.json": (11, 1)}
    content = (folder / "large.bin").read_bytes()
    parts = [hashlib.sha256(content[k : k + 10_000]).hexdigest() for k in range(0, len(content), 10_000)]
    assert [r.digest for r in chunks.where("path = 'large.bin'").orderBy("start").collect()] == parts
    assert files["large.bin"].digest == hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(spark, folder, **options):
    return byte_ranges.tree_digest(byte_ranges.file_digests(byte_ranges.chunk_digests(spark, str(folder), chunk=10_000, **options))).first()


def test_one_changed_byte_is_found(spark, folder):
    before, _ = digests(spark, folder)
    before, whole = spark.createDataFrame(before.collect(), before.schema), tree(spark, folder)
    with open(folder / "large.bin", "r+b") as file:
        file.seek(54_321)
        byte = file.read(1)
        file.seek(54_321)
        file.write(bytes([byte[0] ^ 1]))
    after, _ = digests(spark, folder)
    assert [tuple(r) for r in byte_ranges.changed(before, after).collect()] == [("large.bin", 50_000, "changed")]
    assert tree(spark, folder).digest != whole.digest and tree(spark, folder).length == whole.length


def test_names_count_and_order_does_not(spark, folder, tmp_path):
    whole = tree(spark, folder)
    other = tmp_path / "copy"
    (other / "deep" / "er").mkdir(parents=True)
    for name in ["meta.json", "deep/er/small.json", "exact.bin", "empty.bin", "large.bin"]:
        (other / name).write_bytes((folder / name).read_bytes())
    assert tree(spark, other) == whole and whole.n == 5
    os.rename(other / "empty.bin", other / "void.bin")
    assert tree(spark, other).digest != whole.digest
    assert sorted((r.path, r.status) for r in byte_ranges.changed(byte_ranges.chunk_digests(spark, str(folder)), byte_ranges.chunk_digests(spark, f"file://{other}")).collect()) == [("empty.bin", "removed"), ("void.bin", "added")]


def test_patterns(spark, folder):
    assert set(digests(spark, folder, pattern="*.json")[1]) == {"meta.json", "deep/er/small.json"}
    assert set(digests(spark, folder, pattern="*.json", exclude=["meta.json"])[1]) == {"deep/er/small.json"}
    (folder / "none").mkdir()
    found = tree(spark, folder / "none")
    assert (found.n, found.length) == (0, 0)
