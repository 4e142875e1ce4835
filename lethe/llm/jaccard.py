"""Operator 10: n-gram Jaccard join with PartEnum signatures (Arasu et al., 2006), and its components.

Sets are the distinct 5-word shingles of a text. Documents of one set are one class (named by a 64-bit hash of the set; sets
that a second hash tells apart take that one as their name), so copies never pair. Sizes fall into bands whose ends are
1/threshold apart; a set takes part in the instances of its own and the next band. Linked sets differ in at most
d = (|A| + |B|)(1 - t)/(1 + t) shingles. An instance cuts the hash domain into n1 groups and each group into n2 cells; with n1 >
d/2 groups, linked sets differ by at most one shingle in some group, and so agree on all but one of its cells. The signatures
of a group are hashes of each subset of n2 - 1 cells, with their whole content.

A set bounds d by its own size and the largest partner in the instance, so it signs only as many groups as it needs. Subsets
without a telling shingle are left out: shingles in MANY classes of a sample of SAMPLE documents are frequent, all others tell.
A group is rich if all its subsets tell. A set signs the telling subsets of its leading groups up to the (d/2 + 1)-th rich one.
Of these rich ones linked sets agree on one, and the set that stops first has it within the leading groups of both. A
set with fewer rich groups signs all subsets of all groups. So no link is lost, whatever counts as frequent, and passages that many
documents share do not bring these together.

Classes that share a signature meet: all pairs in a bucket of up to SMALL classes, in a larger one each with the
least (round 1). Candidates are checked: sizes, then parity bitmaps (a lower bound of the difference, exact to
reject), then the sets themselves (round 1). Classes that links or large buckets tie together are a family: no link leaves
one. All pairs of a family meet again (round 2), two of its parts in a task, by size, bitmap and sets inside the task, and only links between
different components and each class's number of links leave it. Without ``count_links`` only pairs of different components
meet in round 2, and families of one component stay out of it.

A class that has no words links with nothing; neither does a null text. A null id keeps its row and never becomes a
component's name unless all its ids are null. Rows that repeat an id are nodes of their own sets. No cap on partners. An empty
table gives no row. Only the two named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.operators.graph import connected_components

from . import shared
from .kernels import MULTIPLIER, mixed, shingles, starts

#: Similarity as a fraction of whole numbers, so that the bound is exact.
NUMERATOR, DENOMINATOR = 80, 100
BITS = 512
#: Rows of signatures that a task gathers before it hands them on.
FLUSH = 1 << 18
EMPTY = np.uint64(0x5851F42D4C957F2D)
#: Documents that are looked at for frequent shingles, and the classes of them that make a shingle frequent.
SAMPLE, MANY = 4000, 4
#: Classes of a bucket that all meet.
SMALL = 8
#: Classes that are compared with as many others at once, shingles that go into one product, and pairs up to which none is made.
SIDE, COLUMNS, FEW = 256, 4096, 64
#: A family is split into parts of PART classes, up to PARTS of them; then parts grow to 16 times that, or PART_SHINGLES, and no further.
PART, PARTS, PART_SHINGLES = 256, 16, 1 << 21
DOUBTFUL = 1000


class Bands:
    """Size bands [low, high] with high = low / threshold, made as sizes ask for them."""

    def __init__(self, numerator: int, denominator: int):
        self.num, self.den = numerator, denominator
        self.high = [1 * denominator // numerator]

    def of(self, size: int) -> int:
        while self.high[-1] < size:
            self.high.append((self.high[-1] + 1) * self.den // self.num)
        return int(np.searchsorted(self.high, size))

    def top(self, band: int) -> int:
        """The largest size of a band."""
        while len(self.high) <= band:
            self.high.append((self.high[-1] + 1) * self.den // self.num)
        return self.high[band]

    def apart(self, one: int, other: int) -> int:
        """Shingles in which linked sets of these sizes differ at most."""
        return (one + other) * (self.den - self.num) // (self.den + self.num)

    def instance(self, band: int) -> tuple[int, int]:
        """Groups and cells a group of the instance that pairs this band with itself and the one below."""
        bad = self.apart(self.top(band), self.top(band)) // 2
        cells = 8 if bad == 0 else 5 if bad < 3 else 3  # small sets take more cells: one then seldom holds all of a group
        return bad + 1 + bad // 6, cells

    def needed(self, size: int, band: int) -> int:
        """Rich groups that a set of this size signs in the instance; 0 if it can have no partner but its equals."""
        largest = min(self.top(band), size * self.den // self.num)
        if largest <= (self.top(band - 1) if band > self.of(size) else 0):
            return 0
        apart = self.apart(size, largest)
        return apart // 2 + 1 if apart else 0


class Frequent:
    """A set of shingle hashes of bounded size."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def holds(self, found: np.ndarray) -> np.ndarray:
        out = self.table[(found & np.uint64((1 << 20) - 1)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.hashes, found[maybe]), len(self.hashes) - 1)
            out[maybe] = self.hashes[at] == found[maybe]
        return out


def class_of(found: np.ndarray) -> int:
    """The name of a set."""
    with np.errstate(over="ignore"):
        return int(mixed(mixed(found ^ MULTIPLIER).sum(keepdims=True) + np.uint64(len(found))).view(np.int64)[0])


def other_name(found: np.ndarray) -> int:
    """A second, independent name."""
    with np.errstate(over="ignore"):
        return int(mixed(mixed(found + EMPTY).sum(keepdims=True) * MULTIPLIER + np.uint64(len(found))).view(np.int64)[0])


def namer(doubtful: frozenset[int]) -> Callable[[np.ndarray], int]:
    """Gives a set's name, its second one if other sets bear the first as well."""

    def named(found: np.ndarray) -> int:
        name = class_of(found)
        return other_name(found) if name in doubtful else name

    return named


def parity(found: np.ndarray) -> bytes:
    """Bit b is set if an odd number of shingles falls on it; two bitmaps differ in no more bits than the sets in shingles."""
    return np.packbits(np.bincount((found & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).tobytes()


def signatures(found: np.ndarray, bands: Bands, frequent: Frequent) -> np.ndarray:
    """Signatures of a set (sorted distinct hashes) in both of its instances."""
    out = [np.empty(0, np.uint64)]
    with np.errstate(over="ignore"):
        inner, high, telling = mixed(found + EMPTY), found >> np.uint64(32), ~frequent.holds(found)
        band = bands.of(len(found))
        for name in (band, band + 1):
            needed = bands.needed(len(found), name)
            if not needed:
                continue
            n1, n2 = bands.instance(name)
            cell = ((high * np.uint64(n1 * n2)) >> np.uint64(32)).astype(np.int64)
            first = starts(cell)
            sums = np.zeros(n1 * n2, np.uint64)
            sums[cell[first]] = np.add.reduceat(inner, first)
            sums, tells = sums.reshape(n1, n2), np.bincount(cell[telling], minlength=n1 * n2).reshape(n1, n2)
            rest = sums.sum(1, keepdims=True) - sums  # of all cells but one
            tag = mixed(np.arange(1, n1 * n2 + 1, dtype=np.uint64) * MULTIPLIER + np.uint64(name)).reshape(n1, n2)
            signed = mixed(rest + tag)
            some = tells.sum(1, keepdims=True) > tells
            rich = np.cumsum(some.all(1))
            if rich[-1] >= needed:
                leading = int(np.searchsorted(rich, needed)) + 1
                out.append(signed[:leading][some[:leading]])
            else:
                out.append(signed.ravel())
    return np.concatenate(out)


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, class and other (its names; null without words), bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text, width) for text in shared.texts_of(batch, "text")]
            columns = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([other_name(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([parity(s) if len(s) else None for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_shingles", "class", "other", "bits"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, class long, other long, bits binary")


def told_apart(profile: DataFrame) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """profile with a class for each set, classes (class, n_shingles, bits, holder), and the names that several sets bear.

    Of 10 billion sets a few share a 64-bit name; over DOUBTFUL such names would mean that the hash is broken.
    """

    def grouped(rows: DataFrame) -> DataFrame:
        found = rows.where("class IS NOT NULL").groupBy("class").agg(
            F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"), F.min("doc_id").alias("holder"), (F.min("other") != F.max("other")).alias("several")
        )
        return shared.staged(found, "classes")

    classes = grouped(profile)
    doubtful = frozenset(row["class"] for row in classes.where("several").select("class").limit(DOUBTFUL + 1).collect())
    if len(doubtful) > DOUBTFUL:
        raise ValueError("too many sets share a name")
    if doubtful:
        profile = profile.withColumn("class", F.when(F.col("class").isin(list(doubtful)), F.col("other")).otherwise(F.col("class")))
        classes = grouped(profile)
    return profile, classes.drop("several"), doubtful


def frequent_shingles(docs: DataFrame, profile: DataFrame, width: int) -> Frequent:
    """Shingles in MANY classes or more of SAMPLE documents, those with the smallest id hashes: SAMPLE / MANY sets' worth at most."""
    ids = profile.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in shared.texts_of(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, width).view(np.int64))], ["shingle"])

    sample = shared.by_ids(docs, shared.staged(ids.where("doc_id IS NOT NULL"), "sample"), "left_semi").mapInArrow(run, "shingle long")
    found = sample.groupBy("shingle").count().where(F.col("count") >= MANY).select("shingle")
    return Frequent(np.array([row.shingle for row in found.toLocalIterator()], np.int64).view(np.uint64))


def runs_of(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = starts(sig)
    return first, np.diff(first, append=len(sig))


def signature_rows(docs: DataFrame, width: int, num: int, den: int, frequent: Frequent, doubtful: frozenset[int]) -> DataFrame:
    """signature, a, b. b null: class a has the signature; b = a: more than SMALL classes of the task have it and a is the
    least. Else a link to check between the least class a and b, under a key of its own."""
    named = namer(doubtful)

    def combine(sig: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((cls, sig))
        sig, cls = sig[order], cls[order]
        fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])))
        sig, cls = sig[fresh], cls[fresh]
        first, size = runs_of(sig)
        large = size > SMALL
        member = np.repeat(large, size)
        member[first] = False
        a, b = np.repeat(cls[first], size)[member], cls[member]
        pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
        with np.errstate(over="ignore"):
            key = mixed(mixed(pairs[:, 0].astype(np.uint64)) + pairs[:, 1].astype(np.uint64)).view(np.int64)
        marked = np.zeros(len(sig), bool)
        marked[first[large]] = True
        kept = pa.array(cls[~member], pa.int64(), mask=~marked[~member])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([sig[~member], key])),
                pa.array(np.concatenate([cls[~member], pairs[:, 0]])),
                pa.concat_arrays([kept, pa.array(np.ascontiguousarray(pairs[:, 1]), pa.int64())]),
            ],
            ["signature", "a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, sigs, classes, held = Bands(num, den), [], [], 0
        for batch in batches:
            for text in shared.texts_of(batch, "text"):
                found = shingles(text, width)
                if len(found):
                    sigs.append(signatures(found, bands, frequent).view(np.int64))
                    classes.append(np.full(len(sigs[-1]), named(found), np.int64))
                    held += len(sigs[-1])
                if held >= FLUSH:
                    yield combine(np.concatenate(sigs), np.concatenate(classes))
                    sigs, classes, held = [], [], 0
        if held:
            yield combine(np.concatenate(sigs), np.concatenate(classes))

    return docs.mapInArrow(run, "signature long, a long, b long")


def met(sig: np.ndarray, a: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, ...]:
    """a, b, again of the pairs to check in buckets of rows sorted by signature and class. several: the row stands for more."""
    first, size = runs_of(sig)
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    many = (np.add.reduceat(several.astype(np.int64), first) > 0) | (size > SMALL)
    large = np.repeat(many, size)
    least = np.repeat(a[first], size)
    found = [(least[large], a[large], np.ones(large.sum(), bool))]
    left = np.repeat(first + size, size) - np.arange(len(sig)) - 1  # rows of the bucket after this one
    for step in range(1, SMALL):
        here = np.flatnonzero(~large & (left >= step))
        found.append((a[here], a[here + step], np.zeros(len(here), bool)))
    one, two, again = (np.concatenate(c) for c in zip(*found))
    keep = one != two
    return np.minimum(one, two)[keep], np.maximum(one, two)[keep], again[keep]


def candidate_pairs(rows: DataFrame) -> DataFrame:
    """a, b, again: pairs to check; again: from a large bucket, where not all pairs have met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, a, several = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        for batch in batches:
            new_sig, new_a = batch.column("signature").to_numpy(), batch.column("a").to_numpy()
            known = ~batch.column("b").is_null().to_numpy(zero_copy_only=False)
            new_b = pc.fill_null(batch.column("b"), 0).to_numpy()
            link = known & (new_b != new_a)
            found = [(new_a[link], new_b[link], np.ones(link.sum(), bool))]
            sig = np.concatenate([sig, new_sig[~link]])
            a = np.concatenate([a, new_a[~link]])
            several = np.concatenate([several, known[~link]])
            if len(sig):
                last = starts(sig)[-1]
                if len(sig) - last > SMALL:  # what a large bucket still needs to know is its least class
                    found.append(met(sig, a, several))
                    sig, a, several = sig[last : last + 1], a[last : last + 1], np.ones(1, bool)
                else:
                    found.append(met(sig[:last], a[:last], several[:last]))
                    sig, a, several = sig[last:], a[last:], several[last:]
            yield as_batch(found)
        yield as_batch([met(sig, a, several)])

    def as_batch(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, b, again = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((~again, b, a))
        a, b, again = a[order], b[order], again[order]
        fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.empty(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(a[fresh]), pa.array(b[fresh]), pa.array(again[fresh])], ["a", "b", "again"])

    ordered = rows.repartition("signature").sortWithinPartitions("signature", "a")
    return ordered.mapInArrow(run, "a long, b long, again boolean").groupBy("a", "b").agg(F.max("again").alias("again"))


def class_sets(docs: DataFrame, ids: DataFrame, width: int, doubtful: frozenset[int]) -> DataFrame:
    """class, shingles of the documents in ``ids``."""
    named = namer(doubtful)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(text, width) for text in shared.texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([named(s) if len(s) else None for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["class", "shingles"])

    return shared.staged(shared.by_ids(docs, ids, "left_semi").mapInArrow(run, "class long, shingles binary").where("class IS NOT NULL").dropDuplicates(["class"]), "sets")


def checked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, num: int, den: int, doubtful: frozenset[int]) -> DataFrame:
    """a, b of ``pairs`` whose sets reach the threshold. classes: class, n_shingles, bits, holder."""
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("class").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"), F.col("holder").alias(f"holder_{side}")), side)
    sized = pairs.where(f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(f"bits_{s}").to_pylist()), np.uint64).reshape(batch.num_rows, -1) for s in "ab")
                differ = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
                bound = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()) * (den - num) // (den + num)
                yield batch.select(["a", "b", "holder_a", "holder_b"]).filter(pa.array(differ <= bound))

    likely = shared.staged(sized.mapInArrow(near, "a long, b long, holder_a long, holder_b long"), "pairs")
    ids = shared.staged(likely.select(F.col("holder_a").alias("doc_id")).union(likely.select("holder_b")).distinct(), "ids")

    sets = class_sets(docs, ids, width, doubtful)
    both = likely.select("a", "b")
    for side in ("b", "a"):
        both = both.join(sets.select(F.col("class").alias(side), F.col("shingles").alias(f"set_{side}")), side)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(linked, "a long, b long")


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``x`` shares with each set of ``y``: a matrix product over the shingles that both sides hold."""
    both = np.intersect1d(np.unique(np.concatenate(x)), np.unique(np.concatenate(y)), assume_unique=True)
    out = np.zeros((len(x), len(y)), np.int64)
    if not len(both):
        return out

    def placed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, found), len(both) - 1)
        here = both[at] == found
        return row[here], at[here]

    sides = [(len(x), *placed(x)), (len(y), *placed(y))]
    for low in range(0, len(both), COLUMNS):
        parts = []
        for n, row, at in sides:
            inside = (at >= low) & (at < low + COLUMNS)
            part = np.zeros((n, min(COLUMNS, len(both) - low)), np.float32)
            part[row[inside], at[inside] - low] = 1
            parts.append(part)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def linked_pairs(x: np.ndarray, y: np.ndarray, n: np.ndarray, bits: np.ndarray, sets: list[np.ndarray], num: int, den: int, apart: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The linked ones of all pairs of rows ``x`` and ``y``; of x and x each pair once. apart: only pairs that differ in it."""
    one, two = n[x][:, None], n[y][None, :]
    maybe = den * np.minimum(one, two) >= num * np.maximum(one, two)
    if apart is not None:
        maybe &= apart[x][:, None] != apart[y][None, :]
    if x is y:
        maybe = np.triu(maybe, 1)
    if maybe.any():
        maybe &= np.bitwise_count(bits[x][:, None] ^ bits[y][None, :]).sum(2, dtype=np.int64) <= (one + two) * (den - num) // (den + num)
    i, k = np.nonzero(maybe)
    if len(i) > FEW:
        common = common_counts([sets[r] for r in x], [sets[r] for r in y])[i, k]
    else:
        common = np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(x[i], y[k])], np.int64)
    i, k = x[i], y[k]
    keep = den * common >= num * (n[i] + n[k] - common)
    return i[keep], k[keep]


def dealt(about: DataFrame) -> DataFrame:
    """``about`` with family, low, high, mine: each pair of classes of a family meets under one (family, low, high).

    mine: the part that the class is in; low < high asks for the pairs between two parts, low = high for those in one.
    """
    size = about.groupBy("family").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("held"))
    few = F.least(F.ceil(F.col("size") / PART), F.lit(PARTS))
    size = size.select("family", F.greatest(few, F.ceil(F.col("size") / (16 * PART)), F.ceil(F.col("held") / PART_SHINGLES)).cast("int").alias("parts"))
    split = about.join(size, "family").withColumn("mine", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return split.select("*", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high")).drop("parts", "other")


def family_links(about: DataFrame, sets: DataFrame, num: int, den: int, count_links: bool) -> DataFrame:
    """a, b: links that join the components of all classes of a family, by name of their present ones; b null: class a has n links.

    about: class, n_shingles, bits, root, family. A class has a count for each of the parts that it meets.
    """

    def resolve(tile: pa.Table) -> pa.RecordBatch:
        cls, n, root, low, high, mine = (tile.column(c).to_numpy() for c in ("class", "n_shingles", "root", "low", "high", "mine"))
        bits = np.frombuffer(b"".join(tile.column("bits").to_pylist()), np.uint64).reshape(len(n), -1)
        sets = [np.frombuffer(value.as_buffer(), np.uint64) for value in tile.column("shingles")]
        sides = [[rows[k : k + SIDE] for k in range(0, len(rows), SIDE)] for rows in (np.flatnonzero(mine == low), np.flatnonzero(mine == high))]
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        edges, n_links = [], np.zeros(len(n), np.int64)
        for at, x in enumerate(sides[0]):
            for y in sides[0][at:] if low[0] == high[0] else sides[1]:
                i, k = linked_pairs(x, y, n, bits, sets, num, den, None if count_links else root)
                n_links += np.bincount(np.concatenate([i, k]), minlength=len(n))
                apart = root[i] != root[k]
                for p, q in np.unique(np.stack([root[i], root[k]], 1)[apart], axis=0).tolist():
                    if top(p) != top(q):
                        parent[top(p)] = top(q)
                        edges.append((p, q))
        some, none = np.flatnonzero(n_links), pa.nulls(len(edges), pa.int64())
        columns = [
            pa.concat_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array(cls[some])]),
            pa.concat_arrays([pa.array([b for _, b in edges], pa.int64()), pa.nulls(len(some), pa.int64())]),
            pa.concat_arrays([none, pa.array(n_links[some])]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key: tuple | None = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("family", "low", "high")], 1)
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]).any(1))))
            for s, e in zip(first, np.append(first[1:], len(keys))):
                if held and tuple(keys[s]) != key:
                    yield resolve(pa.Table.from_batches(held))
                    held = []
                key = tuple(keys[s])
                held.append(batch.slice(s, e - s))
        if held:
            yield resolve(pa.Table.from_batches(held))

    rows = dealt(about).join(sets, "class").repartition("family", "low", "high").sortWithinPartitions("family", "low", "high", "n_shingles")
    return rows.mapInArrow(run, "a long, b long, n long")


def components_of(edges: DataFrame, node: str, root: str) -> DataFrame:
    """The least node of the component of each node of an edge a, b."""
    return connected_components(edges, "a", "b").toDF(node, root)


def by_root(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges a, b between the components of their ends. roots: class, root; other classes are components of their own."""
    for side in ("a", "b"):
        edges = edges.join(roots.select(F.col("class").alias(side), "root"), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
    return edges.select("a", "b").where("a != b").distinct()


def jaccard_components(
    docs: DataFrame, width: int = 5, num: int = NUMERATOR, den: int = DENOMINATOR, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True
) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (least id with the same set) and n_links (links of its class to other classes; null if not counted)."""
    docs = shared.id_and_text(docs, id_col, text_col)
    profile, classes, doubtful = told_apart(shared.staged(profiles(docs, width), "profiles"))
    frequent = frequent_shingles(docs, profile, width)
    candidates = shared.staged(candidate_pairs(signature_rows(docs, width, num, den, frequent, doubtful)), "candidates")
    links = shared.staged(checked(candidates.select("a", "b"), classes, docs, width, num, den, doubtful), "links")
    ends = links.select(F.col("a").alias("class")).union(links.select("b")).groupBy("class").agg(F.count("*").alias("n_links"))
    again = candidates.where("again").select("a", "b")
    roots = shared.staged(components_of(links, "class", "root"), "roots")
    if not again.isEmpty():
        # every link that is not known yet lies in a family: what links and large buckets tie together
        families = components_of(by_root(again, roots), "root", "family")
        about = classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
        about = about.join(families, "root").select("class", "n_shingles", "bits", "holder", "family", "root")
        if not count_links:
            split = about.groupBy("family").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("family")
            about = about.join(split, "family", "left_semi")
        else:
            # a family of one component has links beyond those of the least as well
            alone = roots.select("root").distinct().join(families, "root", "left_anti").select("root", F.col("root").alias("family"))
            whole = classes.join(roots, "class").join(alone, "root").select("class", "n_shingles", "bits", "holder", "family", "root")
            about = about.union(whole)
        about = shared.staged(about, "families")
        sets = class_sets(docs, shared.staged(about.select(F.col("holder").alias("doc_id")).distinct(), "ids"), width, doubtful)
        found = shared.staged(family_links(about.drop("holder"), sets, num, den, count_links), "links")
        joined = components_of(found.where("b IS NOT NULL").select("a", "b"), "root", "top")
        every = classes.select("class").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
        roots = every.join(joined, "root", "left").select("class", F.coalesce("top", "root").alias("root"))
        ends = found.where("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n_links"))
    named = classes.select("class", "holder").join(roots, "class", "left").join(ends, "class", "left")
    named = named.select("class", "holder", F.coalesce("root", "class").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    least = named.groupBy("root").agg(F.min("holder").alias("component_id"))
    final = named.join(least, "root").select("class", "component_id", F.col("holder").alias("class_id"), "n_links")
    out = profile.select("doc_id", "n_shingles", "class").join(final, "class", "left")
    n_links = F.coalesce("n_links", F.lit(0)) if count_links else F.lit(None).cast("long")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"), n_links.alias("n_links"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(shared.table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op10_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
c AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, s, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY md5(array_to_string(list_sort(s), chr(10)))) END AS class_id FROM s),
x AS (SELECT class_id AS k, n, unnest(s) AS shingle FROM c WHERE doc_id = class_id),
p AS (SELECT a.k AS a, b.k AS b, a.n AS na, b.n AS nb, count(*) AS common FROM x a JOIN x b ON a.shingle = b.shingle AND a.k <> b.k GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * common >= 80 * (na + nb - common)),
r AS (SELECT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node), f AS (SELECT a AS node, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, n AS n_shingles, coalesce(component_id, class_id) AS component_id, class_id, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN m ON class_id = m.node LEFT JOIN f ON class_id = f.node
"""
}
