"""Tables that become visible together, migrations, content-addressed artefacts, exports with odd numbers."""

from __future__ import annotations

import hashlib

import pytest
from lethe.operators import multiplicity, transfer
from lethe.sources import artifacts, publishing
from pyspark.sql import functions as F


@pytest.fixture
def root(spark, tmp_path):
    publishing.init(spark, str(tmp_path))
    return str(tmp_path)


def facts(spark, *names):
    return spark.createDataFrame([(n, 1.5) for n in names], "fact string, score double")


def sources(spark, *names):
    return spark.createDataFrame([(n, None) for n in names], "fact string, note string")


def orphans(tables):
    """Sources of unknown facts."""
    lost = tables["sources"].join(tables["facts"], "fact", "left_anti")
    return lost.agg(F.lit("sources").alias("table"), F.lit("unknown fact").alias("fault"), F.count("*").alias("n"))


def visible(spark, root):
    return {name: sorted(r.fact for r in rows.collect()) for name, rows in publishing.published(spark, root).items()}


def test_all_tables_or_none(spark, root):
    assert publishing.published(spark, root) == {} and publishing.current(spark, root) is None
    first = publishing.publish({"facts": facts(spark, "a", "b"), "sources": sources(spark, "a")}, root, orphans)
    held = {"facts": ["a", "b"], "sources": ["a"]}
    assert visible(spark, root) == held
    for bad, message in [
        ({"facts": facts(spark, "c"), "sources": sources(spark, "d")}, "unknown fact"),
        ({"facts": facts(spark, "c"), "sources": sources(spark, "c").limit(0)}, "sources: empty"),
        ({"facts": facts(spark, "c"), "sources": sources(spark, "c").withColumn("note", F.raise_error(F.lit("broken row")).cast("string"))}, "broken row"),
    ]:
        with pytest.raises(Exception, match=message):
            publishing.publish(bad, root, orphans)
        assert visible(spark, root) == held
    second = publishing.publish({"facts": facts(spark, "c"), "sources": sources(spark, "c").limit(0)}, root, orphans, may_be_empty=["sources"])
    assert visible(spark, root) == {"facts": ["c"], "sources": []} and first != second
    publishing.roll_back(spark, root, first)
    assert visible(spark, root) == held and publishing.history(spark, root).count() == 3
    with pytest.raises(publishing.PublishError, match="never"):
        publishing.roll_back(spark, root, "unknown")


def test_of_two_publishers_one_holds(spark, root):
    publishing.publish({"facts": facts(spark, "a")}, root)
    before, outcome = publishing.current(spark, root), []
    for name in ("x", "y"):
        try:
            publishing.publish({"facts": facts(spark, name)}, root, before=before)
            outcome.append(name)
        except publishing.Conflict:
            pass
    # a second pointer with a smaller token takes the place of the first: the later reader sees one winner all the same
    assert len(visible(spark, root)["facts"]) == 1 and publishing.history(spark, root).count() == 2 and outcome


def test_stored_tables_are_verified(spark, root, monkeypatch):
    def loses_a_row(tables, where):
        version, entries = stage({name: rows.limit(1) for name, rows in tables.items()}, where)
        return version, {name: entry | {"n": 2} for name, entry in entries.items()}

    stage = publishing.stage
    monkeypatch.setattr(publishing, "stage", loses_a_row)
    with pytest.raises(publishing.PublishError, match="1 rows"):
        publishing.publish({"facts": facts(spark, "a", "b")}, root)
    assert publishing.published(spark, root) == {}


def test_migrations_run_once(spark, root):
    def with_status(tables):
        return tables | {"facts": tables["facts"].withColumn("status", F.lit("draft"))}

    def with_entities(tables):
        return tables | {"entities": tables["facts"].select(F.upper("fact").alias("fact")).distinct()}

    steps = [with_status, with_entities]
    assert publishing.migrate(spark, root, steps) == []  # nothing stored
    publishing.publish({"facts": facts(spark, "a", "b")}, root)
    assert publishing.migrate(spark, root, steps[:1]) == [1] and publishing.migrate(spark, root, steps[:1]) == []
    assert publishing.migrate(spark, root, steps) == [2] and publishing.migrate(spark, root, steps) == []
    assert visible(spark, root)["entities"] == ["A", "B"] and {r.status for r in publishing.published(spark, root)["facts"].collect()} == {"draft"}
    with pytest.raises(publishing.NewerVersion, match="version 2"):
        publishing.migrate(spark, root, steps[:1])

    def fails(tables):
        return {"facts": tables["facts"].where("false").withColumn("fact", F.raise_error(F.lit("cannot")).cast("string")).union(tables["facts"].select(F.raise_error(F.lit("cannot")).cast("string"), "score", "status"))}

    with pytest.raises(Exception, match="cannot"):
        publishing.migrate(spark, root, [*steps, fails])
    assert publishing.current(spark, root)["schema_version"] == 2 and visible(spark, root)["facts"] == ["a", "b"]


CONTENTS = "class string, run string, name string, content binary"


def digest(content: bytes) -> str:
    return "sha256:" + hashlib.sha256(content).hexdigest()


@pytest.fixture
def store(spark, tmp_path):
    artifacts.init(spark, f"{tmp_path}/store")
    return f"{tmp_path}/store"


def test_contents_are_stored_once(spark, store):
    rows = [("score", "r1", "a.json", b"one"), ("score", "r2", "b.json", b"one"), ("result", "r1", "c.json", b"one"), ("temporary", "r1", "t", b"tmp"), ("report", "r1", "e", b"")]
    made = artifacts.write(spark.createDataFrame(rows, CONTENTS), store)
    assert sorted((r["class"], r.digest) for r in made.collect()) == sorted((c, digest(x)) for c, _, _, x in rows)
    for _ in range(2):
        artifacts.write(spark.createDataFrame(rows, CONTENTS), store)
    assert artifacts.blobs(spark, store).count() == 2
    assert sorted((r["class"], r.run, r.name) for r in artifacts.register(spark, store).collect()) == [("report", "r1", "e"), ("result", "r1", "c.json"), ("score", "r1", "a.json")]
    assert {r.status for r in artifacts.audit(spark, store).collect()} == {"ok"}


def test_only_registered_contents_are_read(spark, store):
    artifacts.write(spark.createDataFrame([("score", "r1", "a", b"one"), ("temporary", "r1", "t", b"tmp")], CONTENTS), store)
    wanted = lambda *rows: spark.createDataFrame(list(rows), "class string, digest string")
    found = artifacts.resolve(wanted(("score", digest(b"one")), ("config", digest(b"one"))), store).collect()
    assert sorted((r["class"], r.run, bytes(r.content)) for r in found) == [("config", "r1", b"one"), ("score", "r1", b"one")]
    for row in (("result", digest(b"one")), ("temporary", digest(b"tmp")), ("score", digest(b"never"))):
        with pytest.raises(artifacts.Unregistered, match=row[0]):
            artifacts.resolve(wanted(row), store)


def test_a_changed_content_is_refused(spark, store):
    artifacts.write(spark.createDataFrame([("score", "r1", "a", b"one"), ("score", "r1", "b", b"two")], CONTENTS), store)
    changed = artifacts.blobs(spark, store).withColumn("content", F.when(F.col("digest") == digest(b"one"), F.encode(F.lit("other"), "UTF-8")).otherwise(F.col("content"))).collect()
    schema = artifacts.BLOBS + ", shard string"
    spark.createDataFrame(changed, schema).write.mode("overwrite").partitionBy("shard").parquet(f"{store}/blobs")
    with pytest.raises(artifacts.StoreError, match="changed"):
        artifacts.resolve(spark.createDataFrame([("score", digest(b"one"))], "class string, digest string"), store)
    assert {r.digest: r.status for r in artifacts.audit(spark, store).collect()} == {digest(b"one"): "changed", digest(b"two"): "ok"}
    spark.createDataFrame([r for r in changed if r.digest != digest(b"one")], schema).write.mode("overwrite").partitionBy("shard").parquet(f"{store}/blobs")
    with pytest.raises(artifacts.StoreError, match="gone"):
        artifacts.resolve(spark.createDataFrame([("score", digest(b"one"))], "class string, digest string"), store)
    with pytest.raises(artifacts.StoreError, match="needed"):
        artifacts.write(spark.createDataFrame([("novel", "r1", "a", b"x")], CONTENTS), store)


def test_external_blobs(spark, store):
    schema = "digest string, uri string, size long, run string"
    for _ in range(2):
        artifacts.register_external(spark.createDataFrame([("d1", "s3://x", 5, "r2"), ("d1", "s3://a", 5, "r1")], schema), store)
    assert [tuple(r) for r in artifacts.external(spark, store).select("digest", "uri", "size", "run").collect()] == [("d1", "s3://a", 5, "r1")]
    with pytest.raises(artifacts.StoreError, match="two sizes"):
        artifacts.register_external(spark.createDataFrame([("d1", "s3://x", 6, "r3")], schema), store)
    for bad in [("", "u", 1, "r"), ("d", " ", 1, "r"), ("d", "u", 0, "r"), ("d", "u", None, "r"), ("d", "u", 1, None)]:
        with pytest.raises(artifacts.StoreError, match="external"):
            artifacts.register_external(spark.createDataFrame([bad], schema), store)


def test_export_of_odd_numbers(spark, tmp_path):
    schema = "a long, b double, c array<double>, d struct<x: double, y: string>, e map<string, float>"
    nan, inf = float("nan"), float("inf")
    rows = [(1, 2.5, [1.0, nan], (inf, "t"), {"k": nan}), (2, nan, None, None, None), (3, -inf, [], (0.5, None), {}), (4, None, [None], (nan, None), {"k": 1.5})]
    transfer.export(spark.createDataFrame(rows, schema), str(tmp_path))
    assert [r.status for r in transfer.check_import(spark, str(tmp_path), schema).collect()] == ["ok"]
    back = {r.a: r for r in transfer.imported(spark, str(tmp_path), schema).collect()}
    assert back[1].c == [1.0, None] and back[1].d.x is None and back[1].d.y == "t" and back[2].b is None and back[2].d is None and back[4].e == {"k": 1.5}


@pytest.mark.parametrize("m", [1, 2, 63, 64, 65, 1000, 123_456])
def test_harmonic_numbers(spark, m):
    found = spark.range(1).select(multiplicity.harmonic(F.lit(m).cast("long")).alias("h")).first().h
    assert found == pytest.approx(sum(1 / k for k in range(m, 0, -1)), rel=1e-14)
