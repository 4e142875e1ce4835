"""Content-addressed artefacts: contents are stored once under their digest; a register says which run made what; unregistered ones cannot be read.

Both tables are append-only and inserts are idempotent: what is there already is left out, and readers take one row for a key, so a
repeated or concurrent insert changes nothing. Contents of up to 2 GB are cells; larger ones are registered as external blobs, by digest only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVIDENCE = ("generation", "score", "witness", "result", "report", "checkpoint")
TEMPORARY = "temporary"
BLOBS, REGISTER = "digest string, content binary", "digest string, class string, run string, name string"
EXTERNAL = "digest string, uri string, size long, run string"
#: Leading digits of a digest that name the folder of its blob: a look-up reads the folders it needs.
SHARD = 2


class StoreError(ValueError):
    """An artefact that may not be stored, or is not what its digest says."""


class Unregistered(KeyError):
    """An artefact that no run has registered."""


def init(spark: SparkSession, root: str) -> None:
    """Empty tables, so that they can be read."""
    spark.createDataFrame([], BLOBS + ", shard string").coalesce(1).write.mode("append").partitionBy("shard").parquet(f"{root}/blobs")
    for name, schema in (("register", REGISTER), ("external", EXTERNAL)):
        spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(f"{root}/{name}")


def digest_of(content: str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def blobs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(BLOBS + ", shard string").parquet(f"{root}/blobs")


def register(spark: SparkSession, root: str) -> DataFrame:
    """digest, class, run, name: the first run by name that registered a digest for a class."""
    rows = spark.read.schema(REGISTER).parquet(f"{root}/register")
    return rows.groupBy("digest", "class").agg(F.min(F.struct("run", "name")).alias("first")).select("digest", "class", "first.*")


def write(artifacts: DataFrame, root: str) -> DataFrame:
    """Stores contents that are new and registers them; class, run, name, digest of each row. artifacts: class, run, name, content.

    Temporary ones are given their digest and nothing else.
    """
    spark = artifacts.sparkSession
    known = [*EVIDENCE, TEMPORARY]
    odd = artifacts.where(~F.coalesce(F.col("class").isin(known), F.lit(False)) | F.col("run").isNull() | F.col("name").isNull() | F.col("content").isNull()).limit(1).collect()
    if odd:
        raise StoreError(f"class {odd[0]['class']}, run {odd[0]['run']}, name {odd[0]['name']}: class, run, name and content are needed")
    named = artifacts.select("class", "run", "name", digest_of("content").alias("digest"), "content")
    lasting = named.where(F.col("class") != TEMPORARY)
    held = blobs(spark, root).select("digest")
    fresh = lasting.select("digest", "content").dropDuplicates(["digest"]).join(held, "digest", "left_anti")
    # blobs first: what is registered can be read
    fresh.withColumn("shard", F.substring("digest", len("sha256:") + 1, SHARD)).repartition("shard").write.mode("append").partitionBy("shard").parquet(f"{root}/blobs")
    entries = lasting.groupBy("digest", "class").agg(F.min(F.struct("run", "name")).alias("first")).select("digest", "class", "first.*")
    entries.join(register(spark, root).select("digest", "class"), ["digest", "class"], "left_anti").write.mode("append").parquet(f"{root}/register")
    return named.drop("content")


def resolve(wanted: DataFrame, root: str) -> DataFrame:
    """class, digest, run, name, content of ``wanted`` (class, digest). Evidence must be registered under its own class.

    Raises Unregistered if one is not, StoreError if a content has changed.
    """
    spark = wanted.sparkSession
    entries = register(spark, root)
    own = wanted.join(entries, ["class", "digest"], "left")
    any_class = entries.groupBy("digest").agg(F.min(F.struct("run", "name")).alias("any"))
    named = own.join(any_class, "digest", "left").withColumn("evidence", F.col("class").isin(*EVIDENCE))
    named = named.select("class", "digest", *[F.coalesce(c, F.when(~F.col("evidence"), F.col("any")[c])).alias(c) for c in ("run", "name")])
    if missing := named.where("run IS NULL").limit(1).collect():
        raise Unregistered(f"{missing[0]['class']} {missing[0]['digest']}")
    shards = F.substring("digest", len("sha256:") + 1, SHARD)
    found = named.withColumn("shard", shards).join(blobs(spark, root).dropDuplicates(["digest"]), ["shard", "digest"], "left").drop("shard")
    if wrong := found.where("content IS NULL").limit(1).collect() or found.where(digest_of("content") != F.col("digest")).limit(1).collect():
        raise StoreError(f"{wrong[0]['digest']}: {'gone' if wrong[0]['content'] is None else 'changed'}")
    return found


def audit(spark: SparkSession, root: str) -> DataFrame:
    """digest, status of every blob or entry: ok, changed, gone (registered, not stored) or unregistered (stored only)."""
    stored = blobs(spark, root).groupBy("digest").agg(F.bool_and(digest_of("content") == F.col("digest")).alias("sound"))
    both = register(spark, root).select("digest").distinct().withColumn("named", F.lit(True)).join(stored, "digest", "full_outer")
    status = F.when(F.col("sound").isNull(), "gone").when(~F.col("sound"), "changed").when(F.col("named").isNull(), "unregistered").otherwise("ok")
    return both.select("digest", status.alias("status"))


def register_external(blobs_elsewhere: DataFrame, root: str) -> None:
    """Registers contents that stay elsewhere: digest, uri, size, run. A digest that is known with another size is refused."""
    spark = blobs_elsewhere.sparkSession
    rows = blobs_elsewhere.select("digest", "uri", F.col("size").cast("long").alias("size"), "run")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    if rows.where(blank("digest") | blank("uri") | blank("run") | ~F.coalesce(F.col("size") > 0, F.lit(False))).limit(1).count():
        raise StoreError("an external blob needs digest, uri, run and a size above 0")
    known = spark.read.schema(EXTERNAL).parquet(f"{root}/external")
    sizes = rows.select("digest", "size").union(known.select("digest", "size")).groupBy("digest").agg(F.count_distinct("size").alias("n")).where("n > 1")
    if wrong := sizes.limit(1).collect():
        raise StoreError(f"{wrong[0]['digest']}: two sizes")
    fresh = rows.groupBy("digest").agg(F.min(F.struct("uri", "size", "run")).alias("first")).select("digest", "first.*")
    fresh.join(known.select("digest"), "digest", "left_anti").write.mode("append").parquet(f"{root}/external")


def external(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.schema(EXTERNAL).parquet(f"{root}/external")
    return rows.groupBy("digest").agg(F.min(F.struct("uri", "size", "run")).alias("first")).select("digest", "first.*")
