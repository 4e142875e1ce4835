"""Exports with a manifest, checked imports, file digests, and reading of rows that may be malformed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.sources import sinks

VERSION = 1


def export(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines beside a manifest of version, count and digest, which is that of the rows as JSON holds them."""
    sinks.write_json(rows, f"{path}/rows")
    sinks.digest(sinks.json_values(rows)).withColumn("version", F.lit(VERSION)).write.mode("overwrite").json(f"{path}/manifest")


def manifest_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("n long, digest string, version int").json(f"{path}/manifest")


def check_import(spark: SparkSession, path: str, schema: str, target: DataFrame | None = None) -> DataFrame:
    """One row status: ok, or why an export may not be imported: version, count, digest, or a target that is not empty."""
    rows = spark.read.schema(schema).json(f"{path}/rows")
    found = sinks.digest(rows).toDF("n_found", "found")
    both = manifest_of(spark, path).join(F.broadcast(found))  # one row and one row
    status = F.when(F.col("version") != VERSION, "version").when(F.col("n") != F.col("n_found"), "count").when(F.col("digest") != F.col("found"), "digest").otherwise("ok")
    full = target is not None and not target.isEmpty()
    return both.select(F.lit("target_not_empty") if full else status.alias("status")).toDF("status")


def imported(spark: SparkSession, path: str, schema: str, target: DataFrame | None = None) -> DataFrame:
    """The rows of an export whose manifest holds; else an error that names what does not."""
    status = check_import(spark, path, schema, target).first()
    if status is None or status.status != "ok":
        raise ValueError(f"{path}: refused: {status.status if status else 'no manifest'}")
    return spark.read.schema(schema).json(f"{path}/rows")


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, digest of each file below ``path``; a file's bytes are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("digest"))


def verified(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """path, status of files declared or found: ok, changed, missing or undeclared."""
    both = manifest.select("path", F.col("digest").alias("_d")).join(found.select("path", F.col("digest").alias("_f")), "path", "full_outer")
    status = F.when(F.col("_d").isNull(), "undeclared").when(F.col("_f").isNull(), "missing").when(F.col("_d") != F.col("_f"), "changed").otherwise("ok")
    return both.select("path", status.alias("status"))


def faults(rows: DataFrame, required: dict[str, Column]) -> DataFrame:
    """fault, n: malformed lines, the first required column that is missing, or ok. rows: as from ``tables.json_rows``."""
    missing = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"bad {name}")) for name, ok in required.items()])
    return rows.groupBy(F.when(F.col("_corrupt").isNotNull(), "malformed").otherwise(F.coalesce(missing, F.lit("ok"))).alias("fault")).agg(F.count("*").alias("n"))


def last_per_key(rows: DataFrame, key: str, value: str, line: str) -> DataFrame:
    """key, value of the last line of each key."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, line).alias(value))


def probes(documents: DataFrame, item: str, part: str) -> DataFrame:
    """item, probe_id, family, language, question, answer of each entry of the array ``part``; gaps count as unknown, ids default to places."""
    each = documents.select(item, F.posexplode(part).alias("place", "p"))
    family = F.coalesce(F.nullif(F.lower(F.trim(F.coalesce("p.ec", "p.direction", F.lit("unknown")))), F.lit("")), F.lit("unknown"))
    probe_id = F.concat_ws(":", F.col(item).cast("string"), F.coalesce(F.col("p._id").cast("string"), F.col("place").cast("string")))
    return each.select(item, probe_id.alias("probe_id"), family.alias("family"), F.coalesce("p.language", F.lit("unknown")).alias("language"), F.col("p.Q").alias("question"), F.col("p.A").alias("answer"))


def log_epochs(lines: DataFrame) -> DataFrame:
    """run, epoch, of_epochs, metrics map of each log line ``epoch i/n k=v ...``; other lines count for nothing. lines: run, value."""
    hit = lines.where(F.col("value").rlike(r"\bepoch \d+/\d+"))
    number = lambda k: F.regexp_extract("value", r"\bepoch (\d+)/(\d+)", k).cast("int")
    names = F.regexp_extract_all("value", F.lit(r"(\w+)=(-?[\d.]+)"), 1)
    values = F.transform(F.regexp_extract_all("value", F.lit(r"(\w+)=(-?[\d.]+)"), 2), lambda v: v.cast("double"))
    return hit.select("run", number(1).alias("epoch"), number(2).alias("of_epochs"), F.map_from_arrays(names, values).alias("metrics"))


def json_lines(rows: DataFrame, path: str) -> None:
    """Raw lines of text, as they are (column ``value``)."""
    rows.select("value").write.mode("overwrite").text(path)


