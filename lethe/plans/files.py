"""Readers and writers at work: tables staged as JSON lines, nested documents, logs, CSV and text, read back and held to SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.operators import transfer
from lethe.plans.scores import r, rounded
from lethe.registry import register
from lethe.sources import byte_ranges, sinks, tables
from lethe.sources.tables import table
from lethe.storage import new_folder


def event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events as JSON lines; every 50th is cut short, every 70th has no kind."""
    rows = table(spark, folder, "events")
    kind = F.when(F.col("event_id") % 70 != 3, F.col("event_type"))
    line = F.to_json(F.struct("event_id", "user_id", kind.alias("kind"), "value"))
    return rows.select(F.when(F.col("event_id") % 50 == 7, F.substr(line, F.lit(1), F.lit(15))).otherwise(line).alias("value"))


def staged_lines(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "lines")
    transfer.json_lines(event_lines(spark, folder), path)
    return tables.json_rows(spark, path, "event_id long, user_id long, kind string, value double")


@register(
    "line_faults",
    "SELECT CASE WHEN event_id % 50 = 7 THEN 'malformed' WHEN event_id % 70 = 3 THEN 'bad kind' WHEN value IS NULL THEN 'bad value' ELSE 'ok' END AS fault, count(*) AS n FROM events GROUP BY 1",
)
def line_faults(spark: SparkSession, folder: str) -> DataFrame:
    """A JSON-lines scan that counts its faults instead of failing on them."""
    return transfer.faults(staged_lines(spark, folder), {"kind": F.col("kind").isNotNull(), "value": F.col("value").isNotNull()})


@register("last_lines", "SELECT user_id, arg_max(CASE WHEN event_id % 70 <> 3 THEN event_type ELSE '' END, event_id) AS kind FROM events WHERE event_id % 50 <> 7 GROUP BY user_id")
def last_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The last line of each key wins, as in a log that is only appended to."""
    rows = staged_lines(spark, folder).where("_corrupt IS NULL").withColumn("kind", F.coalesce("kind", F.lit("")))
    return transfer.last_per_key(rows, "user_id", "kind", "event_id")


@register(
    "row_slices",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey BETWEEN 20 AND 39 OR c_custkey BETWEEN 100 AND 119",
)
def row_slices(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of declared number ranges of a CSV file, by the number that each row carries."""
    path = new_folder(spark, "csv")
    sinks.write_csv(table(spark, folder, "customer").select("c_custkey", "c_name"), path)
    return tables.csv_rows(spark, path, "c_custkey long, c_name string").where("c_custkey BETWEEN 20 AND 39 OR c_custkey BETWEEN 100 AND 119")


@register("csv_round_trip", "SELECT page_id, url, md5(html) AS digest FROM pages")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with quotes, commas and line breaks, written as CSV and read back."""
    path = new_folder(spark, "csv")
    sinks.write_csv(table(spark, folder, "pages"), path)
    rows = spark.read.schema("page_id long, url string, html string").option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return rows.select("page_id", "url", F.md5("html").alias("digest"))


def corpora(spark: SparkSession, folder: str) -> DataFrame:
    """One nested document a conversation: its user turns are for training, the others for evaluation; fields have gaps."""
    entry = F.struct(
        F.when(F.col("turn") % 3 != 2, F.col("turn")).alias("_id"),
        F.when(F.col("turn") % 2 == 0, F.lit(" Direct")).alias("ec"),
        F.when(F.col("conv_id") % 2 == 0, F.lit("INVERSE")).alias("direction"),
        F.when(F.col("conv_id") % 3 != 0, F.lit("en")).alias("language"),
        F.col("role").alias("Q"),
        F.col("text").alias("A"),
    )
    ordered = lambda role: F.transform(F.array_sort(F.collect_list(F.when(role, F.struct(F.col("turn").alias("t"), entry.alias("e"))))), lambda x: x["e"])
    rows = table(spark, folder, "conversations").groupBy("conv_id").agg(ordered(F.col("role") == "user").alias("train"), ordered(F.col("role") != "user").alias("eval"))
    path = new_folder(spark, "corpora")
    rows.write.json(path)
    pair = "array<struct<_id: long, ec: string, direction: string, language: string, Q: string, A: string>>"
    return spark.read.schema(f"conv_id long, train {pair}, eval {pair}").json(path)


PROBES_SQL = """p AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn) - 1 AS place FROM conversations),
f AS (SELECT conv_id, role, text, conv_id || ':' || CASE WHEN turn % 3 <> 2 THEN turn ELSE place END AS probe_id, CASE WHEN turn % 2 = 0 THEN 'direct' WHEN conv_id % 2 = 0 THEN 'inverse' ELSE 'unknown' END AS family,
CASE WHEN conv_id % 3 <> 0 THEN 'en' ELSE 'unknown' END AS language FROM p)"""


@register("eval_probes", f"WITH {PROBES_SQL} SELECT conv_id, probe_id, family, language, role AS question, md5(text) AS digest FROM f WHERE role <> 'user' AND language = 'en'")
def eval_probes(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation probes of nested documents in one language; absent labels fall back on others."""
    found = transfer.probes(corpora(spark, folder), "conv_id", "eval").where("language = 'en'")
    return found.select("conv_id", "probe_id", "family", "language", "question", F.md5("answer").alias("digest"))


@register("train_probes", f"WITH {PROBES_SQL} SELECT family, language, count(*) AS n, count(DISTINCT conv_id) AS n_items FROM f WHERE role = 'user' GROUP BY ALL")
def train_probes(spark: SparkSession, folder: str) -> DataFrame:
    found = transfer.probes(corpora(spark, folder), "conv_id", "train")
    return found.groupBy("family", "language").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("n_items"))


@register(
    "log_epochs",
    f"SELECT user_id AS run, CAST(event_id % 40 AS INT) AS epoch, {r('round(value, 2)', 'loss')}, {r('round(event_id / 8.0, 2)', 'rate')} FROM events WHERE value IS NOT NULL AND event_type <> 'error'",
)
def log_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """A log with a line for each epoch among others, scanned by pattern."""
    number = lambda c: F.regexp_replace(F.format_number(c, 2), ",", "")
    line = F.format_string("10:00 INFO run %d epoch %d/40 loss=%s rate=%s", F.col("user_id"), F.col("event_id") % 40, number(F.round("value", 2)), number(F.round(F.col("event_id") / 8, 2)))
    noise = F.when(F.col("event_type") == "error", F.lit("WARN epoch lost x=1")).otherwise(line)
    path = new_folder(spark, "log")
    table(spark, folder, "events").where("value IS NOT NULL").select(noise.alias("value")).write.text(path)
    found = transfer.log_epochs(spark.read.text(path).withColumn("run", F.regexp_extract("value", r"\brun (\d+)", 1).try_cast("long")))
    return rounded(found.select("run", "epoch", F.col("metrics")["loss"].alias("loss"), F.col("metrics")["rate"].alias("rate")))


LEDGER = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"


@register(
    "export_round_trip",
    f"SELECT 'ok' AS status, count(*) AS n, {r('sum(o_totalprice)', 'total')} FROM orders UNION ALL SELECT 'digest', NULL, NULL UNION ALL SELECT 'target_not_empty', NULL, NULL UNION ALL SELECT 'count', NULL, NULL",
)
def export_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """An export read back, and three that are refused: changed rows, a target that is in use, lost rows."""
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    path = new_folder(spark, "export")
    transfer.export(rows, path)
    whole = transfer.imported(spark, path, LEDGER).agg(F.lit("ok").alias("status"), F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    refused = transfer.check_import(spark, path, LEDGER, rows)
    for change in (rows.withColumn("o_custkey", F.col("o_custkey") + F.when(F.col("o_orderkey") == 5, 1).otherwise(0)), rows.where("o_orderkey != 5")):
        other = new_folder(spark, "export")
        sinks.write_json(change, f"{other}/rows")
        transfer.manifest_of(spark, path).write.json(f"{other}/manifest")
        refused = refused.union(transfer.check_import(spark, other, LEDGER))
    return rounded(whole.unionByName(refused, allowMissingColumns=True))


@register(
    "snapshot_verified",
    "SELECT DISTINCT lower(c_mktsegment) AS file, CASE WHEN c_mktsegment = 'BUILDING' THEN 'changed' ELSE 'ok' END AS status FROM customer UNION ALL SELECT 'gone', 'missing'",
)
def snapshot_verified(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of files held to its manifest of digests: one entry is wrong, one names no file."""
    path = new_folder(spark, "snapshot")
    rows = table(spark, folder, "customer").select(F.lower("c_mktsegment").alias("file"), F.concat_ws(",", "c_custkey", "c_name").alias("value"))
    rows.repartition("file").sortWithinPartitions("file", "value").write.partitionBy("file").text(path)
    found = transfer.file_digests(spark, path, "*.txt").withColumn("path", F.regexp_extract("path", "file=([^/]+)/", 1))
    declared = found.select("path", F.when(F.col("path") == "building", "0").otherwise(F.col("digest")).alias("digest"))
    declared = declared.union(spark.createDataFrame([("gone", "0")], "path string, digest string"))
    return transfer.verified(declared, found).withColumnRenamed("path", "file")


@register("columns_added", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey END AS o_custkey FROM orders")
def columns_added(spark: SparkSession, folder: str) -> DataFrame:
    """A table to which later appends have added a column: older rows have it as null."""
    path = new_folder(spark, "evolving")
    rows = table(spark, folder, "orders")
    sinks.append(rows.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus"), path)
    sinks.append(rows.where("o_orderkey % 2 = 1").select("o_orderkey", "o_orderstatus", "o_custkey"), path)
    return spark.read.option("mergeSchema", True).parquet(path)


@register(
    "folder_digests",
    """SELECT 'length' AS what, o_orderpriority AS name, CAST(sum(octet_length(encode(o_orderkey || ',' || o_custkey)) + 1) AS BIGINT) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'changed', '2-HIGH', 1 UNION ALL SELECT 'trees', NULL, 2""",
)
def folder_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of files read in ranges of 10,000 bytes; the one chunk in which a single byte has changed; two digests of the folder as it was and is."""
    priority = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("k"), F.concat_ws(",", "o_orderkey", "o_custkey").alias("value"))
    first = priority.where("name = '2-HIGH'").agg(F.min("k")).first()[0]
    flipped = F.when(F.col("k") == first, F.translate("value", ",", ";")).otherwise(F.col("value"))
    found = []
    for value in (F.col("value"), flipped):
        path = new_folder(spark, "folder")
        # one file for each name, the same but for the byte
        priority.withColumn("value", value).repartition("name").sortWithinPartitions("name", "k").select("name", "value").write.partitionBy("name").text(path)
        chunks = byte_ranges.chunk_digests(spark, path, "part-*.txt", chunk=10_000)
        found.append(chunks.withColumn("path", F.regexp_replace(F.regexp_extract("path", "name=([^/]+)/", 1), "%20", " ")))
    before, after = found
    lengths = byte_ranges.file_digests(before).select(F.lit("length").alias("what"), F.col("path").alias("name"), F.col("length").alias("n"))
    changed = byte_ranges.changed(before, after).groupBy("path").agg(F.count("*").alias("n")).select(F.lit("changed").alias("what"), F.col("path").alias("name"), "n")
    trees = byte_ranges.tree_digest(byte_ranges.file_digests(before)).union(byte_ranges.tree_digest(byte_ranges.file_digests(after)))
    return lengths.union(changed).union(trees.agg(F.lit("trees"), F.lit(None).cast("string"), F.count_distinct("digest")))
