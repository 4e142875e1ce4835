"""Reading: Parquet tables by name, JSON and JSON-lines, YAML-like settings as JSON, CSV; and ad-hoc SQL over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register_views(spark: SparkSession, folder: str) -> None:
    """A temporary view for each table, for SQL."""
    for name in NAMES:
        table(spark, folder, name).createOrReplaceTempView(name)


def query(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Ad-hoc SQL over the tables of a folder."""
    register_views(spark, folder)
    return spark.sql(sql)


def json_rows(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """JSON lines (or whole JSON documents) with a fixed schema; rows that do not parse keep their text in _corrupt."""
    reader = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", multi_line)
    return reader.json(path)


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def text_files(spark: SparkSession, pattern: str) -> DataFrame:
    """path, text of each file that the pattern names."""
    return spark.read.text(pattern, wholetext=True).selectExpr("_metadata.file_path AS path", "value AS text")
