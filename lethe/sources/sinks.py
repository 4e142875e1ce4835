"""Writing: Parquet, JSON lines and CSV folders, append-only tables, and a digest of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType


def append(rows: DataFrame, path: str) -> None:
    """Append to a table that is never rewritten."""
    rows.write.mode("append").parquet(path)


def finite(column: Column, kind: DataType) -> Column:
    """``column`` with NaN and infinities as null, inside arrays, structs and maps as well."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(F.isnan(column) | (F.abs(column) == float("inf")), None).otherwise(column)
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: finite(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(column.isNotNull(), F.struct(*[finite(column[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, MapType):
        return F.transform_values(column, lambda _, x: finite(x, kind.valueType))
    return column


def json_values(rows: DataFrame) -> DataFrame:
    """``rows`` as JSON can hold them: it has no NaN and no infinities."""
    return rows.select(*[finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema])


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines; NaN and infinities as null, as JSON has no such numbers."""
    json_values(rows).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def digest(rows: DataFrame) -> DataFrame:
    """One row n, digest: the number of rows and an order-free sum over their SHA-256, whatever the partitioning."""
    part = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest"))
