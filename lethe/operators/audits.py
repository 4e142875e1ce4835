"""Reconciliation of two tables and digests of ordered groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile(declared: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """keys, status: missing (declared only), ignored (found only) or matched, for distinct keys."""
    d = declared.select(*keys).distinct().withColumn("_d", F.lit(True))
    f = found.select(*keys).distinct().withColumn("_f", F.lit(True))
    status = F.when(F.col("_f").isNull(), "missing").when(F.col("_d").isNull(), "ignored").otherwise("matched")
    return d.join(f, list(keys), "full_outer").select(*keys, status.alias("status"))


def revisions(current: DataFrame, baseline: DataFrame, key: str, content: Column) -> DataFrame:
    """key, status: no_baseline, changed or unchanged."""
    now, old = current.select(key, content.alias("_now")), baseline.select(key, content.alias("_old"), F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "no_baseline").when(F.col("_now").eqNullSafe(F.col("_old")), "unchanged").otherwise("changed")
    return now.join(old, key, "left").select(key, status.alias("status"))


def ordered_digest(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """group, digest: SHA-256 of the group's values in order, one a line. A group is one ordered list by nature."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v"))))
    return rows.groupBy(group).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["v"]), "\n"), 256).alias("digest"))


def gaps(rows: DataFrame, group: str, number: str) -> DataFrame:
    """group, n, n_missing, n_repeated of a numbering that should run from the least to the largest number once each."""
    per = rows.groupBy(group, number).agg(F.count("*").alias("k"))
    found = per.groupBy(group).agg(F.sum("k").alias("n"), (F.max(number) - F.min(number) + 1 - F.count("*")).alias("n_missing"), F.count_if(F.col("k") > 1).alias("n_repeated"))
    return found


def mixed_labels(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Groups that hold more than one label, with their number."""
    return rows.groupBy(group).agg(F.count_distinct(label).alias("n_labels")).where("n_labels > 1")


def first_of_each(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def long_metrics(rows: DataFrame, key: str, metrics: list[str], bounds: DataFrame, default: float = 1.0) -> DataFrame:
    """key, metric, value, bound, crossed: one row a metric; a metric without a declared bound gets the default."""
    pairs = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in metrics)
    long = rows.select(key, F.expr(f"stack({len(metrics)}, {pairs}) AS (metric, value)"))
    joined = long.join(bounds.select("metric", "bound"), "metric", "left").withColumn("bound", F.coalesce("bound", F.lit(default)))
    return joined.select(key, "metric", "value", "bound", F.coalesce(F.col("value") > F.col("bound"), F.lit(False)).alias("crossed"))


def flattened(rows: DataFrame, key: str) -> DataFrame:
    """key, path, value of each leaf of the other columns; a struct's fields follow a dot, values are text."""
    leaves: list[tuple[str, Column]] = []

    def walk(name: str, value: Column, kind) -> None:
        if hasattr(kind, "fields"):
            for field in kind.fields:
                walk(f"{name}.{field.name}", value[field.name], field.dataType)
        else:
            leaves.append((name, value.cast("string")))

    for field in rows.schema.fields:
        if field.name != key:
            walk(field.name, F.col(field.name), field.dataType)
    return rows.select(key, F.inline(F.array(*[F.struct(F.lit(name).alias("path"), value.alias("value")) for name, value in leaves])))


def differences(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, path, old, new of each leaf that one of two nested records lacks or has with another value."""
    a, b = flattened(old, key).withColumnRenamed("value", "old"), flattened(new, key).withColumnRenamed("value", "new")
    return a.join(b, [key, "path"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select(key, "path", "old", "new")
