"""Documents of unknown shape as VARIANT: all their nodes with paths, values stated twice, subset match, setting dotted paths.

``walk`` opens one level of all documents at a time and writes it, so it takes as many rounds as the deepest document has levels and each
node is opened once. Paths are JSON pointers (``~`` and ``/`` in names as ``~0`` and ``~1``); an element of an array has its place.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.storage import staged

# Outcomes that a fixture which must fail may not have.
ACCEPTING = ("confirmed_witness", "accept", "reconstructable", "approved")

OBJECT = "map<string, variant>"


def kind_of(value: Column) -> Column:
    """object, array, string, number, boolean, null or other; null if there is no value at all."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return (
        F.when(value.isNull(), None)
        .when(name.isin("OBJECT", "ARRAY", "STRING", "BOOLEAN"), F.lower(name))
        .when(name == "VOID", "null")
        .when(name.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"), "number")
        .otherwise("other")
    )


def walk(documents: DataFrame, doc: str, value: str) -> DataFrame:
    """doc, path, key, kind, value of every node: objects and arrays too (their value is null), the root at the empty path.

    key: the nearest name above or at the node. Numbers are written without a needless ``.0``, so that 1 and 1.0 agree.
    Documents without a value have no nodes.
    """
    none = F.lit(None).cast("string")
    level = documents.where(F.col(value).isNotNull()).select(F.col(doc).alias("doc"), F.lit("").alias("path"), none.alias("key"), F.col(value).alias("node"))
    nodes = []
    while True:
        level = staged(level.withColumn("kind", kind_of(F.col("node"))), "nodes")
        text = F.expr("try_variant_get(node, '$', 'string')")
        text = F.when(F.col("kind") == "number", F.regexp_replace(text, r"\.0+$", "")).when(F.col("kind").isin("string", "boolean", "other"), text)
        nodes.append(level.select("doc", "path", "key", "kind", text.alias("value")))
        containers = level.where("kind IN ('object', 'array')")
        if containers.isEmpty():
            return reduce(DataFrame.union, nodes)
        inside = containers.select("doc", "path", F.col("key").alias("above"), "node").lateralJoin(documents.sparkSession.tvf.variant_explode(F.col("node").outer()))
        name = F.coalesce(F.replace(F.replace("key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.col("pos").cast("string"))
        level = inside.select("doc", F.concat("path", F.lit("/"), name).alias("path"), F.coalesce("key", "above").alias("key"), F.col("value").alias("node"))


def repeated_values(nodes: DataFrame) -> DataFrame:
    """key, value, doc, path of values that at least two documents state under one name, with every place of them; nulls and blanks state nothing."""
    stated = nodes.where("value IS NOT NULL AND trim(value) != '' AND key IS NOT NULL").select("key", "kind", "value", "doc", "path")
    several = stated.groupBy("key", "kind", "value").agg(F.min("doc").alias("_a"), F.max("doc").alias("_b")).where("_a != _b").select("key", "kind", "value")
    return stated.join(several, ["key", "kind", "value"]).select("key", "value", "doc", "path")


def subset_faults(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """doc, path, fault (missing, different) for each node of ``expected`` that ``observed`` does not have; what else it has is no fault.

    Both as from ``walk``. Elements of arrays are held to their places. A document that is not observed misses its root.
    """
    right = observed.select("doc", "path", F.col("kind").alias("_kind"), F.col("value").alias("_value"))
    both = expected.join(right, ["doc", "path"], "left")
    fault = F.when(F.col("_kind").isNull(), "missing").when((F.col("kind") != F.col("_kind")) | ~F.col("value").eqNullSafe(F.col("_value")), "different")
    return both.select("doc", "path", fault.alias("fault")).where("fault IS NOT NULL")


def subset_match(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """doc, matches, n_faults, first_path (the least path at fault) of each expected document."""
    faults = subset_faults(expected, observed).groupBy("doc").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))
    found = expected.select("doc").distinct().join(faults, "doc", "left")
    return found.select("doc", F.col("n").isNull().alias("matches"), F.coalesce("n", F.lit(0)).cast("long").alias("n_faults"), "first_path")


def outcome_matches(expected: Column, must_fail: Column, claimed: Column, observed: Column) -> Column:
    """Whether an observed outcome is what a fixture declares: the outcome itself, or that it must fail (not with the verdict it wrongly claims)."""
    fails = F.coalesce(must_fail, F.lit(False))
    return (
        F.when(expected.isNotNull(), observed.eqNullSafe(expected))
        .when(fails & (F.coalesce(claimed, F.lit("")) != ""), ~observed.eqNullSafe(claimed))
        .when(fails, ~F.coalesce(observed.isin(*ACCEPTING), F.lit(False)))
        .otherwise(observed.isNotNull())
    )


def set_path(value: Column, path: str | Sequence[str], new: Column) -> Column:
    """``value`` with ``new`` at a dotted path (or a list of names). Levels that are not there are made, and anything but an object in the way is replaced."""
    name, *rest = path.split(".") if isinstance(path, str) else path
    held = F.coalesce(value.try_cast(OBJECT), F.create_map().cast(OBJECT))
    child = set_path(F.element_at(held, name), rest, new) if rest else new
    others = F.map_filter(held, lambda key, _: key != name)
    return F.call_function("to_variant_object", F.map_concat(others, F.create_map(F.lit(name), child)))


def parsed(text: Column) -> Column:
    """An override as typed: true, false, null or none in any case, an integer, a decimal number, else the text itself."""
    bare, low = F.trim(text), F.lower(text)
    number = F.when(bare.rlike(r"^[+-]?\d+(_\d+)*$"), F.regexp_replace(bare.cast("string"), "[+_]", "").cast("decimal(38,0)").cast("string"))
    real = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.cast("double").cast("string"))
    literal = F.when(low.isin("true", "false"), low).when(low.isin("null", "none"), "null")
    quoted = F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")
    return F.parse_json(F.coalesce(literal, number, real, quoted))


def override(value: Column, settings: dict[str, str]) -> Column:
    """``value`` with dotted paths set to values as typed, one after the other."""
    return reduce(lambda document, item: set_path(document, item[0], parsed(F.lit(item[1]))), settings.items(), value)
