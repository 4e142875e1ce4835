"""Documents of unknown shape, made of orders with their lines and of customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.operators import nested
from lethe.registry import register
from lethe.sources.tables import table


def as_variant(*columns: Column | str) -> Column:
    return F.parse_json(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def order_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc, v: {"head": {"status", "rank"}, "lines": [{"part", "flags": [return, status]}, ...]}; orders without lines have "none" in their place."""
    line = F.struct(F.col("l_partkey").alias("part"), F.array("l_returnflag", "l_linestatus").alias("flags"))
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("line"))
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list(place)).alias("p"))  # the lines of one order
    head = F.struct(F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"))
    joined = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc"), head.alias("head")).join(lines, "doc", "left")
    full, bare = as_variant("head", F.col("p.line").alias("lines")), as_variant("head", F.lit("none").alias("lines"))
    return joined.select("doc", F.when(F.col("p").isNull(), bare).otherwise(full).alias("v"))


@register(
    "document_nodes",
    """WITH o AS (SELECT o_orderkey, o_orderstatus, substr(o_orderpriority, 1, 1) AS rank, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS full_ FROM orders),
l AS (SELECT l.* FROM lineitem l JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT '' AS path, 'object' AS kind, NULL AS value FROM o UNION ALL SELECT '/head', 'object', NULL FROM o UNION ALL SELECT '/head/status', 'string', o_orderstatus FROM o
  UNION ALL SELECT '/head/rank', 'number', rank FROM o UNION ALL SELECT '/lines', CASE WHEN full_ THEN 'array' ELSE 'string' END, CASE WHEN NOT full_ THEN 'none' END FROM o
  UNION ALL SELECT '/lines/*', 'object', NULL FROM l UNION ALL SELECT '/lines/*/part', 'number', CAST(l_partkey AS VARCHAR) FROM l UNION ALL SELECT '/lines/*/flags', 'array', NULL FROM l
  UNION ALL SELECT '/lines/*/flags/*', 'string', l_returnflag FROM l UNION ALL SELECT '/lines/*/flags/*', 'string', l_linestatus FROM l)
SELECT path, kind, count(*) AS n, count(DISTINCT value) AS n_values FROM n GROUP BY path, kind""",
)
def document_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes by path, places in arrays written as *, with the number of different values."""
    nodes = nested.walk(order_documents(spark, folder), "doc", "v")
    return nodes.groupBy(F.regexp_replace("path", "/[0-9]+", "/*").alias("path"), "kind").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


@register(
    "repeated_settings",
    """WITH s AS (SELECT 'nation' AS key, CAST(c_nationkey AS VARCHAR) AS value, c_custkey AS doc, '/limits/nation' AS path FROM customer UNION ALL SELECT 'tag', c_mktsegment, c_custkey, '/tags/0' FROM customer
  UNION ALL SELECT 'tag', 'n' || c_custkey // 2, c_custkey, '/tags/1' FROM customer UNION ALL SELECT 'name', c_name, c_custkey, '/name' FROM customer),
t AS (SELECT CASE key WHEN 'tag' THEN 'tags' ELSE key END AS key, value, doc, path FROM s), v AS (SELECT key, value FROM t GROUP BY key, value HAVING min(doc) <> max(doc))
SELECT key, value, count(*) AS n, min(path) AS first_path, min(doc) AS first_doc FROM t JOIN v USING (key, value) GROUP BY key, value""",
)
def repeated_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Values that several customers' documents state under one name, wherever they stand."""
    tags = F.array("c_mktsegment", F.concat(F.lit("n"), F.floor(F.col("c_custkey") / 2))).alias("tags")
    v = as_variant(F.struct(F.col("c_nationkey").alias("nation"), F.lit(None).cast("int").alias("cap")).alias("limits"), tags, F.col("c_name").alias("name"))
    found = nested.repeated_values(nested.walk(table(spark, folder, "customer").select("c_custkey", v.alias("v")), "c_custkey", "v"))
    return found.groupBy("key", "value").agg(F.count("*").alias("n"), F.min("path").alias("first_path"), F.min("doc").alias("first_doc"))


@register(
    "fixture_subsets",
    """WITH e AS (SELECT o_orderkey AS doc, o_orderkey % 5 = 1 AS gone, o_orderkey % 5 = 2 AS other_rank, o_orderkey % 5 = 3 AS no_status FROM orders)
SELECT doc, NOT (gone OR other_rank OR no_status) AS matches, CAST(CASE WHEN gone THEN 4 WHEN other_rank OR no_status THEN 1 ELSE 0 END AS BIGINT) AS n_faults,
  CASE WHEN gone THEN '' WHEN other_rank THEN '/head/rank' WHEN no_status THEN '/head/status' END AS first_path FROM e""",
)
def fixture_subsets(spark: SparkSession, folder: str) -> DataFrame:
    """Expected heads of orders held to their documents, which have more in them; some documents are gone, or differ in one leaf."""
    observed = order_documents(spark, folder).where("doc % 5 != 1")
    rank = (F.substring("o_orderpriority", 1, 1).cast("int") + F.when(F.col("o_orderkey") % 5 == 2, 1).otherwise(0)).cast("double").alias("rank")
    status = F.when(F.col("o_orderkey") % 5 == 3, F.lit("other")).otherwise(F.col("o_orderstatus")).alias("status")
    expected = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc"), as_variant(F.struct(rank, status).alias("head")).alias("v"))
    return nested.subset_match(nested.walk(expected, "doc", "v"), nested.walk(observed, "doc", "v"))


@register(
    "nested_overrides",
    """SELECT o_orderkey AS doc, 0.5::DOUBLE AS rate, 'adam' AS name, 7 AS rank, o_orderstatus AS status, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'array' ELSE 'string' END AS lines FROM orders""",
)
def nested_overrides(spark: SparkSession, folder: str) -> DataFrame:
    """Settings set by dotted paths: a level that is not there, a value in the way of one, and a leaf beside others that stay."""
    docs = order_documents(spark, folder)
    changed = docs.select("doc", nested.override(F.col("v"), {"train.rate.name": "x", "train.rate": "5e-1", "head.rank": "7", "train.opt.name": "adam"}).alias("v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    lines = nested.kind_of(get("$.lines", "variant")).alias("lines")
    return changed.select("doc", get("$.train.rate", "double").alias("rate"), get("$.train.opt.name", "string").alias("name"), get("$.head.rank", "int").alias("rank"), get("$.head.status", "string").alias("status"), lines)
