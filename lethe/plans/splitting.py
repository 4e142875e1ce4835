"""Splits with exact counts: copies of a text stay together; facts of linked subjects stay together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.operators import splits
from lethe.registry import register
from lethe.sources.tables import table

#: Facts in construction and calibration, and the relations that both must cover.
COPIES, ORDERS = (12, 8, ("en", "fr")), (9, 6, ("1-URGENT", "2-HIGH"))
SEED = 7


def packing_sql(construction: int, calibration: int, relations: tuple[str, ...], seed: int) -> str:
    """Common table expressions from members(grp, relation) to labels(grp, label): all packings of classes, the least kept for each state."""
    full, bits = (1 << len(relations)) - 1, " ".join(f"WHEN '{name}' THEN {1 << k}" for k, name in enumerate(relations))
    return f"""
g AS (SELECT grp, count(*) AS size, bit_or(CASE relation {bits} ELSE 0 END) AS mask FROM members GROUP BY grp),
k AS (SELECT size, mask, least(count(*), {construction} // size + {calibration} // size) AS n, row_number() OVER (ORDER BY size DESC, mask) AS i
  FROM g WHERE size <= {max(construction, calibration)} GROUP BY size, mask),
o AS (SELECT i, size, mask, x, y FROM k, range({construction + 1}) a(x), range({calibration + 1}) b(y) WHERE x + y <= n AND x * size <= {construction} AND y * size <= {calibration}),
t(i, c, d, cm, dm, path) AS (SELECT 0, 0, 0, 0, 0, []::BIGINT[] UNION ALL
  SELECT t.i + 1, c + x * size, d + y * size, cm | CASE WHEN x > 0 THEN mask ELSE 0 END, dm | CASE WHEN y > 0 THEN mask ELSE 0 END, min(list_concat(path, [x, y]))
  FROM t JOIN o ON o.i = t.i + 1 WHERE c + x * size <= {construction} AND d + y * size <= {calibration} GROUP BY ALL),
best AS (SELECT path FROM t WHERE i = (SELECT count(*) FROM k) AND c = {construction} AND d = {calibration} AND cm = {full} AND dm = {full}),
m AS (SELECT grp, size, mask, i, row_number() OVER (PARTITION BY size, mask ORDER BY md5('{seed}:' || grp), grp) AS place FROM g LEFT JOIN k USING (size, mask)),
labels AS (SELECT grp, CASE WHEN i IS NULL THEN 'unassigned' WHEN place <= path[2 * i - 1] THEN 'construction' WHEN place <= path[2 * i - 1] + path[2 * i] THEN 'calibration' ELSE 'unassigned' END AS label FROM m, best)"""


@register(
    "copies_split",
    f"""WITH RECURSIVE members AS (SELECT doc_id, md5(coalesce(text, '')) AS grp, lang AS relation FROM documents), {packing_sql(*COPIES, SEED)}
SELECT doc_id, label FROM members JOIN labels USING (grp)""",
)
def copies_split(spark: SparkSession, folder: str) -> DataFrame:
    """Exactly 12 and 8 documents with both languages in each split, and no text in two splits."""
    docs = table(spark, folder, "documents").select("doc_id", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("grp"), F.col("lang").alias("relation"))
    return docs.join(splits.packed_splits(docs, *COPIES, SEED), "grp").select("doc_id", "label")


@register(
    "split_assignment",
    f"""WITH RECURSIVE gates AS (SELECT o_orderkey AS fact, CASE WHEN o_orderstatus = 'P' THEN 'fail' ELSE 'pass' END AS verdict FROM orders),
audits AS (SELECT l_orderkey AS fact, CASE WHEN l_returnflag = 'R' THEN 'leak' ELSE 'clean' END AS verdict FROM lineitem),
f AS (SELECT o_orderkey AS fact, o_custkey AS subject, CASE WHEN o_orderkey % 97 = 0 THEN o_custkey * 7 % 1000 ELSE -1 - o_orderkey END AS object, o_orderpriority AS relation FROM orders
  WHERE o_orderkey IN (SELECT fact FROM gates GROUP BY fact HAVING count(*) = 1 AND bool_and(verdict = 'pass')) AND o_orderkey IN (SELECT fact FROM audits GROUP BY fact HAVING bool_and(verdict = 'clean'))),
e AS (SELECT subject AS a, object AS b FROM f WHERE object IN (SELECT subject FROM f)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT subject, subject FROM f UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a),
roots AS (SELECT a AS subject, min(b) AS grp FROM reach GROUP BY a), members AS (SELECT fact, subject, relation, grp FROM f JOIN roots USING (subject)),
{packing_sql(*ORDERS, SEED)}
SELECT fact, subject, label FROM members JOIN labels USING (grp)""",
)
def split_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """Orders whose gate passes and whose lines are clean; customers that an order names go where its own customer goes."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    named = F.when(F.col("o_orderkey") % 97 == 0, F.col("o_custkey") * 7 % 1000).otherwise(-1 - F.col("o_orderkey"))
    facts = orders.select(F.col("o_orderkey").alias("fact"), F.col("o_custkey").alias("subject"), named.alias("object"), F.col("o_orderpriority").alias("relation"))
    gates = orders.select(F.col("o_orderkey").alias("fact"), F.when(F.col("o_orderstatus") == "P", "fail").otherwise("pass").alias("verdict"))
    audits = lines.select(F.col("l_orderkey").alias("fact"), F.when(F.col("l_returnflag") == "R", "leak").otherwise("clean").alias("verdict"))
    return splits.assign_splits(facts, gates, audits, *ORDERS, SEED)
