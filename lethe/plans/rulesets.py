"""Rules as data: classes of validation rules over the driver tables, one query a class.

A rule is a name and a predicate that holds for every sound row, group or pair; a row for which it is false or null breaks it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.operators import rules
from lethe.registry import register
from lethe.sources.tables import table

#: class: table: rule: predicate. MATCHES stands for each engine's test of a pattern.
ROW_RULES = {
    "rules_required": {
        "orders": {"order_has_customer": "o_custkey IS NOT NULL", "order_has_priority": "o_orderpriority IS NOT NULL AND trim(o_orderpriority) <> ''"},
        "events": {"event_has_value": "value IS NOT NULL", "event_has_props": "props IS NOT NULL AND props <> '{}'"},
        "documents": {"text_is_there": "text IS NOT NULL AND text <> ''", "source_is_named": "source IS NOT NULL"},
    },
    "rules_vocabulary": {
        "orders": {"known_status": "o_orderstatus IN ('F', 'O')", "known_priority": "substr(o_orderpriority, 1, 1) IN ('1', '2', '3', '4', '5')"},
        "events": {"known_kind": "event_type IN ('view', 'click', 'purchase')"},
        "conversations": {"known_role": "role IN ('user', 'assistant')"},
        "documents": {"known_language": "lang IN ('en', 'de', 'fr')"},
    },
    "rules_range": {
        "lineitem": {"discount_is_share": "l_discount BETWEEN 0 AND 0.08", "tax_is_small": "l_tax >= 0 AND l_tax < 0.07", "quantity_is_whole": "l_quantity = floor(l_quantity) AND l_quantity >= 1"},
        "events": {"value_is_bounded": "value > 0 AND value <= 200"},
        "labels": {"quality_is_binary": "quality IN (0, 1)", "toxic_is_binary": "toxic BETWEEN 0 AND 1"},
    },
    "rules_pattern": {
        "customer": {"name_is_numbered": "MATCHES(c_name, '^Customer#[0-9]{9}$')", "name_is_short_number": "MATCHES(c_name, '#0{6,}[0-9]+$')"},
        "pages": {"url_is_http": "MATCHES(url, '^https?://[a-z]+[.]')", "url_is_plain": "NOT MATCHES(url, '[?&]')"},
        "part": {"brand_is_numbered": "MATCHES(p_brand, '^Brand#[0-9]+$')"},
    },
    "rules_conditional": {
        "lineitem": {"returned_lines_are_cheap": "l_returnflag <> 'R' OR l_extendedprice < 90000", "open_lines_are_late": "l_linestatus <> 'O' OR l_shipdate >= TIMESTAMP '1996-01-01'"},
        "orders": {"urgent_orders_are_large": "o_orderpriority NOT LIKE '1-%' OR o_totalprice > 50000"},
        "labels": {"toxic_is_not_good": "toxic = 0 OR quality = 0"},
        "conversations": {"answers_follow": "role <> 'assistant' OR turn > 0", "no_marks_left": "NOT contains(text, '{') AND NOT contains(text, 'TODO')"},
    },
}


def in_engine(predicate: str, test: str) -> str:
    return predicate.replace("MATCHES", test)


def row_query(name: str, by_table: dict[str, dict[str, str]]) -> None:
    parts = [f"SELECT '{rule}' AS rule_id, count(*) AS n_rows, count(*) FILTER (WHERE NOT coalesce({in_engine(holds, 'regexp_matches')}, false)) AS n_broken FROM {of}" for of, some in by_table.items() for rule, holds in some.items()]

    @register(name, " UNION ALL ".join(parts))
    def query(spark: SparkSession, folder: str) -> DataFrame:
        """Rules of one class with the rows that break them; each table is read once for all its rules."""
        found = [rules.rule_counts(table(spark, folder, of), [rules.Rule(rule, F.expr(in_engine(holds, "regexp_like"))) for rule, holds in some.items()]) for of, some in by_table.items()]
        return reduce(DataFrame.union, found)


for _name, _rules in ROW_RULES.items():
    row_query(_name, _rules)


@register(
    "rules_unique",
    "SELECT 'line_of_order' AS rule_id, count(*) AS n_broken FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'turn_of_conversation', count(*) FROM (SELECT 1 FROM conversations GROUP BY conv_id, turn HAVING count(*) > 1) UNION ALL SELECT 'text', count(*) FROM (SELECT 1 FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)",
)
def rules_unique(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that stand more than once. Whole texts are told apart by their digests."""
    digests = table(spark, folder, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("text"))
    keys = {
        "line_of_order": rules.duplicates(table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber"),
        "turn_of_conversation": rules.duplicates(table(spark, folder, "conversations"), "conv_id", "turn"),
        "text": rules.duplicates(digests, "text"),
    }
    return reduce(DataFrame.union, [rows.agg(F.lit(rule).alias("rule_id"), F.count("*").alias("n_broken")) for rule, rows in keys.items()])


REFERENCES = [
    ("order_of_line", "lineitem", "l_orderkey", "orders", "o_orderkey", "o_orderstatus <> 'P'"),
    ("part_of_line", "lineitem", "l_partkey", "part", "p_partkey", "p_size > 5"),
    ("customer_of_order", "orders", "o_custkey", "customer", "c_custkey", "c_acctbal > 0"),
    ("document_of_label", "labels", "doc_id", "documents", "doc_id", "lang <> 'en'"),
]


@register(
    "rules_reference",
    " UNION ALL ".join(f"SELECT '{rule}' AS rule_id, count(*) AS n_broken FROM {of} a WHERE a.{column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {to} b WHERE b.{key} = a.{column} AND {valid})" for rule, of, column, to, key, valid in REFERENCES),
)
def rules_reference(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that refer to a row which is not there or not valid."""
    found = []
    for rule, of, column, to, key, valid in REFERENCES:
        missing = rules.missing_references(table(spark, folder, of), column, table(spark, folder, to).where(valid), key)
        found.append(missing.agg(F.lit(rule).alias("rule_id"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_broken")))
    return reduce(DataFrame.union, found)


#: rule: table, group, what must hold of each group.
GROUP_RULES = {
    "two_reviewers": ("orders", "o_custkey", "count(DISTINCT o_orderpriority) >= 2"),
    "all_buckets": ("lineitem", "l_partkey", "count(DISTINCT l_returnflag) = 3"),
    "one_status": ("orders", "o_custkey", "min(o_orderstatus) = max(o_orderstatus)"),
    "within_total": ("lineitem", "l_suppkey", "sum(l_quantity) <= 17000"),
    "reserved_share": ("lineitem", "l_suppkey", "sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) * 3 >= sum(l_quantity)"),
    "no_gap": ("conversations", "conv_id", "max(turn) - min(turn) + 1 = count(DISTINCT turn)"),
    "starts_at_zero": ("conversations", "conv_id", "min(turn) = 0"),
}


@register(
    "rules_group",
    " UNION ALL ".join(f"SELECT '{rule}' AS rule_id, count(*) AS n_groups, count(*) FILTER (WHERE NOT coalesce(ok, false)) AS n_broken FROM (SELECT {group}, {holds} AS ok FROM {of} GROUP BY {group})" for rule, (of, group, holds) in GROUP_RULES.items()),
)
def rules_group(spark: SparkSession, folder: str) -> DataFrame:
    """Rules on counts, sums and extremes of groups: reviews, coverage, totals, reservations, numbering."""
    by_group: dict[tuple[str, str], dict] = {}
    for rule, (of, group, holds) in GROUP_RULES.items():
        by_group.setdefault((of, group), {})[rule] = F.expr(holds)
    found = [rules.group_counts(table(spark, folder, of), group, holds) for (of, group), holds in by_group.items()]
    return reduce(DataFrame.union, found)


@register(
    "rules_frozen",
    """WITH n AS (SELECT l_suppkey, sum(l_linenumber) AS x, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, sum(l_linenumber) AS x, count(*) AS n FROM lineitem WHERE l_suppkey % 5 <> 1 OR l_orderkey <> 7 GROUP BY 1)
SELECT n.l_suppkey, CASE WHEN b.l_suppkey IS NULL THEN 'no baseline' WHEN n.x = b.x AND n.n = b.n THEN 'frozen' WHEN n.l_suppkey % 2 = 0 THEN 'amended' ELSE 'changed without amendment' END AS status FROM n LEFT JOIN b ON n.l_suppkey = b.l_suppkey""",
)
def rules_frozen(spark: SparkSession, folder: str) -> DataFrame:
    """Artefacts whose digest differs from the frozen one; a change needs an amendment."""
    rows = table(spark, folder, "lineitem")
    amended = table(spark, folder, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return rules.frozen(rows, rows.where("l_suppkey % 5 <> 1 OR l_orderkey <> 7"), amended, "l_suppkey", F.struct("l_orderkey", "l_linenumber"))


@register(
    "rules_gate",
    """WITH g AS (SELECT c_custkey, bool_and(coalesce(o_totalprice > 10000, false)) AS a, count(*) FILTER (WHERE o_orderstatus = 'P') = 0 AS b, count(o_orderkey) >= 3 AS c FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)
SELECT CASE WHEN a AND b AND c THEN 'pass' ELSE concat_ws('+', CASE WHEN NOT a THEN 'present' END, CASE WHEN NOT b THEN 'resolved' END, CASE WHEN NOT c THEN 'complete' END) END AS gate, count(*) AS n FROM g GROUP BY 1""",
)
def rules_gate(spark: SparkSession, folder: str) -> DataFrame:
    """A gate is the conjunction of its checks; the ones that fail are all named."""
    joined = table(spark, folder, "customer").join(table(spark, folder, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    checks = {"present": F.bool_and(F.coalesce(F.col("o_totalprice") > 10000, F.lit(False))), "resolved": F.count_if(F.col("o_orderstatus") == "P") == 0, "complete": F.count("o_orderkey") >= 3}
    found = joined.groupBy("c_custkey").agg(*[holds.alias(name) for name, holds in checks.items()])
    return found.groupBy(rules.gate(*checks).alias("gate")).agg(F.count("*").alias("n"))
