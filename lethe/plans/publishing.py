"""Tables published together, migrated by steps, and stored by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.plans.scores import r, rounded
from lethe.registry import register
from lethe.sources import artifacts, publishing
from lethe.sources.tables import table
from lethe.storage import new_folder


def lost_lines(tables: publishing.Tables) -> DataFrame:
    """Lines of unknown orders, and orders without a price."""
    lost = tables["lines"].join(tables["orders"], F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.lit("lines").alias("table"), F.lit("unknown order").alias("fault"), F.count("*").alias("n"))
    free = tables["orders"].agg(F.lit("orders").alias("table"), F.lit("no price").alias("fault"), F.count_if(~F.coalesce(F.col("o_totalprice") > 0, F.lit(False))).alias("n"))
    return lost.union(free)


@register(
    "published_tables",
    f"""SELECT 'orders' AS name, count(*) AS n, {r('sum(o_totalprice)', 'total')}, 2 AS place FROM orders UNION ALL
SELECT 'lines', count(*), {r('sum(l_extendedprice)', 'total')}, 2 FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""",
)
def published_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and their lines as readers see them after a first version, one that was turned down for its lost lines, and a second one."""
    root = new_folder(spark, "published")
    publishing.init(spark, root)
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_extendedprice")
    known = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    publishing.publish({"orders": orders, "lines": known.where("l_orderkey % 2 = 0")}, root, lost_lines)
    try:
        publishing.publish({"orders": orders.where("o_orderkey % 2 = 0"), "lines": known}, root, lost_lines)
        raise AssertionError("lines without their orders were published")
    except publishing.PublishError:
        pass
    publishing.publish({"orders": orders, "lines": known}, root, lost_lines)
    seen, place = publishing.published(spark, root), publishing.current(spark, root)["place"]
    total = {"orders": "o_totalprice", "lines": "l_extendedprice"}
    counted = [seen[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(price).alias("total"), F.lit(place).alias("place")) for name, price in total.items()]
    return rounded(counted[0].union(counted[1]))


@register(
    "migrated_tables",
    f"""SELECT p_brand AS brand, count(*) AS n, {r('sum(p_retailprice)', 'total')}, 2 AS schema_version, 'part' AS kind FROM part GROUP BY p_brand""",
)
def migrated_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Parts stored at schema version 0 and read at 2: one step adds a column, one derives a table; steps are not applied again."""
    root = new_folder(spark, "migrated")
    publishing.init(spark, root)
    publishing.publish({"parts": table(spark, folder, "part").select("p_partkey", "p_brand", "p_retailprice")}, root)

    def with_kind(tables: publishing.Tables) -> publishing.Tables:
        return tables | {"parts": tables["parts"].withColumn("kind", F.lit("part"))}

    def with_brands(tables: publishing.Tables) -> publishing.Tables:
        brands = tables["parts"].groupBy(F.col("p_brand").alias("brand"), "kind").agg(F.count("*").alias("n"), F.sum("p_retailprice").alias("total"))
        return tables | {"brands": brands}

    publishing.migrate(spark, root, [with_kind])
    publishing.migrate(spark, root, [with_kind, with_brands])
    publishing.migrate(spark, root, [with_kind, with_brands])
    version = publishing.current(spark, root)["schema_version"]
    return rounded(publishing.published(spark, root)["brands"].select("brand", "n", "total", F.lit(version).alias("schema_version"), "kind"))


@register(
    "artifact_store",
    """WITH a AS (SELECT CASE WHEN source IS NULL THEN 'temporary' WHEN lang = 'en' THEN 'result' ELSE 'score' END AS class, 'run' || doc_id % 7 AS run, 'doc' || doc_id AS name, coalesce(text, '') AS content FROM documents),
f AS (SELECT 'sha256:' || sha256(content) AS digest, class, min(struct_pack(run, name)) AS first, CAST(octet_length(encode(any_value(content))) AS BIGINT) AS size FROM a WHERE class <> 'temporary' GROUP BY ALL)
SELECT digest, class, first.run AS run, first.name AS name, size FROM f""",
)
def artifact_store(spark: SparkSession, folder: str) -> DataFrame:
    """Texts stored by content, twice over, and read back by class and digest: each content once, with the first run that registered it."""
    root = new_folder(spark, "artifacts")
    artifacts.init(spark, root)
    kind = F.when(F.col("source").isNull(), "temporary").when(F.col("lang") == "en", "result").otherwise("score")
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = table(spark, folder, "documents").select(kind.alias("class"), F.concat(F.lit("run"), F.col("doc_id") % 7).alias("run"), F.concat(F.lit("doc"), "doc_id").alias("name"), content.alias("content"))
    artifacts.write(rows, root)
    artifacts.write(rows.where("run < 'run3'"), root)
    wanted = artifacts.register(spark, root).select("class", "digest")
    return artifacts.resolve(wanted, root).select("digest", "class", "run", "name", F.octet_length("content").cast("long").alias("size"))
