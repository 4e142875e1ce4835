"""Templates, surfaces, ids, question/answer texts, model answers and digests over ``part``, ``customer``, ``conversations`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.functions import text
from lethe.registry import register
from lethe.sources.tables import table

TEMPLATES = {"direct": "What kind is the {name}?", "inverse": "Which {type} thing is by {brand}?", "cloze": "The {name} by {brand} is ____.", "verify": "Is the {name} of size {size}?"}


@register(
    "templates_filled",
    "SELECT p_partkey, family, replace(replace(replace(replace(template, '{name}', p_name), '{type}', p_type), '{brand}', p_brand), '{size}', CAST(p_size AS VARCHAR)) AS prompt FROM part, (VALUES "
    + ", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items()) + ") t(family, template)",
)
def templates_filled(spark: SparkSession, folder: str) -> DataFrame:
    """Each fact in each template; the templates travel inside the rows."""
    some = F.array(*[F.struct(F.lit(k).alias("family"), F.lit(v).alias("template")) for k, v in TEMPLATES.items()])
    rows = table(spark, folder, "part").select("*", F.inline(some))
    values = {"name": F.col("p_name"), "type": F.col("p_type"), "brand": F.col("p_brand"), "size": F.col("p_size").cast("string")}
    return rows.select("p_partkey", "family", text.filled(F.col("template"), **values).alias("prompt"))


@register(
    "surfaces_removed",
    """WITH t AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS x, list_distinct(list_concat(string_split(p_name, ' '), [p_type, 'Brand'])) AS s FROM part)
SELECT p_partkey, list_reduce(list_prepend(x, list_transform(list_sort(list_transform(s, lambda v: {'n': -length(v), 'v': v})), lambda e: e.v)), lambda a, v: replace(a, v, '')) AS left_over FROM t""",
)
def surfaces_removed(spark: SparkSession, folder: str) -> DataFrame:
    surfaces = F.concat(F.split("p_name", " "), F.array(F.col("p_type"), F.lit("Brand")))
    rows = table(spark, folder, "part")
    return rows.select("p_partkey", text.without_surfaces(F.concat_ws(" ", "p_name", "p_type", "p_brand"), surfaces).alias("left_over"))


@register("plain_letters", "SELECT conv_id, turn, md5(strip_accents(text)) AS digest FROM conversations")
def plain_letters(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select("conv_id", "turn", F.md5(text.without_diacritics(F.col("text"))).alias("digest"))


@register(
    "id_parts",
    r"""WITH t AS (SELECT c_custkey, 'c:' || lower(c_mktsegment) || ':' || c_name || CASE WHEN c_custkey % 3 = 0 THEN ':' || c_nationkey ELSE '' END AS id, 'job_' || lower(c_mktsegment) || '_1e-' || c_custkey % 7 || '-seed' || c_nationkey AS job FROM customer)
SELECT c_custkey, regexp_extract(id, '^[^:]*:[^:]*:(.*)$', 1) AS local, string_split(id, ':')[-1] AS last, regexp_extract(job, '^job_(.*1e-[0-9]*)-', 1) AS short FROM t""",
)
def id_parts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer")
    tail = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(":"), F.col("c_nationkey"))).otherwise("")
    full = F.concat(F.lit("c:"), F.lower("c_mktsegment"), F.lit(":"), F.col("c_name"), tail)
    job = F.concat(F.lit("job_"), F.lower("c_mktsegment"), F.lit("_1e-"), F.col("c_custkey") % 7, F.lit("-seed"), F.col("c_nationkey"))
    return rows.select("c_custkey", text.local_id(full).alias("local"), text.last_segment(full).alias("last"), text.short_name(job, "job_").alias("short"))


LINES_SQL = """l AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Q: ' WHEN 'assistant' THEN 'A: ' ELSE 'S: ' END || regexp_replace(string_split(text, chr(10))[1], '[ \\t]+$', '') AS value FROM conversations WHERE text IS NOT NULL)"""


@register(
    "qa_text_parsed",
    f"""WITH {LINES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, value) AS line, lead(value) OVER (PARTITION BY conv_id ORDER BY turn, value) AS next FROM l),
q AS (SELECT *, line - row_number() OVER (PARTITION BY conv_id ORDER BY line) AS run FROM n WHERE starts_with(value, 'Q: ')),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY line) AS nth FROM q)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY line) - 1 AS number, substr(value, 4) AS question, CASE WHEN starts_with(next, 'A: ') THEN substr(next, 4) ELSE '' END AS answer FROM k WHERE nth % 2 = 1""",
)
def qa_text_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations written as question/answer text (first lines only) and parsed again."""
    rows = table(spark, folder, "conversations").where("text IS NOT NULL")
    mark = F.when(F.col("role") == "user", "Q: ").when(F.col("role") == "assistant", "A: ").otherwise("S: ")
    line = F.concat(mark, F.rtrim(F.split("text", "\n")[0], F.lit(" \t")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    written = rows.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))
    return text.qa_pairs_of(written, "conv_id", "text")


@register(
    "answers_parsed",
    """WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '[' || props || ',' || props || ']' WHEN 1 THEN '[' || props || ']' WHEN 2 THEN NULL WHEN 3 THEN '[' || props || ']' ELSE NULL END AS x FROM events)
SELECT event_id, CAST(coalesce(json_array_length(x), 0) AS BIGINT) AS n_items, CAST(json_extract(x, '$[0].k') AS BIGINT) AS first_k, event_id % 5 <> 2 AND event_id % 5 <> 4 AS parsed FROM t""",
)
def answers_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Answers that hold a fenced array, an object, no JSON, an array inside prose, or a broken one."""
    props = F.col("props")
    kind = F.col("event_id") % 5
    raw = (
        F.when(kind == 0, F.concat(F.lit("```json\n["), props, F.lit(","), props, F.lit("]\n```")))
        .when(kind == 1, props)
        .when(kind == 2, F.lit("Sorry, none."))
        .when(kind == 3, F.concat(F.lit("Here: ["), props, F.lit("] as asked")))
        .otherwise(F.concat(F.lit("["), props, F.lit(", {")))
    )
    part = text.json_part(raw)
    whole = F.when(part.startswith("{"), F.concat(F.lit("["), part, F.lit("]"))).otherwise(part)
    items = F.when(F.try_parse_json(whole).isNotNull(), F.from_json(whole, "array<struct<k:bigint>>"))
    rows = table(spark, folder, "events").select("event_id", items.alias("items"))
    return rows.select("event_id", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.get("items", F.lit(0))["k"].alias("first_k"), F.col("items").isNotNull().alias("parsed"))


@register("names_redacted", "SELECT c_custkey, replace('Dear ' || c_name || ', yours ' || lower(c_name), c_name, '[redacted]') AS letter FROM customer")
def names_redacted(spark: SparkSession, folder: str) -> DataFrame:
    letter = F.concat(F.lit("Dear "), F.col("c_name"), F.lit(", yours "), F.lower("c_name"))
    return table(spark, folder, "customer").select("c_custkey", F.replace(letter, F.col("c_name"), F.lit("[redacted]")).alias("letter"))


@register(
    "record_ids",
    "SELECT o_orderkey, printf('%s_%05d_%s_%s', lower(o_orderstatus), o_orderkey % 4000, CASE WHEN o_custkey % 2 = 0 THEN 'fwd' ELSE 'inv' END, CAST(o_custkey AS VARCHAR)) AS record_id, (o_orderkey % 4000) // 20 * 20 AS block_start, (o_orderkey % 4000) // 20 * 20 + 19 AS block_end FROM orders",
)
def record_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Padded ids, and the block of twenty rows that the row number behind the first mark lies in."""
    direction = F.when(F.col("o_custkey") % 2 == 0, "fwd").otherwise("inv")
    made = F.format_string("%s_%05d_%s_%s", F.lower("o_orderstatus"), F.col("o_orderkey") % 4000, direction, F.col("o_custkey").cast("string"))
    rows = table(spark, folder, "orders").select("o_orderkey", made.alias("record_id"))
    start = (F.floor(F.regexp_extract("record_id", r"^[^_]*_(\d{5})_", 1).cast("long") / 20) * 20).cast("long")
    return rows.select("*", start.alias("block_start"), (start + 19).alias("block_end"))


@register(
    "answer_leaks",
    """WITH t AS (SELECT conv_id, turn, role, text, regexp_extract(text, '[^ ]+$') AS answer FROM conversations)
SELECT conv_id, turn, length(answer) > 3 AND contains(lower(text[:-length(answer)-1]), lower(answer)) AND role <> 'assistant' AS leaks FROM t WHERE text IS NOT NULL""",
)
def answer_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Whether what stands before a turn's last word gives that word away; answering turns may."""
    answer = F.regexp_extract("text", "[^ ]+$", 0)
    before = F.substring(F.col("text"), F.lit(1), F.char_length("text") - F.char_length(answer))
    leaks = (F.char_length(answer) > 3) & F.contains(F.lower(before), F.lower(answer)) & (F.col("role") != "assistant")
    return table(spark, folder, "conversations").where("text IS NOT NULL").select("conv_id", "turn", leaks.alias("leaks"))


_PART_JSON = "'{\"brand\":\"' || p_brand || '\",\"name\":\"' || p_name || '\",\"size\":' || p_size || '}'"


@register(
    "canonical_hashes",
    f"""SELECT p_partkey, sha256({_PART_JSON}) AS identity, sha256('["' || p_brand || '","' || p_name || '","' || p_type || '","' || p_size || '"]') AS request_key,
sha256({_PART_JSON}) = sha256('{{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || (p_size + p_partkey % 2) || '}}') AS bound FROM part""",
)
def canonical_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of a record's fields in key order, of a request's four parts, and whether a record is bound to a stored digest."""
    rows = table(spark, folder, "part")
    own = text.identity(name=F.col("p_name"), brand=F.col("p_brand"), size=F.col("p_size"))
    stored = text.identity(size=(F.col("p_size") + F.col("p_partkey") % 2).cast("int"), brand=F.col("p_brand"), name=F.col("p_name"))
    request = F.sha2(F.to_json(F.array("p_brand", "p_name", "p_type", F.col("p_size").cast("string"))), 256)
    return rows.select("p_partkey", own.alias("identity"), request.alias("request_key"), (own == stored).alias("bound"))


@register(
    "reals_as_text",
    "SELECT event_id, CASE WHEN value IS NULL THEN 'NaN' WHEN event_id % 7 = 0 THEN NULL ELSE 'number' END AS kind, CASE WHEN value IS NULL OR event_id % 7 = 0 THEN NULL ELSE value END AS loaded FROM events",
)
def reals_as_text(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers written as text and read back; a missing one is NaN, one that was never there is null."""
    value = F.when(F.col("value").isNull(), F.lit(float("nan"))).when(F.col("event_id") % 7 != 0, F.col("value"))
    rows = table(spark, folder, "events").select("event_id", text.real_text(value).alias("t"))
    loaded = text.real_value(F.col("t"))
    return rows.select("event_id", F.when(F.col("t") == "NaN", "NaN").when(F.col("t").isNotNull(), "number").alias("kind"), F.when(~F.isnan(loaded), loaded).alias("loaded"))


FAMILIES = ["direct", "inverse", "cloze", "para", "verify"]


@register(
    "family_names",
    """WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' Direct ' WHEN 1 THEN 'INVERSE' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN 'Other' ELSE event_type END AS x FROM events)
SELECT event_id, coalesce(nullif(lower(trim(x)), ''), 'unknown') AS family, coalesce(lower(trim(x)) IN ('direct', 'inverse', 'cloze', 'para', 'verify'), false) AS canonical FROM t""",
)
def family_names(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_id") % 6
    raw = F.when(kind == 0, " Direct ").when(kind == 1, "INVERSE").when(kind == 2, "").when(kind == 3, F.lit(None)).when(kind == 4, "Other").otherwise(F.col("event_type"))
    name = F.coalesce(F.nullif(F.lower(F.trim(raw)), F.lit("")), F.lit("unknown"))
    return table(spark, folder, "events").select("event_id", name.alias("family"), name.isin(FAMILIES).alias("canonical"))


@register(
    "path_classes",
    r"""SELECT page_id, CASE WHEN regexp_matches(url, '[?&](ref|utm)') THEN 'tracked' WHEN regexp_matches(url, '/(en|fr|de|es)/') THEN 'localised' WHEN regexp_matches(url, '\.example\.') THEN 'example' ELSE 'other' END AS class,
regexp_matches(lower(url), 'token|secret|\.(pem|key)$') OR ends_with(url, '=x') AS credential FROM pages""",
)
def path_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The first rule that a path meets, and whether its name looks like a credential's."""
    url = F.col("url")
    kind = F.when(url.rlike("[?&](ref|utm)"), "tracked").when(url.rlike("/(en|fr|de|es)/"), "localised").when(url.rlike(r"\.example\."), "example").otherwise("other")
    credential = F.lower(url).rlike(r"token|secret|\.(pem|key)$") | url.endswith("=x")
    return table(spark, folder, "pages").select("page_id", kind.alias("class"), credential.alias("credential"))


@register(
    "alias_batches",
    """WITH t AS (SELECT c_nationkey AS entity, lower(c_mktsegment) AS alias, CASE c_custkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'xx' END AS language FROM customer)
SELECT DISTINCT entity, alias, language FROM t WHERE language IN ('en', 'de')""",
)
def alias_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of the form {entity: [{value, language}]}, one a nation: distinct aliases in the allowed languages."""
    language = F.when(F.col("c_custkey") % 3 == 0, "en").when(F.col("c_custkey") % 3 == 1, "de").otherwise("xx")
    rows = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.collect_set(F.struct(F.col("c_mktsegment").alias("value"), language.alias("language"))).alias("found"))
    raw = rows.select(F.to_json(F.create_map(F.col("c_nationkey").cast("string"), F.col("found"))).alias("raw"))
    parsed = raw.select(F.explode(F.from_json("raw", "map<string, array<struct<value: string, language: string>>>")).alias("entity", "items"))
    each = parsed.select(F.col("entity").cast("int").alias("entity"), F.inline("items")).select("entity", F.lower("value").alias("alias"), "language")
    return each.where(F.col("language").isin("en", "de")).dropDuplicates()
