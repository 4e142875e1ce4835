"""Building and guarding question/answer data: contamination, manifests, ownership, links, quotas, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.functions.text import words


SALTS = 64
#: Phrases up to this number and these bytes travel to every task; beyond it words and texts are shuffled.
BROADCAST_PHRASES, BROADCAST_BYTES = 50_000, 32 << 20


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters."""
    chars = F.split(text, "")
    pairs = F.zip_with(chars, F.slice(chars, 2, F.size(chars)), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(F.zip_with(pairs, F.slice(chars, 3, F.size(chars)), lambda a, b: F.concat(a, b)), lambda x: x.isNotNull()))


def contains_pairs(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """text_id, phrase_id where the text holds the phrase. texts: text_id, text; phrases: phrase_id, phrase.

    A phrase can only stand in a text that has its longest inner word; that word is the join key, so the pairs that
    meet are few, and ``contains`` decides. If the phrases are few a text's words meet them where the text is read, and neither
    words nor texts are shuffled. A phrase of fewer than three words has no inner word: its first three characters are the key
    (its first character, if it has fewer). An empty phrase stands nowhere.
    """
    phrases = phrases.where("phrase != ''")
    inner = F.slice(words(F.col("phrase")), 2, F.greatest(F.size(words(F.col("phrase"))) - 2, F.lit(0)))
    # the longest word, first of equals
    longest = F.aggregate(inner, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    kind = F.when(longest != "", "word").when(F.char_length("phrase") >= 3, "trigram").otherwise("character")
    key = F.when(longest != "", longest).when(F.char_length("phrase") >= 3, F.substring("phrase", 1, 3)).otherwise(F.substring("phrase", 1, 1))
    keyed = phrases.withColumns({"key": key, "kind": kind})
    found = {row["kind"]: row for row in keyed.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.octet_length("phrase")).alias("bytes")).collect()}
    few = sum(row["n"] for row in found.values()) <= BROADCAST_PHRASES and sum(row["bytes"] for row in found.values()) <= BROADCAST_BYTES
    keys = {"word": F.array_distinct(words(F.col("text"))), "trigram": trigrams(F.col("text")), "character": F.array_distinct(F.split("text", ""))}

    def met(kind: str) -> DataFrame:
        each, own = F.explode(keys[kind]).alias("key"), keyed.where(F.col("kind") == kind)
        if few:
            hits = texts.select("text_id", "text", each).join(F.broadcast(own), "key")
        else:
            near = texts.select("text_id", each).join(own.select("phrase_id", "key"), "key").select("text_id", "phrase_id").distinct()
            hits = near.join(phrases, "phrase_id").join(texts, "text_id")
        return hits.where(F.contains("text", "phrase")).select("text_id", "phrase_id")

    met_by = [met(kind) for kind in keys if kind in found] or [met("word")]
    return reduce(DataFrame.union, met_by).distinct()


def leave_out(records: DataFrame, bundle: DataFrame, group: str, record: str) -> DataFrame:
    """group, n_left, digest: all records without the group's own bundle. The digest is order-free and needs no list of ids.

    Sums of 60-bit leading parts of SHA-256 over all records, minus those of the bundle: no group ever holds all ids.
    """
    part = F.conv(F.substring(F.sha2(F.col(record).cast("string"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    total = records.select(record).distinct().agg(F.count("*").alias("n_all"), F.sum(part).alias("s_all"))
    own = bundle.select(group, record).distinct().groupBy(group).agg(F.count("*").alias("n_own"), F.sum(part).alias("s_own"))
    both = own.crossJoin(F.broadcast(total))  # the total is one row
    return both.select(group, (F.col("n_all") - F.col("n_own")).alias("n_left"), (F.col("s_all") - F.col("s_own")).cast("string").alias("digest"))


def owners(links: DataFrame, record: str, group: str) -> DataFrame:
    """record, owner (its first group), n_groups: both readings of a record that several groups claim."""
    return links.groupBy(record).agg(F.min(group).alias("owner"), F.count_distinct(group).alias("n_groups"))


def exclusion_gate(cells: DataFrame, threshold: float) -> DataFrame:
    """fact, n_directions, worst accuracy, verdict. cells: fact, direction, correct (null: not answered)."""
    by_direction = cells.groupBy("fact", "direction").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count_if(F.col("correct").isNull()).alias("missing"))
    found = by_direction.groupBy("fact").agg(F.count("*").alias("n_directions"), F.sum("missing").alias("missing"), F.max("accuracy").alias("worst"))
    verdict = F.when(F.col("missing") > 0, "incomplete").when(F.col("worst") > threshold, "excluded_known").otherwise("pass")
    return found.select("fact", "n_directions", "worst", verdict.alias("verdict"))


def eligible(facts: DataFrame, gates: DataFrame, audits: DataFrame) -> DataFrame:
    """fact, eligible: exactly one gate row, a pass, and audits that are all clean."""
    g = gates.groupBy("fact").agg(F.count("*").alias("n"), F.bool_and(F.col("verdict") == "pass").alias("ok"))
    a = audits.groupBy("fact").agg(F.bool_and(F.col("verdict") == "clean").alias("clean"))
    joined = facts.join(g, "fact", "left").join(a, "fact", "left")
    return joined.select("fact", (F.coalesce(F.col("n") == 1, F.lit(False)) & F.coalesce("ok", F.lit(False)) & F.coalesce("clean", F.lit(False))).alias("eligible"))


def link_counts(facts: DataFrame) -> DataFrame:
    """fact, n_subject, n_relation, n_links: other facts that share the subject, the relation, or either.

    Counts need no pairs: those of either are subject + relation - both. They are combined before the shuffle and joined back,
    so no task holds the facts of a frequent subject. A null subject or relation is shared by none but nulls.
    """
    both = facts.groupBy("subject", "relation").agg(F.count("*").alias("n_both"))
    by = lambda key, name: both.groupBy(F.col(key).alias(f"_{key}")).agg(F.sum("n_both").alias(name))
    same = lambda key: F.col(key).eqNullSafe(F.col(f"_{key}"))
    counts = both.join(by("subject", "n_s"), same("subject")).join(by("relation", "n_r"), same("relation"))
    counts = counts.select(F.col("subject").alias("_s"), F.col("relation").alias("_r"), "n_s", "n_r", "n_both")
    counted = facts.join(counts, F.col("subject").eqNullSafe(F.col("_s")) & F.col("relation").eqNullSafe(F.col("_r")))
    others = {"n_subject": F.col("n_s"), "n_relation": F.col("n_r"), "n_links": F.col("n_s") + F.col("n_r") - F.col("n_both")}
    return counted.select("fact", *[(n - 1).alias(name) for name, n in others.items()])


def same_subject(facts: DataFrame, index: DataFrame) -> DataFrame:
    """subject, fact, number of each indexed fact within its subject, from 0."""
    held = facts.join(index, "fact", "left_semi")
    return held.select("subject", "fact", (F.row_number().over(Window.partitionBy("subject").orderBy("fact")) - 1).alias("number"))


def bucket_coverage(items: DataFrame, buckets: DataFrame, least: int) -> DataFrame:
    """bucket, n, enough for each declared bucket; a bucket without items counts 0."""
    found = items.groupBy("bucket").agg(F.count("*").alias("n"))
    return buckets.select("bucket").distinct().join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n")).withColumn("enough", F.col("n") >= least)


def stratified(rows: DataFrame, category: str, order: Column, limit: int) -> DataFrame:
    """``limit`` rows dealt evenly over categories: the floor to each, the rest one by one to the largest; at least 1 each.

    A category's rows are ranked in SALTS parts first, and only the leading ones of each part meet.
    """
    sizes = rows.groupBy(category).agg(F.count("*").alias("size"))
    k = F.count("*").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.col("size").desc(), F.col(category)))
    dealt = sizes.select(F.col(category), F.greatest(F.lit(1), F.floor(F.lit(limit) / k) + (rank <= F.lit(limit) % k).cast("int")).alias("quota"))
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).alias("_part")
    leading = rows.withColumn("_part", part).join(F.broadcast(dealt), category)  # a row for each category
    leading = leading.withColumn("place", F.row_number().over(Window.partitionBy(category, "_part").orderBy(order))).where("place <= quota")
    placed = leading.withColumn("place", F.row_number().over(Window.partitionBy(category).orderBy(order)))
    return placed.where("place <= quota").drop("quota", "_part")


def turns(conversation: DataFrame) -> DataFrame:
    """conv_id, turn, question, answer: each user turn with the assistant's turn right after it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    following = conversation.withColumn("next_role", F.lead("role").over(order)).withColumn("answer", F.lead("text").over(order))
    return following.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def coverage_matrix(rows: DataFrame, row: str, column: str, columns: list[str]) -> DataFrame:
    """Counts with a declared column list, so that absent ones appear."""
    counts = [F.count_if(F.col(column) == c).alias(c.lower()) for c in columns]
    return rows.groupBy(row).agg(*counts)
