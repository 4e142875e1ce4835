"""Requests of evaluation arms (the events of each user) against budgets and a cache, their raw lines, and replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.operators import gateway
from lethe.registry import register
from lethe.sources.tables import table

POLICIES = gateway.Policies(hit=gateway.Policy(observed=True, rule="zero_new_compute"), failure=gateway.Policy(observed=True, rule="charged"))
PERMITTED = 20

#: Requests, then one row of each arm after the other with what its arm has spent, stored and opened so far.
RUN_SQL = f"""x AS (SELECT CAST(user_id AS VARCHAR) AS arm, event_id AS seq, event_type AS channel, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events),
e AS (SELECT arm, seq, channel, CASE channel WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS c, CASE WHEN channel <> 'error' THEN {PERMITTED} END AS permitted,
  CASE WHEN k % 3 = 0 THEN 'score' ELSE 'generate' END AS kind, 'p' || k % 4 AS probe, CASE WHEN k % 3 = 0 THEN 's' ELSE 'g' END || k % 4 || 'i' || seq % 2 AS key, 1 + k % 3 AS trials,
  value < 5 AS failed, k % 11 = 0 AS damaged, row_number() OVER (PARTITION BY arm ORDER BY seq) AS i, 'm' || k % 2 AS name, value FROM x),
t AS (SELECT DISTINCT arm, 0::BIGINT AS i, 0::BIGINT AS seq, [0, 0, 0, 0]::BIGINT[] AS used, MAP {{}}::MAP(VARCHAR, BIGINT) AS held, 0::BIGINT AS line, NULL::VARCHAR AS open, ''::VARCHAR AS event,
    0::BIGINT AS charged, 0::BIGINT AS computed, 0::BIGINT AS generated, 0::BIGINT AS scored, 0::BIGINT AS remaining, 0::BIGINT AS number, NULL::BIGINT AS source FROM e
  UNION ALL
  SELECT arm, i, seq, list_transform(used, lambda u, j: u + CASE WHEN j = c THEN charged ELSE 0 END), CASE WHEN event IN ('miss', 'corrupt') THEN map_concat(held, MAP {{key: seq}}) ELSE held END,
    line + CASE WHEN generated > 0 THEN 1 ELSE 0 END, CASE WHEN event = 'unknown_channel' THEN open WHEN generated > 0 THEN probe WHEN probe = open THEN open END,
    event, charged, CASE WHEN event = 'hit' THEN 0 ELSE charged END, generated, CASE WHEN kind = 'score' AND event IN ('miss', 'corrupt') THEN trials ELSE 0 END, room - charged,
    CASE WHEN generated > 0 THEN line + 1 WHEN kind = 'score' AND event IN ('miss', 'corrupt', 'hit') AND probe = open THEN line ELSE 0 END,
    CASE WHEN event IN ('miss', 'corrupt') THEN seq WHEN event = 'hit' THEN src END
  FROM (SELECT *, CASE WHEN event = 'hit' OR kind = 'generate' AND event IN ('miss', 'corrupt', 'failure') THEN trials ELSE 0 END AS charged, CASE WHEN kind = 'generate' AND event IN ('miss', 'corrupt') THEN trials ELSE 0 END AS generated
    FROM (SELECT *, CASE WHEN permitted IS NULL THEN 'unknown_channel' WHEN src IS NOT NULL AND NOT damaged THEN CASE WHEN trials > room THEN 'refused' ELSE 'hit' END
        WHEN kind = 'generate' AND trials > room THEN 'refused' WHEN failed THEN 'failure' WHEN src IS NULL THEN 'miss' ELSE 'corrupt' END AS event
      FROM (SELECT e.*, t.used, t.held, t.line, t.open, t.held[e.key] AS src, e.permitted - t.used[e.c] AS room FROM t JOIN e ON e.arm = t.arm AND e.i = t.i + 1)))),
o AS (SELECT t.arm, t.seq, e.channel, e.kind, e.probe, t.event, t.charged, t.computed, t.generated, t.scored, t.remaining, t.number AS line, t.source,
    CASE WHEN e.kind = 'generate' AND t.source IS NOT NULL THEN 'a' || t.source END AS completion, CASE WHEN e.kind = 'score' THEN s.name END AS name, CASE WHEN e.kind = 'score' THEN s.value END AS value
  FROM t JOIN e USING (arm, seq) LEFT JOIN e s ON s.arm = t.arm AND s.seq = t.source WHERE t.i > 0)"""
LINES_SQL = """m AS (SELECT arm, line, name, max_by(value, seq) AS value FROM o WHERE kind = 'score' AND line > 0 AND name IS NOT NULL GROUP BY ALL),
r AS (SELECT arm, line, seq, channel, probe, completion, (SELECT value FROM m WHERE m.arm = o.arm AND m.line = o.line AND name = 'm0') AS m0, (SELECT value FROM m WHERE m.arm = o.arm AND m.line = o.line AND name = 'm1') AS m1 FROM o WHERE generated > 0)"""


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Events as requests: arms are users, channels event types; one channel is not in the budget."""
    k, seq, value = F.get_json_object("props", "$.k").cast("long"), F.col("event_id"), F.col("value")
    score, failed = k % 3 == 0, value < 5
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("arm"),
        seq.alias("seq"),
        F.col("event_type").alias("channel"),
        F.when(F.col("event_type") != "error", F.lit(PERMITTED).cast("long")).alias("permitted"),
        F.when(score, "score").otherwise("generate").alias("kind"),
        F.concat(F.lit("p"), k % 4).alias("probe"),
        F.concat(F.lit("i"), seq % 2).alias("input"),
        (1 + k % 3).alias("trials"),
        F.when(~failed, F.concat(F.lit("a"), seq)).alias("answer"),
        F.when(~failed, F.create_map(F.concat(F.lit("m"), k % 2), value)).alias("scores"),
        (k % 11 == 0).alias("damaged"),
    )


@register("gateway_requests", f"WITH RECURSIVE {RUN_SQL} SELECT arm, seq, event, charged, computed, generated, scored, remaining, line, source, completion, value FROM o")
def gateway_requests(spark: SparkSession, folder: str) -> DataFrame:
    """What became of each request: hit, miss, corrupt, failure, refused or unknown channel, and what it cost."""
    found = gateway.run(requests(spark, folder), POLICIES)
    columns = ["arm", "seq", "event", "charged", "computed", "generated", "scored", "remaining", "line", "source", "completion"]
    return found.select(*columns, F.map_values("scores")[0].alias("value"))


@register("gateway_raw_lines", f"WITH RECURSIVE {RUN_SQL}, {LINES_SQL} SELECT * FROM r")
def gateway_raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Generations that were made, each with the scores taken while its line was open."""
    lines = gateway.raw_lines(gateway.run(requests(spark, folder), POLICIES))
    return lines.select("arm", "line", "seq", "channel", "probe", "completion", F.col("scores")["m0"].alias("m0"), F.col("scores")["m1"].alias("m1"))


@register(
    "gateway_budgets",
    f"""WITH RECURSIVE {RUN_SQL}, p AS (SELECT DISTINCT arm, channel FROM e WHERE permitted IS NOT NULL)
SELECT arm, channel, {PERMITTED}::BIGINT AS permitted, sum(charged)::BIGINT AS charged, sum(computed)::BIGINT AS computed, count(*) FILTER (WHERE event = 'refused') AS refused, {PERMITTED} - sum(charged)::BIGINT AS remaining
FROM p JOIN o USING (arm, channel) GROUP BY arm, channel""",
)
def gateway_budgets(spark: SparkSession, folder: str) -> DataFrame:
    """The cost record of each arm and channel."""
    asked = requests(spark, folder)
    permitted = asked.where("permitted IS NOT NULL").groupBy("arm", "channel").agg(F.first("permitted").alias("permitted"))
    return gateway.budget_records(gateway.run(asked, POLICIES), permitted)


@register(
    "gateway_replay",
    f"""WITH RECURSIVE {RUN_SQL}, {LINES_SQL}
SELECT e.arm, e.seq, CASE WHEN coalesce(s.line, y.line) IS NULL THEN 'missing' ELSE 'replayed' END AS event, 0::BIGINT AS charged, CASE WHEN kind = 'generate' THEN coalesce(s.completion, y.completion) END AS completion,
  CASE WHEN kind = 'score' THEN CASE WHEN s.line IS NOT NULL THEN s.m0 ELSE y.m0 END END AS m0
FROM e LEFT JOIN (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY arm, probe, channel ORDER BY line) = 1) s ON s.arm = e.arm AND s.probe = e.probe AND s.channel = e.channel
LEFT JOIN (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY arm, probe ORDER BY line) = 1) y ON y.arm = e.arm AND y.probe = e.probe""",
)
def gateway_replay(spark: SparkSession, folder: str) -> DataFrame:
    """The same requests answered from stored lines, at no charge."""
    asked = requests(spark, folder)
    found = gateway.replay(asked, gateway.raw_lines(gateway.run(asked, POLICIES)))
    return found.select("arm", "seq", "event", "charged", "completion", F.col("scores")["m0"].alias("m0"))
