"""Requests of evaluation arms against budgets and a cache; raw lines; replay of stored lines.

A request: arm, seq (its place among the arm's requests), channel, permitted (trials of the arm's channel; null: it has no such channel), kind
('generate' or 'score'), probe, input (all that the answer depends on besides kind), trials, answer (null: transport failure),
scores map<string, double>, damaged (the stored answer no longer has its digest).

What a request costs depends on every earlier one of its arm: it may be answered from the cache only if an earlier one was within
budget and did not fail. ``run`` folds each arm's sorted requests in one pass; ``lethe.streaming.requests`` keeps the same state over a stream.
Only generations need to be remembered in the fold, at most as many as their channels permit: scores are not budgeted, so the first of
equal ones fills the cache, which a grouped minimum finds beforehand.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.operators.state import fold

OUTCOME = "event string, charged long, computed long, generated long, scored long, remaining long, line long, source long"
COLUMNS = ["arm", "seq", "channel", "permitted", "kind", "probe", "key", "trials", "failed", "damaged", "known"]


@dataclass(frozen=True)
class Policy:
    """What a cache hit or a failed transport costs, as times its trials."""

    observed: bool = False
    rule: str = "zero_new_compute"

    def __post_init__(self) -> None:
        if self.rule not in ("charged", "zero_new_compute", "separately_reported"):
            raise ValueError(f"charge rule {self.rule}")

    def cost(self, trials: int) -> tuple[int, int]:
        """Charged observations and new compute."""
        return trials * self.observed, trials * (self.rule == "charged")


@dataclass(frozen=True)
class Policies:
    hit: Policy = field(default_factory=Policy)
    failure: Policy = field(default_factory=lambda: Policy(True, "charged"))


class Book(Protocol):
    """State of one arm: trials spent by channel, what the cache holds (the request that made each answer), the open raw line."""

    def spent(self, channel: str) -> int: ...

    def spend(self, channel: str, trials: int) -> None: ...

    def source(self, key: str) -> int | None: ...

    def store(self, key: str, source: int) -> None: ...

    def line(self) -> tuple[int, str | None]: ...

    def open_line(self, number: int, probe: str | None) -> None: ...


class HeldBook:
    """A book in memory."""

    def __init__(self) -> None:
        self._spent: dict[str, int] = {}
        self._sources: dict[str, int] = {}
        self._line: tuple[int, str | None] = (0, None)

    def spent(self, channel: str) -> int:
        return self._spent.get(channel, 0)

    def spend(self, channel: str, trials: int) -> None:
        self._spent[channel] = self.spent(channel) + trials

    def source(self, key: str) -> int | None:
        return self._sources.get(key)

    def store(self, key: str, source: int) -> None:
        self._sources[key] = source

    def line(self) -> tuple[int, str | None]:
        return self._line

    def open_line(self, number: int, probe: str | None) -> None:
        self._line = number, probe


def settle(book: Book, policies: Policies, seq, channel, permitted, kind, probe, key, trials, failed, damaged, known) -> tuple:  # noqa: ANN001
    """OUTCOME of one request. known: the request that filled the cache for a score, if that has been found out before; -1: none."""
    if permitted is None:
        return "unknown_channel", 0, 0, 0, 0, None, 0, None
    score, number = kind == "score", 0
    source = book.source(key) if known is None else None if known < 0 else known
    left = permitted - book.spent(channel)
    line, line_probe = book.line()
    charged = computed = generated = scored = 0
    if source is not None and not damaged:
        event, (charged, computed) = "hit", policies.hit.cost(trials)
        if charged > left:
            event, charged, computed, source = "refused", 0, 0, None
    elif not score and trials > left:
        event, source = "refused", None
    elif failed:
        event, source = "failure", None
        charged, computed = (0, 0) if score else policies.failure.cost(trials)
    else:
        event, source = "miss" if source is None else "corrupt", seq
        if known is None:
            book.store(key, seq)
        if score:
            scored = max(trials, 1)
        else:
            charged = computed = generated = trials
            number = line + 1
    if charged:
        book.spend(channel, charged)
    if number:
        book.open_line(number, probe)
    elif probe == line_probe and line_probe is not None:
        number = line if score and event in ("miss", "corrupt", "hit") else 0
    elif line_probe is not None:
        book.open_line(line, None)  # another probe: the line is closed
    return event, charged, computed, generated, scored, left - charged, number, source


def cache_key() -> Column:
    return F.sha2(F.to_json(F.struct("kind", "probe", "input")), 256)


def prepared(requests: DataFrame) -> DataFrame:
    """With key (what the cache is asked for) and failed (no answer came)."""
    failed = F.when(F.col("kind") == "score", F.col("scores").isNull()).otherwise(F.col("answer").isNull())
    return requests.withColumns({"key": cache_key(), "failed": failed})


def run(requests: DataFrame, policies: Policies = Policies()) -> DataFrame:
    """arm, seq, channel, kind, probe and OUTCOME of every request, with completion and scores: those of the request that ``source`` names."""
    asked = prepared(requests)
    scores = asked.where("kind = 'score' AND permitted IS NOT NULL AND NOT failed")
    first = scores.groupBy("arm", "key").agg(F.min("seq").alias("first"))
    # a damaged answer is made anew, so a later hit reads the newest one
    renewed = scores.where("damaged").select("arm", "key", F.col("seq").alias("anew"))
    known = asked.where("kind = 'score'").join(first, ["arm", "key"], "left")
    known = known.withColumn("known", F.when(F.col("seq") > F.col("first"), F.col("first")).otherwise(-1))
    newest = known.select("arm", "key", "seq").join(renewed, ["arm", "key"]).where("anew < seq").groupBy("arm", "key", "seq").agg(F.max("anew").alias("anew"))
    known = known.join(newest, ["arm", "key", "seq"], "left").withColumn("known", F.when(F.col("known") >= 0, F.greatest("known", F.coalesce("anew", F.lit(-1)))).otherwise(-1))
    rows = asked.where("kind != 'score'").withColumn("known", F.lit(None).cast("long")).select(COLUMNS).union(known.select(COLUMNS))

    def step(book, arm, seq, channel, permitted, kind, probe, key, trials, failed, damaged, known):  # noqa: ANN001, ANN202
        book = book or HeldBook()
        return book, (arm, seq, channel, kind, probe, *settle(book, policies, seq, channel, permitted, kind, probe, key, trials, failed, damaged, known))

    found = fold(rows, "arm", ["seq"], None, step, f"arm string, seq long, channel string, kind string, probe string, {OUTCOME}")
    answers = requests.select(F.col("arm").alias("_arm"), F.col("seq").alias("_seq"), F.when(F.col("kind") != "score", F.col("answer")).alias("completion"), F.when(F.col("kind") == "score", F.col("scores")).alias("scores"))
    return found.join(answers, (F.col("arm") == F.col("_arm")) & (F.col("source") == F.col("_seq")), "left").drop("_arm", "_seq")


def raw_lines(results: DataFrame) -> DataFrame:
    """arm, line, seq, channel, probe, completion, scores: a line for each generation that was made, with the scores taken while it was open.

    Of scores of one name the latest stays.
    """
    made = results.where("generated > 0").select("arm", "line", "seq", "channel", "probe", "completion")
    each = results.where("kind = 'score' AND line > 0").select("arm", "line", "seq", F.explode("scores").alias("name", "value"))
    latest = each.groupBy("arm", "line", "name").agg(F.max_by("value", "seq").alias("value"))
    named = latest.groupBy("arm", "line").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("scores"))  # the names of one line
    none = F.create_map().cast("map<string, double>")
    return made.join(named, ["arm", "line"], "left").withColumn("scores", F.coalesce("scores", none))


def budget_records(results: DataFrame, permitted: DataFrame) -> DataFrame:
    """arm, channel, permitted, charged, computed, refused, remaining of every channel that an arm has. permitted: arm, channel, permitted."""
    spent = results.where("event != 'unknown_channel'").groupBy("arm", "channel").agg(F.sum("charged").alias("charged"), F.sum("computed").alias("computed"), F.count_if(F.col("event") == "refused").alias("refused"))
    zero = {name: F.coalesce(name, F.lit(0).cast("long")) for name in ("charged", "computed", "refused")}
    return permitted.join(spent, ["arm", "channel"], "left").withColumns(zero).withColumn("remaining", F.col("permitted") - F.col("charged"))


def replay(requests: DataFrame, lines: DataFrame) -> DataFrame:
    """arm, seq, channel, probe, event, charged, completion, scores: answers from stored lines alone; nothing is charged, whatever they cost.

    The first line of the same probe and channel, else the first of the probe, else event 'missing'. lines: as ``raw_lines`` gives them.
    """
    content = F.struct("completion", "scores")
    exact = lines.groupBy(F.col("arm").alias("_arm"), F.col("probe").alias("_probe"), F.col("channel").alias("_channel")).agg(F.min_by(content, "line").alias("same"))
    any_channel = lines.groupBy(F.col("arm").alias("_arm2"), F.col("probe").alias("_probe2")).agg(F.min_by(content, "line").alias("other"))
    joined = requests.join(exact, (F.col("arm") == F.col("_arm")) & (F.col("probe") == F.col("_probe")) & (F.col("channel") == F.col("_channel")), "left")
    joined = joined.join(any_channel, (F.col("arm") == F.col("_arm2")) & (F.col("probe") == F.col("_probe2")), "left")
    found, score = F.coalesce("same", "other"), F.col("kind") == "score"
    return joined.select(
        "arm", "seq", "channel", "probe",
        F.when(found.isNull(), "missing").otherwise("replayed").alias("event"),
        F.lit(0).cast("long").alias("charged"),
        F.when(~score, found["completion"]).alias("completion"),
        F.when(score, found["scores"]).alias("scores"),
    )
