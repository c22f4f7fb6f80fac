"""Findings of external scanners: severities, tallies, priorities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities by rank, and the tools whose names are brought to one form.
SEVERITIES = ("info", "low", "medium", "high", "error")
SOURCES = ("zizmor", "actionlint", "flowloom")
# Events that run with write tokens and secrets on foreign input, and scopes whose writing is sensitive.
RISKY_TRIGGERS = ("pull_request_target", "workflow_run")
SENSITIVE_SCOPES = ("contents", "id-token")


def rank_of(severity: Column) -> Column:
    return reduce(lambda out, k: F.when(severity == SEVERITIES[k], k).otherwise(out), range(len(SEVERITIES)), F.lit(None).cast("int"))


def label_of(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1)


def by_score(score: Column) -> Column:
    """A score from 0 to 10, as text; what is no number says nothing."""
    number = score.try_cast("double")
    return F.when(number >= 7, "high").when(number >= 4, "medium").when(number > 0, "low").when(number.isNotNull(), "info")


def by_rank(rank: Column) -> Column:
    return F.when(rank >= 80, "high").when(rank >= 50, "medium").when(rank > 0, "low").when(rank.isNotNull(), "info")


def by_name(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.isin("critical", "error"), "error").when(low.isin("high", "medium", "low"), low).when(low.isin("info", "informational", "note"), "info")


def by_level(level: Column) -> Column:
    return F.when(level == "error", "high").when(level == "warning", "medium").when(level == "note", "low").otherwise("info")


def recovered(scores: list[Column], rank: Column, names: list[Column], levels: list[Column]) -> Column:
    """The first that speaks: scores, the rank, named severities, levels (a warning if there is none)."""
    return F.coalesce(*map(by_score, scores), by_rank(rank), *map(by_name, names), by_level(F.coalesce(*levels, F.lit("warning"))))


def source_of(name: Column) -> Column:
    return F.when(F.lower(name).isin(*SOURCES), F.lower(name)).otherwise(name)


def finding_id(source: Column, rule: Column, path: Column, line: Column, column: Column) -> Column:
    uri = F.translate(F.regexp_replace(path, "^file://", ""), "\\", "/")
    return F.concat_ws(":", source, rule, *[F.coalesce(c.cast("string"), F.lit("?")) for c in (uri, line, column)])


def tally(severity: Column) -> list[Column]:
    return [F.count_if(severity == s).alias(s) for s in SEVERITIES]


def badge() -> Column:
    """The counts that aren't zero, the worst first, as E:1 H:2."""
    return F.concat_ws(" ", *[F.when(F.col(s) > 0, F.concat(F.lit(f"{s[0].upper()}:"), F.col(s))) for s in reversed(SEVERITIES)])


def priority(source: Column, demoted: Column, promoted: Column) -> Column:
    """The rank to act on: demotion to low at most, else promotion to high at least, else as found."""
    return F.when(demoted, F.least(source, F.lit(1))).when(promoted, F.greatest(source, F.lit(3))).otherwise(source)


def signals(events: Column, write_all: Column, write_scopes: Column, orphan: Column, fixtures: Column) -> Column:
    """What speaks for or against acting on a finding, in a fixed order: an array of struct(reason, detail).

    ``events`` are those that reach the node, sorted; unknown permissions say nothing.
    """
    kind = "array<struct<reason:string,detail:string>>"
    each = lambda reason, found: F.transform(found, lambda x: F.struct(F.lit(reason).alias("reason"), x.alias("detail")))
    one = lambda reason, said: F.when(F.coalesce(said, F.lit(False)), F.array(F.struct(F.lit(reason).alias("reason"), F.lit(None).cast("string").alias("detail")))).otherwise(F.array()).cast(kind)
    among = lambda found, known: F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda x: x.isin(*known))
    return F.concat(
        each("reachable_from_risky_trigger", among(events, RISKY_TRIGGERS)).cast(kind), one("write_all_available", write_all), each("sensitive_write_scope", among(write_scopes, SENSITIVE_SCOPES)).cast(kind), one("orphaned", orphan), one("under_test_fixtures", fixtures)
    )


def derived_priority(rank: Column, reasons: Column) -> Column:
    """The rank to act on by ``signals``: orphans and fixtures demote, all others promote."""
    demotes = F.exists(reasons, lambda r: r["reason"].isin("orphaned", "under_test_fixtures"))
    return priority(rank, demotes, F.size(reasons) > 0)


def colour(worst: Column) -> Column:
    return F.when(worst >= 3, "red").when(worst == 2, "amber").otherwise("grey")
