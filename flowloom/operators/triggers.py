"""Trigger declarations: grouping and seed selection.

``decl`` has a row for each declared trigger: wf_id, trig_ord, event, types (null if none
are declared), ref_kind (none, include, exclude), patterns, is_entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions import globs

# The activity types of each event that has a closed set of them.
ACTIVITIES = {
    "branch_protection_rule": "created edited deleted",
    "check_run": "created rerequested completed requested_action",
    "check_suite": "completed",
    "discussion": "created edited deleted transferred pinned unpinned labeled unlabeled locked unlocked category_changed answered unanswered",
    "discussion_comment": "created edited deleted",
    "issue_comment": "created edited deleted",
    "issues": "opened edited deleted transferred pinned unpinned closed reopened assigned unassigned labeled unlabeled locked unlocked milestoned demilestoned typed untyped",
    "label": "created edited deleted",
    "merge_group": "checks_requested",
    "milestone": "created closed opened edited deleted",
    "pull_request": "assigned unassigned labeled unlabeled opened edited closed reopened synchronize converted_to_draft locked unlocked enqueued dequeued milestoned demilestoned"
    " ready_for_review review_requested review_request_removed auto_merge_enabled auto_merge_disabled",
    "pull_request_review": "submitted edited dismissed",
    "pull_request_review_comment": "created edited deleted",
    "registry_package": "published updated",
    "release": "published unpublished created edited deleted prereleased released",
    "watch": "started",
    "workflow_run": "completed requested in_progress",
}
ACTIVITIES["pull_request_target"] = ACTIVITIES["pull_request"]
# The activity types that events without ``types`` start on, where that isn't all of them.
DEFAULTS = {"pull_request": "opened synchronize reopened", "pull_request_target": "opened synchronize reopened"}


def _looked_up(event: Column, table: dict[str, str]) -> Column:
    found = F.lit(None).cast("array<string>")
    for name, values in table.items():
        found = F.when(event == name, F.array(*map(F.lit, values.split()))).otherwise(found)
    return found


def allowed_types(event: Column) -> Column:
    """The activity types that an event has; null if there is no closed set."""
    return _looked_up(event, ACTIVITIES)


def default_types(event: Column) -> Column:
    """The activity types that an event without ``types`` starts on; null if it is all."""
    return _looked_up(event, DEFAULTS)


def summary(decl: DataFrame, examples: int = 3) -> DataFrame:
    """Per event: distinct entry workflows, declarations, typed and filtered ones, first example ids.

    The examples come from ranks over distinct pairs, so no event gathers all its ids.
    """
    name = F.col("wf_id").cast("string")
    rank = F.row_number().over(Window.partitionBy("event").orderBy("wf"))
    first = decl.where("is_entry").select("event", name.alias("wf")).distinct().withColumn("rank", rank).where(F.col("rank") <= examples)
    top = first.groupBy("event").agg(F.sort_array(F.collect_list("wf")).alias("examples"))
    counts = decl.groupBy("event").agg(
        F.countDistinct(F.when(F.col("is_entry"), F.col("wf_id"))).alias("entry_workflows"),
        F.count(F.lit(1)).alias("declarations"),
        F.count_if(F.col("types").isNotNull()).alias("typed"),
        F.count_if(F.col("ref_kind") != "none").alias("filtered"),
    )
    return counts.join(top, "event", "left").orderBy(F.desc("entry_workflows"), "event")


def accepts_activity(types: Column, defaults: Column, wanted: list[str]) -> Column:
    """Declared types must hold one that is wanted; without any the event's default ones must; without those all pass."""
    known = F.coalesce(types, defaults)
    return F.coalesce(F.arrays_overlap(known, F.array(*map(F.lit, wanted))), F.size(known).isNull() | known.isNull())


def accepts_refs(branches: list[str], tags: list[str], paths: list[str]) -> Column:
    """If a trigger's filters (columns event, branches, tags, paths, each a struct of kind and patterns) let an event
    through that has one of the branches, one of the tags and one of the paths; an empty list asks nothing.

    A push is of branches or of tags: with a filter of one kind only, pushes of the other
    don't start anything. Paths alone mean a push of a branch, and for pushes of tags
    alone paths aren't looked at.
    """
    lets = lambda column, values: globs.accepted(F.array(*map(F.lit, values)), F.col(f"{column}.kind"), F.col(f"{column}.patterns")) if values else F.lit(True)
    push, has = F.col("event") == "push", lambda column: F.col(f"{column}.kind") != "none"
    of_branch = F.lit(bool(branches or (paths and not tags)))
    other_kind = (push & of_branch & ~has("branches") & has("tags")) | (push & F.lit(bool(tags)) & ~has("tags") & has("branches"))
    no_paths = push & F.lit(bool(tags) and not branches)
    return ~other_kind & lets("branches", branches) & lets("tags", tags) & (no_paths | lets("paths", paths))


def types_kind(types: Column, event: Column) -> Column:
    """How a trigger's activity types come about: explicit, implicit-default, implicit-all, or null for events without any."""
    open_ended = allowed_types(event).isNotNull() | (event == "repository_dispatch")
    return F.when(types.isNotNull(), "explicit").when(default_types(event).isNotNull(), "implicit-default").when(open_ended, "implicit-all")


def types_line(types: Column, event: Column) -> Column:
    """What a trace says about an entry's activity types; null if there is nothing to say."""
    kind = types_kind(types, event)
    listed = F.concat(F.lit("types: "), F.array_join(F.coalesce(types, default_types(event)), ", "))
    return F.when(kind == "explicit", listed).when(kind == "implicit-default", F.concat(listed, F.lit(" (default)"))).when(kind == "implicit-all", "types: any")


def first_match(decl: DataFrame, condition: Column) -> DataFrame:
    """Of each workflow, the first declaration in order that meets a condition."""
    rank = F.row_number().over(Window.partitionBy("wf_id").orderBy("trig_ord"))
    return decl.where(condition).withColumn("rank", rank).where("rank = 1").drop("rank")


def only_called(decl: DataFrame) -> DataFrame:
    """Workflows with a call-only trigger and no other."""
    return decl.groupBy("wf_id").agg(F.bool_or("is_entry").alias("entry"), F.bool_or(~F.col("is_entry")).alias("called")).where("called and not entry").select("wf_id")


def shown_types(types: Column, defaults: Column) -> Column:
    """How activity types are shown: declared ones, the event's default ones, or all."""
    return F.when(types.isNotNull(), F.array_join(types, ", ")).when(defaults.isNotNull(), F.concat(F.lit("default: "), F.array_join(defaults, ", "))).otherwise("all")
