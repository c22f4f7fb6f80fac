"""The browsable graph of an estate: all nodes and edges, what findings add to them, and the details of a node.

Ids are ``wf:<path>``, ``la:<folder>``, ``ea:<owner>/<repository>[/<folder>]@<ref>``,
``ew:<owner>/<repository>/<path>@<ref>`` and ``dk:<image>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.lineage import cut
from flowloom.functions.ranks import numbered
from flowloom.operators import findings, graph, questions
from flowloom.sources.estate import Estate

# How ids of each kind of node begin.
PREFIXES = {"workflow": "wf:", "local-action": "la:", "external-action": "ea:", "external-workflow": "ew:", "docker": "dk:"}


def _prefix(kind: Column) -> Column:
    return F.element_at(F.create_map(*map(F.lit, (x for pair in PREFIXES.items() for x in pair))), kind)


def _ends(edges: DataFrame) -> DataFrame:
    """The edges with ``end_kind`` and ``end_name``, what the node that each leads to is and is called."""
    kind = F.when(F.col("dst_kind") == "local-workflow", "workflow").otherwise(F.col("dst_kind"))
    name = F.concat("dst", F.coalesce(F.concat(F.lit("@"), F.when(kind != "docker", F.col("dst_ref"))), F.lit("")))
    return edges.withColumn("end_kind", kind).withColumn("end_name", name)


def nodes(estate: Estate) -> DataFrame:
    """All workflows and actions, reached or not, and every external action, external workflow and image that something names: id, label, kind."""
    own = estate.workflows.select(F.lit("workflow").alias("kind"), F.col("wf_id").alias("n"), "name")
    own = own.unionByName(estate.actions.select(F.lit("local-action").alias("kind"), F.col("act_id").alias("n"), "name"))
    named_ = own.select(F.concat(_prefix(F.col("kind")), "n").alias("id"), F.coalesce("name", "n").alias("label"), "kind")
    other = _ends(estate.edges).where(F.col("end_kind").isin("external-action", "external-workflow", "docker")).select("end_kind", "end_name").distinct()
    return named_.unionByName(other.select(F.concat(_prefix(F.col("end_kind")), "end_name").alias("id"), F.col("end_name").alias("label"), F.col("end_kind").alias("kind")))


def edges(estate: Estate) -> DataFrame:
    """All edges between nodes: pos (from 0, in the estate's order, those of workflows first), source, target, kind.

    Kinds: annotation, calls-workflow, uses-local-workflow, uses-local-action,
    uses-external-action, uses-docker. What leads to a workflow or action that isn't
    there is left out (``questions.wiring`` tells those); several edges between two nodes stay several.
    """
    kind = (
        F.when(F.col("tier") == 0, "annotation").when(F.col("edge_kind") == "call", "calls-workflow")
        .when(F.col("end_kind") == "workflow", "uses-local-workflow").otherwise(F.concat(F.lit("uses-"), "end_kind"))
    )
    of_flow = F.col("src_kind") == "workflow"
    listed = _ends(estate.edges).where("dst_kind <> 'unresolved'").select(
        F.when(of_flow, 0).otherwise(1).alias("rank"), "src", "edge_ord", F.concat(F.when(of_flow, "wf:").otherwise("la:"), "src").alias("source"), F.concat(_prefix(F.col("end_kind")), "end_name").alias("target"), kind.alias("kind")
    )
    known = listed.join(nodes(estate).select(F.col("id").alias("target")), "target", "left_semi")
    return numbered(known, ["rank", "src", "edge_ord"], "pos").select("pos", "source", "target", "kind")


def dangerous(links: DataFrame, risky: DataFrame, found: DataFrame) -> DataFrame:
    """``links`` (source, target) with on_dangerous_path: if one of the nodes ``risky`` (node) reaches its source, and its target reaches one of ``found`` (node).

    Nodes reach themselves. Two closures; no ways are listed.
    """
    pairs = links.select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()
    down = graph.closure(pairs, risky).select(F.col("node").alias("source"), F.lit(True).alias("_down")).distinct()
    up = graph.closure(graph.reversed_(pairs), found).select(F.col("node").alias("target"), F.lit(True).alias("_up")).distinct()
    both = links.join(down, "source", "left").join(up, "target", "left")
    return both.select(*links.columns, F.coalesce(F.col("_down") & F.col("_up"), F.lit(False)).alias("on_dangerous_path"))


def overlaid(estate: Estate, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with what ``found`` (findings with path, start_line, severity, source) add to them.

    Nodes: counts by severity as found and ``total`` (0 without findings), reachable_from_risky,
    is_orphan, has_write (any of the node's findings says so) and sources, sorted. Edges:
    on_dangerous_path, from an entry with a risky trigger to a node with findings.
    """
    rich = cut(questions.enrich(estate, found).where("node is not null"))
    is_flow = F.col("node").startswith("workflow:")
    bare = F.expr("substring(node, instr(node, ':') + 1)")
    said = lambda c: F.coalesce(F.max(c), F.lit(False))
    write = F.col("permission_context.write_all") | F.arrays_overlap("permission_context.write_scopes", F.array(*map(F.lit, findings.SENSITIVE_SCOPES)))
    risky = F.arrays_overlap("reachable_from", F.array(*map(F.lit, findings.RISKY_TRIGGERS)))
    by_node = rich.groupBy(F.concat(F.when(is_flow, "wf:").otherwise("la:"), bare).alias("id")).agg(
        *findings.tally(F.col("severity")), F.count("severity").alias("total"), said(risky).alias("reachable_from_risky"), said(F.col("is_orphan")).alias("is_orphan"), said(write).alias("has_write"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )
    by_node = cut(by_node)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in (*findings.SEVERITIES, "total")]
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("reachable_from_risky", "is_orphan", "has_write")]
    out = nodes(estate).join(by_node, "id", "left").select("id", "label", "kind", *counts, *flags, F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))
    entry = estate.triggers.where(F.col("is_entry") & F.col("event").isin(*findings.RISKY_TRIGGERS)).select(F.concat(F.lit("wf:"), "wf_id").alias("node")).distinct()
    return out, dangerous(cut(edges(estate)), entry, by_node.select(F.col("id").alias("node")))


def details(estate: Estate) -> DataFrame:
    """Of each workflow, action and external action: id, kind, label, file, summary, entry_triggers, if_conditions.

    entry_triggers are the events in the file's order; if_conditions structs of job_id,
    step_index (from 1), step_id, step_name and expression, a job's before its steps'; null where they don't apply.
    """
    none = F.lit(None).cast("string")
    cond = lambda job, index, id_, name, expr: F.struct(job.alias("job_id"), index.cast("int").alias("step_index"), id_.alias("step_id"), name.alias("step_name"), expr.alias("expression"))
    of_job = estate.jobs.where("`if` is not null").select(F.concat(F.lit("wf:"), "wf_id").alias("id"), "job_ord", F.lit(-1).alias("step_ord"), cond(F.col("job_id"), F.lit(None), none, none, F.col("`if`")).alias("c"))
    owner = F.concat(F.when(F.col("owner_kind") == "workflow", "wf:").otherwise("la:"), "owner_id")
    of_step = estate.steps.where("`if` is not null").select(owner.alias("id"), "job_ord", "step_ord", cond(F.col("job_id"), F.col("step_ord") + 1, F.col("id"), F.col("name"), F.col("`if`")).alias("c"))
    conditions = of_job.unionByName(of_step).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("job_ord", "step_ord", "c")))["c"].alias("if_conditions"))
    started = estate.triggers.groupBy(F.concat(F.lit("wf:"), "wf_id").alias("id")).agg(
        F.count(F.lit(1)).alias("triggers"), F.array_sort(F.collect_list(F.when(F.col("is_entry"), F.struct("trig_ord", "event"))))["event"].alias("entry_triggers")
    )
    jobs = estate.jobs.groupBy(F.concat(F.lit("wf:"), "wf_id").alias("id")).agg(F.count(F.lit(1)).alias("jobs"))
    steps = estate.steps.where("owner_kind = 'action'").groupBy(F.concat(F.lit("la:"), "owner_id").alias("id")).agg(F.count(F.lit(1)).alias("steps"))
    files = estate.workflows.select(F.concat(F.lit("wf:"), "wf_id").alias("id"), F.col("wf_id").alias("file"), none.alias("act_kind"))
    files = files.unionByName(estate.actions.select(F.concat(F.lit("la:"), "act_id").alias("id"), "file", F.when(F.col("kind") == "node", "javascript").otherwise(F.col("kind")).alias("act_kind")))
    all_ = nodes(estate).where("kind in ('workflow', 'local-action', 'external-action')")
    for more in (files, started, jobs, steps, conditions):
        all_ = all_.join(more, "id", "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    repository = F.concat(F.substring_index(F.substring_index("label", "@", 1), "/", 2), F.lit("@"), F.regexp_extract("label", "@(.*)$", 1))
    summary = (
        F.when(F.col("kind") == "workflow", F.format_string("%d job(s), %d trigger(s)", count("jobs"), count("triggers")))
        .when(F.col("kind") == "local-action", F.format_string("%s; %d step(s)", "act_kind", count("steps"))).otherwise(repository)
    )
    empty = F.array().cast("array<string>")
    kind = "array<struct<job_id:string,step_index:int,step_id:string,step_name:string,expression:string>>"
    return all_.select("id", "kind", "label", F.coalesce("file", F.lit("")).alias("file"), summary.alias("summary"), F.coalesce("entry_triggers", empty).alias("entry_triggers"), F.coalesce("if_conditions", F.array().cast(kind)).alias("if_conditions"))
