"""The diagram of an estate: its lines in one global order, made on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.lineage import cut
from flowloom.functions.ranks import numbered
from flowloom.functions.text import escape_label
from flowloom.operators import graph
from flowloom.operators.questions import linked, named, run_links
from flowloom.sources.estate import Estate, docker_parts

# Events whose subgraphs come first, in this order; all others follow by name.
FIRST_EVENTS = ("push", "pull_request", "schedule", "workflow_dispatch", "workflow_run")
HEADER = ("%% generated by flowloom", "graph LR")
ANNOTATED = "classDef flowloomAnnotation stroke:#dca,stroke-dasharray:5 5"
ORDER = ["part", "a", "b", "c", "d"]


def _lines(df: DataFrame, part: int, line: Column, a: Column | None = None, b: Column | int = 0, c: Column | None = None, d: Column | None = None) -> DataFrame:
    """Lines with the columns that order them."""
    said = lambda x: F.lit("") if x is None else F.coalesce(x, F.lit(""))
    return df.select(F.lit(part).alias("part"), said(a).alias("a"), (F.lit(b) if isinstance(b, int) else b).alias("b"), said(c).alias("c"), said(d).alias("d"), line.alias("line"))


def _padded(n: str) -> Column:
    return F.lpad(F.col(n).cast("string"), 12, "0")


def _box(node_id: Column, label: Column) -> Column:
    return F.concat(node_id, F.lit('["'), label, F.lit('"]'))


def _externals(edges: DataFrame, kind: str, prefix: str) -> DataFrame:
    """Distinct external ends of a kind by their parts: node, id, n, label."""
    ends = edges.where(F.col("dst_kind") == kind).select("dst", "dst_ref").distinct()
    name = F.col("dst")
    if kind == "docker":
        image = docker_parts(name)
        keys = [image["host"], image["image"], image["tag"], F.lit(None).cast("string")]
    else:
        split = F.split(name, "/", 3)
        keys = [F.get(split, F.lit(0)), F.get(split, F.lit(1)), F.get(split, F.lit(2)), F.col("dst_ref")]
    label = F.concat(name, F.coalesce(F.concat(F.lit("@"), "dst_ref"), F.lit("")))
    parts = ends.select(named(F.lit(kind), label).alias("node"), label.alias("label"), *[k.alias(f"k{n}") for n, k in enumerate(keys)])
    return numbered(parts, ["k0", "k1", "k2", "k3"], "n").select("node", F.concat(F.lit(f"{prefix}_"), "n").alias("id"), "n", escape_label(F.col("label")).alias("label"))


def diagram(estate: Estate, event: str | None = None, overlay: DataFrame | None = None) -> DataFrame:
    """The lines of the diagram with their place: pos, line.

    Drawn is what the entry workflows (of one event, if given) reach: by event a subgraph
    with an alias for each of its workflows; workflows that something leads to, and those
    that are only called; actions, external actions, images, external workflows; comments
    on ends that don't exist; edges from aliases, called workflows and actions; edges of
    ``workflow_run``; dotted edges of annotations. ``overlay`` (node, badge, style) adds a badge to
    labels and a style line for each node that is drawn. An event that no entry has gives
    a comment in place of all that.
    """
    edges = cut(linked(estate.edges).join(estate.edges.select(named("src_kind", "src").alias("src"), F.col("edge_ord").alias("ord"), F.col("dst").alias("end"), F.col("dst_ref").alias("end_ref")), ["src", "ord"]).where("dst_kind <> 'unresolved'"))
    starts = estate.triggers.where("is_entry" if event is None else (F.col("event") == event) & F.col("is_entry")).select(named(F.lit("workflow"), "wf_id").alias("node"))
    reached = cut(graph.closure(edges, starts).select("node"))
    title = lambda key: F.concat(escape_label(F.col(key)), F.coalesce(F.concat(F.lit("<br/>"), escape_label(F.col("name"))), F.lit("")))
    flows = numbered(estate.workflows.select("wf_id", "name"), ["wf_id"], "n").select(named(F.lit("workflow"), "wf_id").alias("node"), F.concat(F.lit("wf_"), "n").alias("id"), title("wf_id").alias("label"))
    acts = numbered(estate.actions.select("act_id", "name"), ["act_id"], "n").select(named(F.lit("action"), "act_id").alias("node"), F.concat(F.lit("act_"), "n").alias("id"), title("act_id").alias("label"))
    if overlay is not None:
        badge = F.concat("label", F.coalesce(F.concat(F.lit("<br/>"), escape_label(F.nullif("badge", F.lit("")))), F.lit("")))
        flows, acts = (df.join(overlay, "node", "left").select("node", "id", badge.alias("label"), "style") for df in (flows, acts))
    flows, acts = cut(flows.join(reached, "node", "left_semi")), cut(acts.join(reached, "node", "left_semi"))
    spark = estate.workflows.sparkSession
    head = spark.createDataFrame(list(enumerate(HEADER)), "n int, line string")
    lines = [_lines(head, 0, F.col("line"), b=F.col("n"))]
    if event is not None and flows.isEmpty():
        none = spark.createDataFrame([(f"%% (no entry-point matches event {event})",)], "line string")
        return numbered(lines[0].unionByName(_lines(none, 1, F.col("line"))), ORDER, "pos").select("pos", "line")

    # Aliases by event.
    shown = estate.triggers.where("is_entry" if event is None else (F.col("event") == event) & F.col("is_entry")).select(named(F.lit("workflow"), "wf_id").alias("node"), "event", "upstream", "wf_id").join(flows, "node")
    event_id = F.regexp_replace("event", "[^A-Za-z0-9_]", "_")
    aliases = cut(shown.withColumn("alias", F.concat("id", F.lit("__"), event_id)))
    rank = F.concat(F.coalesce(*[F.when(F.col("event") == e, F.lit(str(k))) for k, e in enumerate(FIRST_EVENTS)], F.lit("9")), F.lit(" "), "event")
    groups = aliases.select("event").distinct()
    lines.append(_lines(groups, 2, F.concat(F.lit("subgraph "), event_id), rank, 0))
    lines.append(_lines(aliases, 2, F.concat(F.lit("  "), _box(F.col("alias"), F.col("label"))), rank, 1, F.col("alias")))
    lines.append(_lines(groups, 2, F.lit("end"), rank, 2))

    # Ends: what the edges of reached nodes lead to, by id.
    inside = cut(edges.join(reached.withColumnRenamed("node", "src"), "src", "left_semi"))
    ends = inside.select("dst_kind", F.col("end").alias("dst"), F.col("end_ref").alias("dst_ref"))
    every = edges.select("dst_kind", F.col("end").alias("dst"), F.col("end_ref").alias("dst_ref"))
    outer = [_externals(every, "external-action", "ext").join(reached, "node", "left_semi"), _externals(ends, "docker", "dock"), _externals(ends, "external-workflow", "extwf")]
    outer = [cut(df) for df in outer]
    ids = flows.select("node", "id").unionByName(acts.select("node", "id"))
    for df in outer:
        ids = ids.unionByName(df.select("node", "id"))
    to = cut(ids.select(F.col("node").alias("dst"), F.col("id").alias("to")))

    # Sources: aliases, workflows that are only called, actions.
    entry = estate.triggers.groupBy(named(F.lit("workflow"), "wf_id").alias("node")).agg(F.bool_or("is_entry").alias("entry"), F.bool_or(~F.col("is_entry")).alias("called"))
    called = flows.join(entry.where("called and not entry"), "node", "left_semi")
    sources = aliases.select(F.col("node").alias("src"), F.col("alias").alias("from")).unionByName(called.select(F.col("node").alias("src"), F.col("id").alias("from"))).unionByName(acts.select(F.col("node").alias("src"), F.col("id").alias("from")))
    drawn = cut(inside.join(sources, "src").join(to, "dst").select("from", "to", "tier", "edge_kind").distinct())

    # workflow_run: by the names waited for.
    waits = aliases.where("event = 'workflow_run'").select("wf_id", "alias").distinct()
    links = cut(run_links(estate).join(waits, "wf_id"))
    unknown = links.where("target is null").select("upstream").distinct()
    runs = links.where("target is not null").select(named(F.lit("workflow"), "target").alias("node"), "alias").join(flows.select("node", "id"), "node").select("node", F.col("id").alias("from"), F.col("alias").alias("to")).distinct()

    kinds = F.when(F.col("src_kind") == "action", F.col("tier") == 0).otherwise(True)
    led_to = inside.where("dst_kind = 'local-workflow'").where(kinds).select(F.col("dst").alias("node")).unionByName(called.select("node")).unionByName(runs.select("node")).distinct()
    canonical = cut(flows.join(led_to, "node", "left_semi"))
    lines.append(_lines(canonical, 3, _box(F.col("id"), F.col("label")), F.col("id")))
    lines.append(_lines(acts, 4, _box(F.col("id"), F.col("label")), F.col("id")))
    for k, df in enumerate(outer):
        lines.append(_lines(df, 5 + k, _box(F.col("id"), F.col("label")), _padded("n")))
    lines.append(_lines(unknown, 8, F.concat(F.lit("%% workflow_run unresolved: "), "upstream"), F.col("upstream")))
    known = estate.workflows.select(named(F.lit("workflow"), "wf_id").alias("dst")).unionByName(estate.actions.select(named(F.lit("action"), "act_id").alias("dst")))
    missing = inside.where("dst_kind like 'local-%'").join(known, "dst", "left_anti").select(F.concat("dst_kind", F.lit(": "), "end").alias("said")).distinct()
    lines.append(_lines(missing, 9, F.concat(F.lit("%% unresolved "), "said"), F.col("said")))

    plain = drawn.where("tier = 1").select("from", "to", F.lit(None).cast("string").alias("said")).unionByName(runs.select("from", "to", F.lit("workflow_run").alias("said"))).distinct()
    arrow = F.when(F.col("said").isNull(), F.lit(" --> ")).otherwise(F.concat(F.lit(" -->|"), "said", F.lit("| ")))
    lines.append(_lines(plain, 10, F.concat("from", arrow, "to"), F.col("from"), c=F.col("to"), d=F.col("said")))
    dotted = drawn.where("tier = 0").select("from", "to", "edge_kind").distinct()
    lines.append(_lines(dotted, 11, F.concat("from", F.lit(" -. "), "edge_kind", F.lit(" .-> "), "to"), F.col("from"), c=F.col("to"), d=F.col("edge_kind")))
    lines.append(_lines(dotted.limit(1), 12, F.lit(ANNOTATED)))
    if overlay is not None:
        styled = aliases.select(F.col("alias").alias("id"), "style").unionByName(canonical.select("id", "style")).unionByName(acts.select("id", "style")).where("style <> ''").distinct()
        lines.append(_lines(styled, 13, F.concat(F.lit("style "), "id", F.lit(" "), "style"), F.col("id"), c=F.col("style")))
    out = lines[0]
    for more in lines[1:]:
        out = out.unionByName(more)
    return numbered(out, ORDER, "pos").select("pos", "line")
