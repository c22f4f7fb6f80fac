"""Permission audits. A permission set is an array of levels by scope: 0 none, 1 read, 2 write; null is undeclared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.lineage import cut
from flowloom.operators import graph
from flowloom.sources.yaml_text import LINE

SMALL_LEVEL = 50_000  # states that are sent to the calls, which then stay where they are

# The scopes of a token.
SCOPES = (
    "actions artifact-metadata attestations checks contents deployments discussions id-token issues models packages pages pull-requests repository-projects security-events statuses vulnerability-alerts"
).split()


def normalised(coarse: Column, scopes: Column) -> Column:
    """A declaration as levels: a coarse word for all scopes, an unknown one for none, or a map with none for what it lacks."""
    whole = F.when(coarse == "write-all", 2).when(coarse == "read-all", 1).otherwise(0)
    level = lambda name: F.when(scopes[name] == "write", 2).when(scopes[name] == "read", 1).otherwise(0)
    return F.when(coarse.isNotNull(), F.array(*[whole for _ in SCOPES])).when(scopes.isNotNull(), F.array(*[level(s) for s in SCOPES]))


def effective(job: Column, workflow: Column) -> Column:
    return F.coalesce(job, workflow)


def declared(declaration: Column) -> tuple[Column, Column]:
    """The coarse word and the scopes of an estate's declaration (the text, or JSON of the map, of ``permissions``), as ``normalised`` takes them."""
    is_map = declaration.startswith("{")
    scopes = F.map_filter(F.from_json(declaration, "map<string,string>"), lambda scope, _: scope != LINE)
    return F.when(~is_map, declaration), F.when(is_map, scopes)


def problems(declaration: Column) -> Column:
    """What is unknown in an estate's declaration, sorted: the coarse word, scopes, or levels."""
    coarse, scopes = declared(declaration)
    known = coarse.isin("read-all", "write-all")
    name = F.filter(F.map_keys(scopes), lambda scope: ~scope.isin(*SCOPES))
    level = F.filter(F.map_entries(scopes), lambda e: ~F.coalesce(e["value"].isin("read", "write", "none"), F.lit(False)))
    odd = F.concat(F.transform(name, lambda scope: F.concat(F.lit("unknown scope "), scope)), F.transform(level, lambda e: F.concat(F.lit("unknown level of "), e["key"])))
    return F.when(coarse.isNotNull() & ~known, F.array(F.concat(F.lit("unknown permissions "), coarse))).when(scopes.isNotNull(), F.array_sort(odd)).otherwise(F.array().cast("array<string>"))


def entry_findings(workflows: DataFrame, jobs: DataFrame, triggers: DataFrame) -> DataFrame:
    """Findings on an estate's entry workflows: kind, severity, wf_id, job_id (null: the workflow), jobs.

    ``write-all`` on the workflow or a job is too broad; a workflow without a declaration
    has the implicit default if some of its jobs, listed in their order, have none either.
    """
    entry = triggers.where("is_entry").select("wf_id").distinct()
    flows = workflows.join(entry, "wf_id", "left_semi").select("wf_id", "permissions")
    work = jobs.join(entry, "wf_id", "left_semi").select("wf_id", "job_ord", "job_id", "permissions")
    null, none = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    broad = flows.select("wf_id", null.alias("job_id"), "permissions").unionByName(work.select("wf_id", "job_id", "permissions")).where("permissions = 'write-all'")
    broad = broad.select(F.lit("OverlyBroad").alias("kind"), F.lit("high").alias("severity"), "wf_id", "job_id", none.alias("jobs"))
    undeclared = work.where("permissions is null").join(flows.where("permissions is null").select("wf_id"), "wf_id", "left_semi")
    listed = undeclared.groupBy("wf_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("job_ord", "job_id"))), lambda j: j["job_id"]).alias("jobs"))
    return broad.unionByName(listed.select(F.lit("ImplicitDefault").alias("kind"), F.lit("medium").alias("severity"), "wf_id", null.alias("job_id"), "jobs"))


def packed(levels: Column) -> Column:
    """Levels as bits, 00, 01 or 11 a scope, so that the lower levels of two sets are their AND; null stays null."""
    bits = lambda level: F.when(level == 2, 3).when(level == 1, 1).otherwise(0).cast("long")
    return F.aggregate(levels, F.lit(0).cast("long"), lambda all_, level: F.shiftleft(all_, 2).bitwiseOR(bits(level)))


def capped(cap: Column, layer: Column) -> Column:
    """The lower level of each scope of packed sets; an undeclared layer leaves the cap."""
    return cap.bitwiseAND(F.coalesce(layer, F.lit(-1).cast("long")))


def exceeding(declaration: Column, cap: Column) -> Column:
    """The bits in which a packed set goes beyond the cap; 0 if in none, or if it is undeclared."""
    return F.coalesce(declaration.bitwiseAND(F.bitwise_not(cap)), F.lit(0).cast("long"))


def scopes_of(bits: Column) -> Column:
    """The names of the scopes that have a bit, in the scopes' order."""
    last = len(SCOPES) - 1
    return F.array_compact(F.array(*[F.when(F.shiftrightunsigned(bits, 2 * (last - k)).bitwiseAND(F.lit(3).cast("long")) != 0, F.lit(s)) for k, s in enumerate(SCOPES)]))


def escalation_chains(calls: DataFrame, entries: DataFrame) -> DataFrame:
    """Callees that declare more than their callers may pass on: root, node, scopes, caller, chain (callers from the root on), key.

    ``calls``: src, dst, ord, wf and job (the callee's levels), and, where several nodes are jobs
    of one workflow, src_flow and dst_flow; ``entries``: node, cap (and flow); entries without a known
    cap are skipped. What is compared is the callee's effective level; what is passed on is
    the lower of both its layers. A way doesn't enter a workflow that it is in.

    A row for each root, node and set of scopes, with its shortest chain, the first in
    depth-first order of those. A level keeps a state once: root, node, cap and, on cycles, the
    workflows of the cycle that the way has been in; so ways that meet don't multiply. All calls
    are shuffled only for levels of more than SMALL_LEVEL states; smaller ones are broadcast.
    """
    flow = lambda df, name, node: F.col(name) if name in df.columns else F.col(node)
    known = entries.where("cap is not null").select("node", packed(F.col("cap")).alias("cap"), F.array(flow(entries, "flow", "node")).alias("around"))
    calls = calls.select("src", "dst", F.col("ord").cast("long").alias("ord"), packed(F.col("wf")).alias("wf"), packed(F.col("job")).alias("job"), flow(calls, "src_flow", "src").alias("src_flow"), flow(calls, "dst_flow", "dst").alias("dst_flow"))
    calls = cut(graph.with_knots(calls, "src_flow", "dst_flow").drop("src_flow"))
    node = calls.schema["src"].dataType.simpleString()
    level = known.select(F.col("node").alias("root"), "node", "cap", "around", F.array().cast("array<bigint>").alias("key"), F.array().cast(f"array<{node}>").alias("chain"))
    found, small = None, False  # entries are not counted
    while True:
        step = (F.broadcast(level) if small else level).withColumnRenamed("node", "src").join(calls, "src").where(~(F.col("within") & F.array_contains("around", F.col("dst_flow"))))
        around = F.when(F.col("within"), F.array_sort(F.concat("around", F.array("dst_flow")))).otherwise(F.array("dst_flow"))
        passed, more = capped(capped(F.col("cap"), F.col("wf")), F.col("job")), exceeding(effective(F.col("job"), F.col("wf")), F.col("cap"))
        step = cut(step.select("root", F.col("dst").alias("node"), "src", passed.alias("cap"), more.alias("more"), around.alias("around"), F.concat("key", F.array("ord")).alias("key"), F.concat("chain", F.array("src")).alias("chain")))
        states = step.count()
        if not states:
            break
        small = states <= SMALL_LEVEL  # there are no more in the next level
        hits = step.where("more <> 0").select("root", "node", "more", F.struct(F.size("chain").alias("n"), "key", F.col("src").alias("caller"), "chain").alias("way"))
        found = hits if found is None else found.unionByName(hits)
        level = step.groupBy("root", "node", "cap", "around").agg(F.min(F.struct("key", "chain")).alias("way")).select("root", "node", "cap", "around", "way.*")
    if found is None:
        found = step.select("root", "node", "more", F.struct(F.size("chain").alias("n"), "key", F.col("src").alias("caller"), "chain").alias("way"))
    first = found.groupBy("root", "node", "more").agg(F.min("way").alias("way"))
    return first.select("root", "node", scopes_of(F.col("more")).alias("scopes"), "way.caller", "way.chain", "way.key")


def escalations(calls: DataFrame, entries: DataFrame) -> DataFrame:
    """Of ``escalation_chains`` each root and node with the length of the shortest: root, node, chain."""
    return escalation_chains(calls, entries).groupBy("root", "node").agg(F.min(F.size("chain")).alias("chain"))
