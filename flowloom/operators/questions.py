"""Questions on a loaded estate: its own tables in, a table of answers out.

Nodes are named ``workflow:<path>`` and ``action:<folder>``; other ends of edges by their
kind and id in the same way, so they never have edges of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions import jobs as fields
from flowloom.functions import text
from flowloom.functions.lineage import cut
from flowloom.operators import extract, findings, graph, joins, permissions, triggers
from flowloom.operators import secrets as propagation
from flowloom.sources.estate import Estate, docker_parts, plain

#: Lines of a file in one bucket of the as-of join.
BUCKET = 10_000
STEPS = 1 << 32  # a place in a file as one number: job times STEPS plus step plus 1


def named(kind: Column | str, name: Column | str) -> Column:
    return F.concat_ws(":", kind, name)


def linked(edges: DataFrame) -> DataFrame:
    """All edges with named ends (src, dst), ord and the guard of those from a workflow's calls and steps."""
    kind = F.when(F.col("dst_kind").startswith("local-"), F.substring("dst_kind", 7, 20)).otherwise(F.col("dst_kind"))
    name = F.concat("dst", F.coalesce(F.concat(F.lit("@"), "dst_ref"), F.lit("")))
    guard = F.when(F.col("src_kind") == "workflow", graph.guard(F.col("job_if"), F.col("step_if")))
    return edges.select(
        named("src_kind", "src").alias("src"), named(kind, name).alias("dst"), F.col("edge_ord").alias("ord"), "edge_kind", guard.alias("guard"), "src_kind", "dst_kind", "job_ord", "step_ord", "tier"
    )


def local(edges: DataFrame) -> DataFrame:
    """The named edges that end at a local workflow or action."""
    return linked(edges).where("dst_kind like 'local-%'")


def entries(estate: Estate) -> DataFrame:
    """Workflows that something other than a call starts: node."""
    return estate.triggers.where("is_entry").select(named(F.lit("workflow"), "wf_id").alias("node")).distinct()


def targets(estate: Estate, files: DataFrame, path: str = "path") -> DataFrame:
    """What each distinct path belongs to: path, kind (workflow, action, unknown), id, node.

    A workflow's own path, else the action of the longest folder around it. Leading ./
    and trailing slashes are ignored; a null path is unknown.
    """
    asked = files.select(path).distinct().withColumn("bare", F.regexp_replace(path, r"^(?:\./)+|/+$", ""))
    flows = estate.workflows.select(F.col("wf_id").alias("bare"), F.lit("workflow").alias("wf_kind")).distinct()
    folders = joins.longest_prefix(asked.where("bare is not null"), estate.actions.select(F.col("act_id").alias("folder")), "bare", "folder")
    both = asked.join(flows, "bare", "left").join(folders, "bare", "left")
    kind = F.coalesce("wf_kind", F.when(F.col("folder").isNotNull(), "action"), F.lit("unknown"))
    name = F.when(kind == "workflow", F.col("bare")).when(kind == "action", F.col("folder"))
    return both.select(path, kind.alias("kind"), name.alias("id"), F.when(name.isNotNull(), named(kind, name)).alias("node"))


def callers(estate: Estate, files: DataFrame, path: str = "path") -> DataFrame:
    """Who refers to the workflows or actions that paths name, one step back: path, pos, kind, caller, job_id, step_ord, verb.

    ``pos`` counts by path: workflows before actions; in each a job's call before its
    annotations, and a step's use before its annotations.
    """
    ends = targets(estate, files, path).where("node is not null").select(path, F.col("node").alias("dst"))
    found = local(estate.edges).join(ends, "dst")
    flow, note = F.col("src_kind") == "workflow", F.col("tier") == 0
    kind = (
        F.when(note, F.when(flow, "Annotated").otherwise("AnnotatedComposite"))
        .when(F.col("edge_kind") == "call", "JobCall")
        .otherwise(F.when(flow, "Step").otherwise("CompositeStep"))
    )
    jobs = estate.jobs.select(named(F.lit("workflow"), "wf_id").alias("src"), "job_ord", "job_id")
    order = Window.partitionBy(path).orderBy(F.desc("src_kind"), "src", "job_ord", "step_ord", F.desc("tier"), "ord")
    return found.join(jobs, ["src", "job_ord"], "left").select(
        path, F.row_number().over(order).alias("pos"), kind.alias("kind"), F.col("src").alias("caller"), "job_id", F.when(F.col("step_ord") >= 0, F.col("step_ord")).alias("step_ord"), F.when(note, F.col("edge_kind")).alias("verb")
    )


def impact(estate: Estate, files: DataFrame, path: str = "path") -> DataFrame:
    """The entry workflows and the actions that a change of ``files`` reaches, without those changed: kind, id, action_kind.

    An action leads to a workflow by its annotations only. Paths of nothing known are
    ignored; ``targets`` tells them.
    """
    seeds = targets(estate, files, path).where("node is not null").select("node")
    back = local(estate.edges).where("not (src_kind = 'action' and edge_kind = 'uses' and dst_kind = 'local-workflow')")
    hit = graph.closure(graph.reversed_(back), seeds).where("depth > 0").select("node")
    null = F.lit(None).cast("string")
    flows = entries(estate).select(F.lit("workflow").alias("kind"), F.substring("node", 10, 1 << 20).alias("id"), null.alias("action_kind"), "node")
    acts = estate.actions.select(F.lit("action").alias("kind"), F.col("act_id").alias("id"), F.col("kind").alias("action_kind"), named(F.lit("action"), "act_id").alias("node"))
    return flows.unionByName(acts).join(hit, "node", "left_semi").drop("node")


def started(estate: Estate, event: str | None = None, types: list[str] = (), branches: list[str] = (), tags: list[str] = (), paths: list[str] = ()) -> DataFrame:
    """The entry workflows that an event (any, if None) starts, each by its first trigger that lets it through: node, trig_ord, event, types_kind, types, types_line.

    Of ``types``, ``branches``, ``tags`` and ``paths`` one must pass in each list that isn't
    empty. Types not declared are the event's default ones; malformed patterns match
    nothing and are among the diagnostics.
    """
    passes = F.col("is_entry") & triggers.accepts_refs(list(branches), list(tags), list(paths))
    if event is not None:
        passes = passes & (F.col("event") == event)
    if types:
        passes = passes & triggers.accepts_activity(F.col("types"), triggers.default_types(F.col("event")), list(types))
    first = triggers.first_match(estate.triggers, passes)
    how = [triggers.types_kind(F.col("types"), F.col("event")).alias("types_kind"), F.coalesce("types", triggers.default_types(F.col("event"))).alias("types"), triggers.types_line(F.col("types"), F.col("event")).alias("types_line")]
    return first.select(named(F.lit("workflow"), "wf_id").alias("node"), "trig_ord", "event", *how)


def trace(estate: Estate, event: str | None = None, types: list[str] = (), branches: list[str] = (), tags: list[str] = (), paths: list[str] = ()) -> DataFrame:
    """What the entry workflows that ``started`` gives start, depth first: root, pos, depth, node, edge_kind, guard, is_cycle, types_line (on roots).

    Nodes that several ways lead to stand at each; what isn't in the estate is a leaf.
    """
    found = graph.preorder(_traced(estate, started(estate, event, types, branches, tags, paths)))
    return found.select("root", "pos", "depth", "node", "edge_kind", "guard", "is_cycle", "types_line")


def _traced(estate: Estate, roots: DataFrame) -> DataFrame:
    null = F.lit(None).cast("string")
    edges = linked(estate.edges).select("src", "dst", "ord", F.col("edge_kind").alias("via"), F.col("guard").alias("when"))
    carry = {"edge_kind": (null, F.col("via")), "guard": (null, F.col("when")), "types_line": (F.col("types_line"), null)}
    return graph.paths(edges, roots, carry)


def _quoted(text_: Column) -> Column:
    """A text as JSON has it."""
    said = F.to_json(F.struct(text_.alias("v")))
    return F.substring(said, F.lit(6), F.length(said) - 6)


def _object(**fields: Column) -> Column:
    """A JSON object of given JSON values, without those that are null."""
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()])), ","), F.lit("}"))


def trace_documents(estate: Estate, event: str | None = None, types: list[str] = (), branches: list[str] = (), tags: list[str] = (), paths: list[str] = ()) -> DataFrame:
    """A JSON document for each entry workflow that ``started`` gives: root (its path), document.

    ``{"root": node, "trigger": {"event", "types": {"kind", "values"}}}``, types only where the event has any. Nodes have
    a kind (workflow, action, external-action, external-workflow, docker, annotated, cycle, guarded) and what belongs to
    it; they are put together on the executors, from the leaves up.
    """
    begun = cut(started(estate, event, types, branches, tags, paths))
    kind, name = F.substring_index("node", ":", 1), F.expr("substring(node, instr(node, ':') + 1)")
    bare, ref = F.regexp_replace(name, "@[^@]*$", ""), F.regexp_extract(name, "@([^@]*)$", 1)
    parts = F.split(bare, "/", 3)
    owner, repo, rest = (_quoted(F.get(parts, F.lit(k))) for k in range(3))
    more = F.when(F.size(parts) > 2, rest)
    children = F.concat(F.lit("["), "children", F.lit("]"))
    plain_node = (
        F.when(F.col("is_cycle"), _object(kind=F.lit('"cycle"'), target_kind=_quoted(kind), target=_quoted(name)))
        .when(kind == "external-action", _object(kind=_quoted(kind), owner=owner, repo=repo, subpath=more, gitref=_quoted(ref)))
        .when(kind == "external-workflow", _object(kind=_quoted(kind), owner=owner, repo=repo, path=more, gitref=_quoted(ref)))
        .when(kind == "docker", _object(kind=_quoted(kind), image=_quoted(name)))
        .otherwise(_object(kind=_quoted(kind), id=_quoted(name), children=children))
    )
    dangling = kind == "unresolved"
    note = _object(kind=F.lit('"annotated"'), verb=_quoted(F.col("edge_kind")), dangling=dangling.cast("string"), label=_quoted(name), children=F.concat(F.lit("["), F.when(dangling, "").otherwise(plain_node), F.lit("]")))
    node = F.when(F.col("edge_kind").isin("dispatches", "triggers"), note).otherwise(plain_node)
    whole = F.when(F.col("guard").isNotNull(), _object(kind=F.lit('"guarded"'), if_expr=_quoted(F.col("guard")), inner=node)).otherwise(node)
    trees = graph.folded(cut(_traced(estate, begun)), whole)
    said = F.when(F.col("types_kind").isNotNull(), _object(kind=_quoted(F.col("types_kind")), values=F.when(F.col("types_kind") != "implicit-all", F.to_json("types"))))
    trigger = _object(event=_quoted(F.col("event")), types=said)
    both = trees.join(begun.withColumnRenamed("node", "root"), "root")
    return both.select(F.substring("root", 10, 1 << 20).alias("root"), _object(root=F.col("text"), trigger=trigger).alias("document"))


def declarations(estate: Estate) -> DataFrame:
    """Declared inputs, outputs and secrets: owner (a node), event (null for actions), what, name, type, required, default, value, description."""
    flows = estate.triggers.where("event in ('workflow_call', 'workflow_dispatch')")
    listed = [flows.select(named(F.lit("workflow"), "wf_id").alias("owner"), "event", F.lit(w).alias("what"), F.explode(f"{w}s").alias("name", "body")) for w in ("input", "output", "secret")]
    null = F.lit(None).cast("string")
    listed += [estate.actions.select(named(F.lit("action"), "act_id").alias("owner"), null.alias("event"), F.lit(w).alias("what"), F.explode(f"{w}s").alias("name", "body")) for w in ("input", "output")]
    out = listed[0]
    for more in listed[1:]:
        out = out.unionByName(more)
    said = lambda key: F.get_json_object("body", f"$.{key}")
    return out.select("owner", "event", "what", "name", said("type").alias("type"), F.coalesce(said("required") == "true", F.lit(False)).alias("required"), said("default").alias("default"), said("value").alias("value"), said("description").alias("description"))


def part(json: Column, key: str) -> Column:
    """A part of what may be a mapping; a plain text stands for that part itself."""
    return F.when(json.startswith("{"), F.get_json_object(json, f"$.{key}")).otherwise(json)


def job_fields(estate: Estate) -> DataFrame:
    """The fields of jobs that come in several forms, typed: wf_id, job_ord, job_id, needs, runs_on, strategy, environment, container, services (``functions.jobs``)."""
    typed = [getattr(fields, name)(F.col(f"`{column}`")).alias(name) for name, column in (("needs", "needs"), ("runs_on", "runs-on"), ("strategy", "strategy"), ("environment", "environment"), ("container", "container"), ("services", "services"))]
    return estate.jobs.select("wf_id", "job_ord", "job_id", *typed)


def matrix(estate: Estate) -> DataFrame:
    """The members of the jobs' matrices: wf_id, job_id, dimension, pos (from 0), value (a variant)."""
    dimensions = job_fields(estate).select("wf_id", "job_id", F.explode("strategy.matrix").alias("dimension", "members"))
    return dimensions.select("wf_id", "job_id", "dimension", F.posexplode("members").alias("pos", "value"))


def images(estate: Estate) -> DataFrame:
    """Every image that the estate names: owner (a node), job_id, site (container, service, step), name (of the service, or the step's place), host, image, tag."""
    typed = job_fields(estate)
    flow, none = named(F.lit("workflow"), "wf_id").alias("owner"), F.lit(None).cast("string")
    found = typed.where("container is not null").select(flow, "job_id", F.lit("container").alias("site"), none.alias("name"), F.col("container.image").alias("said"))
    service = typed.select(flow, "job_id", F.explode("services").alias("name", "s")).select("owner", "job_id", F.lit("service").alias("site"), "name", F.col("s.image").alias("said"))
    step = estate.steps.where("target.kind = 'docker'").select(named("owner_kind", "owner_id").alias("owner"), "job_id", F.lit("step").alias("site"), F.col("step_ord").cast("string").alias("name"), F.col("target.id").alias("said"))
    return found.unionByName(service).unionByName(step).select("owner", "job_id", "site", "name", docker_parts(F.col("said")).alias("d")).select("owner", "job_id", "site", "name", "d.*")


def container_texts(json: Column) -> Column:
    env = F.map_values(plain(F.from_json(F.get_json_object(json, "$.env"), "map<string,string>")))
    only = lambda key: F.when(json.startswith("{"), F.get_json_object(json, f"$.{key}"))
    return F.concat(F.array(part(json, "image"), only("options")), F.coalesce(env, F.array().cast("array<string>")))


def expressions(estate: Estate) -> DataFrame:
    """Every text of the estate that may hold expressions: owner (a node), text. Ports and volumes are left out."""
    flow = named(F.lit("workflow"), "wf_id").alias("owner")
    empty = F.array().cast("array<string>")
    values = lambda m: F.coalesce(F.map_values(m), empty)
    column = F.col
    sources = [
        estate.workflows.select(flow, F.concat(F.array("run_name", part(column("concurrency"), "group")), values("env")).alias("t")),
        estate.jobs.select(
            flow,
            F.concat(
                F.array("if", part(column("concurrency"), "group"), part(column("environment"), "name"), F.when(column("environment").startswith("{"), F.get_json_object("environment", "$.url"))),
                values("outputs"), values("env"), F.when(column("call.kind").isNotNull(), values("with")).otherwise(empty), F.coalesce(container_texts(column("container")), empty),
                F.coalesce(F.flatten(F.transform(F.map_values(plain(F.from_json("services", "map<string,string>"))), container_texts)), empty),
            ).alias("t"),
        ),
        estate.steps.select(named("owner_kind", "owner_id").alias("owner"), F.concat(F.array("run", "if", "`continue-on-error`"), values("with"), values("env")).alias("t")),
    ]
    out = sources[0].unionByName(sources[1]).unionByName(sources[2]).select("owner", F.explode("t").alias("text"))
    outputs = declarations(estate).where("what = 'output' and coalesce(event, 'workflow_call') = 'workflow_call'").select("owner", F.col("value").alias("text"))
    return out.unionByName(outputs).where(F.contains("text", F.lit("${{")))


def orphans(estate: Estate) -> DataFrame:
    """What nothing uses: kind, owner (a node), name.

    Workflows and actions that no entry reaches (of workflows only those that are merely
    called); declared inputs that their own texts never name; declared outputs of workflows
    and composite actions with local call sites that none of those read. An access by a
    computed name counts as one to all.
    """
    null = F.lit(None).cast("string")
    live = graph.closure(local(estate.edges), entries(estate)).select("node")
    called = estate.triggers.where("event = 'workflow_call'").select(named(F.lit("workflow"), "wf_id").alias("node")).distinct()
    flows = called.join(entries(estate), "node", "left_anti").join(live, "node", "left_anti").select(F.lit("workflow").alias("kind"), F.col("node").alias("owner"), null.alias("name"))
    acts = estate.actions.select(named(F.lit("action"), "act_id").alias("node")).join(live, "node", "left_anti").select(F.lit("action").alias("kind"), F.col("node").alias("owner"), null.alias("name"))

    composite = estate.actions.where("kind = 'composite'").select(named(F.lit("action"), "act_id").alias("owner"))
    declared = declarations(estate).where("coalesce(event, 'workflow_call') = 'workflow_call'")
    declared = declared.where("event is not null").unionByName(declared.where("event is null").join(composite, "owner", "left_semi")).select("owner", "what", "name").distinct()
    texts = expressions(estate)
    said = texts.select("owner", F.explode(text.input_names(F.col("text"))).alias("name")).distinct()
    open_ended = lambda what: texts.where(text.is_dynamic(F.col("text"), what)).select("owner").distinct()
    inputs = declared.where("what = 'input'").join(said, ["owner", "name"], "left_anti").join(open_ended("inputs"), "owner", "left_anti").select(F.lit("input").alias("kind"), "owner", "name")

    calls = estate.jobs.where("call.kind = 'local-workflow'").select(named(F.lit("workflow"), "call.id").alias("owner"), named(F.lit("workflow"), "wf_id").alias("caller"), F.col("job_id").alias("site"), F.lit("needs").alias("via"))
    uses = estate.steps.where("target.kind = 'local-action'").select(named(F.lit("action"), "target.id").alias("owner"), named("owner_kind", "owner_id").alias("caller"), F.col("id").alias("site"), F.lit("steps").alias("via"))
    sites = calls.unionByName(uses)
    read = None
    for via in ("needs", "steps"):
        refs = texts.select(F.col("owner").alias("caller"), F.lit(via).alias("via"), F.explode(text.output_refs(F.col("text"), via)).alias("r"))
        refs = refs.select("caller", "via", F.col("r.id").alias("site"), F.col("r.output").alias("name"))
        read = refs if read is None else read.unionByName(refs)
    used = sites.join(read.distinct(), ["caller", "via", "site"]).select("owner", "name").distinct()
    any_read = open_ended("needs").withColumn("via", F.lit("needs")).unionByName(open_ended("steps").withColumn("via", F.lit("steps"))).withColumnRenamed("owner", "caller")
    all_used = sites.join(any_read, ["caller", "via"]).select("owner").distinct()
    outputs = declared.where("what = 'output'").join(sites.select("owner").distinct(), "owner", "left_semi").join(used, ["owner", "name"], "left_anti").join(all_used, "owner", "left_anti")
    return flows.unionByName(acts).unionByName(inputs).unionByName(outputs.select(F.lit("output").alias("kind"), "owner", "name"))


def run_links(estate: Estate) -> DataFrame:
    """``workflow_run`` triggers by the names that they wait for: wf_id, upstream, target (null if no workflow has that name or, without one, path)."""
    names = estate.workflows.select(F.coalesce("name", "wf_id").alias("upstream"), F.col("wf_id").alias("target"))
    waits = estate.triggers.where("event = 'workflow_run'").select("wf_id", F.explode("upstream").alias("upstream"))
    return waits.join(names, "upstream", "left").select("wf_id", "upstream", "target")


def wiring(estate: Estate) -> DataFrame:
    """References that lead nowhere, and starts of workflows that no annotation tells: kind, file, line, target, reason."""
    null = F.lit(None).cast("string")
    lines = estate.steps.where("owner_kind = 'workflow' and run is not null").select("owner_id", "job_ord", "step_ord", "line", F.posexplode(F.split("run", "\n")).alias("n", "said"))
    token = F.split(F.trim(F.regexp_replace("said", r"\s+", " ")), " ")
    at = lambda k: F.try_element_at(token, F.lit(k))
    starts = lines.where((at(1) == "gh") & (at(2) == "workflow") & (at(3) == "run") & ~at(4).rlike("^[$\"']"))
    starts = starts.select("owner_id", "job_ord", "step_ord", (F.col("line") + F.col("n")).alias("line"), F.regexp_replace(at(4), "[;,]+$", "").alias("target")).where("target <> ''")
    told = estate.annotations.where("verb = 'dispatches' and reason is null").select("owner_id", "job_ord", "step_ord", text.basename(F.col("target")).alias("base"))
    untold = starts.withColumn("base", text.basename(F.col("target"))).join(told, ["owner_id", "job_ord", "step_ord", "base"], "left_anti")

    flows, acts = estate.workflows.select(named(F.lit("workflow"), "wf_id").alias("node")), estate.actions.select(named(F.lit("action"), "act_id").alias("node"))
    calls = estate.jobs.select(F.col("wf_id").alias("file"), "line", F.col("call").alias("to"))
    uses = estate.steps.select(F.col("owner_id").alias("file"), "line", F.col("target").alias("to"))
    ends = calls.unionByName(uses).where("to.kind like 'local-%'").withColumn("node", named(F.substring("to.kind", 7, 20), "to.id"))
    lost = ends.join(flows.unionByName(acts), "node", "left_anti")
    row = lambda kind, file, line, target, reason: [F.lit(kind).alias("kind"), F.col(file).alias("file"), line.cast("int").alias("line"), F.col(target).alias("target"), reason.alias("reason")]
    return (
        untold.select(*row("unannotated dispatch", "owner_id", F.col("line"), "target", null))
        .unionByName(estate.annotations.where("reason is not null").select(*row("dangling annotation", "owner_id", F.col("line"), "target", F.col("reason"))))
        .unionByName(run_links(estate).where("target is null").select(*row("dangling workflow_run", "wf_id", F.lit(None), "upstream", null)))
        .unionByName(lost.select(*row("dangling local uses", "file", F.col("line"), "to.id", null)))
    )


def attach(estate: Estate, found: DataFrame) -> DataFrame:
    """``found`` (findings with path and start_line) with the place that each belongs to: node, job_id, job_ord, step_ord, confidence.

    ``exact``: a job or step begins on that line (of several the step), or the line is above
    all of them or null, which is the file as a whole; ``heuristic``: the nearest one above;
    ``file_only``: the path is of no workflow or action.
    """
    place = F.col("job_ord").cast("long") * STEPS
    jobs = estate.jobs.select(named(F.lit("workflow"), "wf_id").alias("node"), "line", place.alias("place"), F.lit(1).alias("rank"))
    steps = estate.steps.select(named("owner_kind", "owner_id").alias("node"), "line", (place + F.col("step_ord") + 1).alias("place"), F.lit(2).alias("rank"))
    ends = targets(estate, found).select("path", "node")
    placed = found.join(ends, found["path"].eqNullSafe(ends["path"]), "left").drop(ends["path"])
    asked = placed.where("node is not null and start_line is not null").select("node", F.col("start_line").alias("line")).distinct().withColumn("row", F.lit(0))
    near = joins.asof_backward(asked, jobs.unionByName(steps).where("line is not null"), "node", "line", "row", "place", F.col("rank"), F.floor(F.col("line") / BUCKET))
    near = near.select("node", F.col("line").alias("start_line"), "place", "anchor_at")
    job, step = F.floor(F.col("place") / STEPS).cast("int"), (F.col("place") % STEPS - 1).cast("int")
    confidence = F.when(F.col("node").isNull(), "file_only").when(F.col("anchor_at") < F.col("start_line"), "heuristic").otherwise("exact")
    both = placed.join(near, ["node", "start_line"], "left").withColumn("job_ord", job).withColumn("step_ord", F.when(step >= 0, step)).withColumn("confidence", confidence)
    ids = estate.jobs.select(named(F.lit("workflow"), "wf_id").alias("node"), "job_ord", "job_id")
    return both.drop("place", "anchor_at").join(ids, ["node", "job_ord"], "left").select(*found.columns, "node", "job_id", F.when(F.col("node").startswith("workflow:"), F.col("job_ord")).alias("job_ord"), "step_ord", "confidence")


def affected_entries(estate: Estate, nodes: DataFrame) -> DataFrame:
    """The entry workflows that reach each of ``nodes`` (node), itself included: node, entries (sorted paths), events (theirs, sorted).

    Only what leads to one of the nodes takes part; entries are handed down it as sets, so
    ways and nodes that share entries don't multiply them. An action leads to a workflow by
    its annotations only.
    """
    back = local(estate.edges).where("not (src_kind = 'action' and edge_kind = 'uses' and dst_kind = 'local-workflow')").select("src", "dst")
    above = graph.closure(graph.reversed_(back), nodes).select("node")
    within = back.join(above.withColumnRenamed("node", "dst"), "dst", "left_semi").join(above.withColumnRenamed("node", "src"), "src", "left_semi")
    starts = estate.triggers.where("is_entry").select(named(F.lit("workflow"), "wf_id").alias("node"), F.col("wf_id").alias("label"), "event")
    reaching = graph.handed_down(within, starts.join(above, "node", "left_semi").select("node", "label")).join(nodes.distinct(), "node", "left_semi")
    events = reaching.select("node", F.explode("labels").alias("label")).join(starts.select("label", "event").distinct(), "label").groupBy("node").agg(F.array_sort(F.collect_set("event")).alias("events"))
    return reaching.join(events, "node").select("node", F.col("labels").alias("entries"), "events")


def neighbours(estate: Estate, nodes: DataFrame) -> DataFrame:
    """Who calls or uses each of ``nodes`` (by annotations too), and what each calls and uses: node, callers, callees (sorted ids).

    Ids are paths of workflows and actions; external ends are ``owner/repository/folder@ref``
    (workflows without their path), images ``docker://image``.
    """
    wanted = nodes.distinct()
    bare = lambda c: F.regexp_replace(c, "^(?:workflow|action):", "")
    ids = lambda c: F.array_sort(F.collect_set(c))
    callers_ = local(estate.edges).select(F.col("dst").alias("node"), bare(F.col("src")).alias("id")).join(wanted, "node", "left_semi").groupBy("node").agg(ids("id").alias("callers"))
    end, ref = F.col("dst"), F.coalesce(F.concat(F.lit("@"), "dst_ref"), F.lit(""))
    end = F.when(F.col("dst_kind") == "docker", F.concat(F.lit("docker://"), end)).when(F.col("dst_kind") == "external-workflow", F.concat(F.substring_index(end, "/", 2), ref)).otherwise(F.concat(end, ref))
    out = estate.edges.where("tier = 1").select(named("src_kind", "src").alias("node"), end.alias("id"))
    callees = out.join(wanted, "node", "left_semi").groupBy("node").agg(ids("id").alias("callees"))
    none = F.array().cast("array<string>")
    return wanted.join(callers_, "node", "left").join(callees, "node", "left").select("node", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))


def postures(estate: Estate) -> tuple[DataFrame, DataFrame]:
    """Of workflows (node) and of jobs that declare permissions (node, job_id): ``permission_context``; of workflows also ``secret_context``."""
    coarse, scopes = permissions.declared(F.col("permissions"))
    writes = F.array_sort(F.map_keys(F.map_filter(scopes, lambda _, level: level == "write")))
    context = lambda source: F.struct(
        F.coalesce(coarse == "write-all", F.lit(False)).alias("write_all"), F.coalesce(writes, F.array().cast("array<string>")).alias("write_scopes"), source.alias("source")
    )
    asks = estate.triggers.where("event = 'workflow_call'").groupBy("wf_id").agg(F.max(F.coalesce(F.size("secrets") > 0, F.lit(False))).alias("requires"))
    calls = estate.jobs.where("call.kind is not null and call.kind <> 'error'")
    given = F.map_keys(plain(F.from_json(F.when(F.col("secrets").startswith("{"), F.col("secrets")), "map<string,string>")))
    passes = calls.groupBy("wf_id").agg(F.max(F.coalesce(F.col("secrets") == "inherit", F.lit(False))).alias("inherits"), F.max(F.coalesce(F.size(given) > 0, F.lit(False))).alias("passes"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    source = F.when(F.col("permissions").isNull(), "none-declared").otherwise("workflow")
    flows = estate.workflows.join(asks, "wf_id", "left").join(passes, "wf_id", "left").select(
        named(F.lit("workflow"), "wf_id").alias("node"),
        context(source).alias("permission_context"),
        F.struct(yes("requires").alias("requires_secrets"), yes("inherits").alias("inherits_secrets"), yes("passes").alias("passes_secrets")).alias("secret_context"),
    )
    jobs = estate.jobs.where("permissions is not null").select(named(F.lit("workflow"), "wf_id").alias("node"), "job_id", context(F.concat(F.lit("job:"), "job_id")).alias("job_context"))
    return flows, jobs


def enrich(estate: Estate, found: DataFrame) -> DataFrame:
    """``found`` (findings with path, start_line and severity) with their place (``attach``), its context and what follows.

    Context: reachable_from (events), callers, callees, affected_entrypoints, is_orphan,
    permission_context (of the job if it declares any, else the workflow), secret_context
    (both null for actions). Then priority (a severity) with its reasons. A finding of no
    workflow or action has an empty context and keeps its severity; the severity itself
    is never changed.
    """
    placed = attach(estate, found)
    nodes = placed.where("node is not null").select("node").distinct()
    flows, jobs = postures(estate)
    unused = orphans(estate).where("kind in ('workflow', 'action')").select(F.col("owner").alias("node"), F.lit(True).alias("orphan"))
    context = neighbours(estate, nodes).join(affected_entries(estate, nodes), "node", "left").join(unused.distinct(), "node", "left").join(flows, "node", "left")
    both = placed.join(context, "node", "left").join(jobs, ["node", "job_id"], "left")
    none = F.array().cast("array<string>")
    out = both.select(
        *found.columns, "node", "job_id", "job_ord", "step_ord", "confidence",
        F.coalesce("events", none).alias("reachable_from"), F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"), F.coalesce("entries", none).alias("affected_entrypoints"),
        F.coalesce("orphan", F.lit(False)).alias("is_orphan"), F.coalesce("job_context", "permission_context").alias("permission_context"), "secret_context",
    )
    fixtures = F.col("node").isNotNull() & text.has_segment(F.col("path"), "fixtures")
    reasons = findings.signals(F.col("reachable_from"), F.col("permission_context.write_all"), F.col("permission_context.write_scopes"), F.col("is_orphan"), fixtures)
    out = out.withColumn("priority_reasons", reasons)
    return out.withColumn("priority", findings.label_of(findings.derived_priority(findings.rank_of(F.col("severity")), F.col("priority_reasons"))))


def features(estate: Estate) -> DataFrame:
    """What near-duplicate workflows are compared by (``dedup.similar_pairs``): doc, kind, token. Steps count, calls of jobs don't."""
    steps = estate.steps.where("owner_kind = 'workflow'")
    name = F.concat(F.element_at(F.create_map(*map(F.lit, ("local-workflow", "local-wf:", "local-action", "local-action:", "external-action", "ext:", "docker", "docker:"))), F.col("target.kind")), F.col("target.id"))
    row = lambda kind, token: [F.lit(kind).alias("kind"), token.alias("token")]
    out = estate.triggers.select(F.col("wf_id").alias("doc"), *row("trigger", F.col("event")))
    out = out.unionByName(estate.jobs.select(F.col("wf_id").alias("doc"), *row("job", F.col("job_id"))))
    out = out.unionByName(steps.where("target.kind is not null and target.kind <> 'error'").select(F.col("owner_id").alias("doc"), *row("use", name)))
    words = F.explode(F.split(F.col("run"), r"\s+"))
    return out.unionByName(steps.where("run is not null").select(F.col("owner_id").alias("doc"), *row("run", words)).where("token <> ''")).distinct()


def _calls_and_caps(estate: Estate) -> tuple[DataFrame, DataFrame]:
    """Calls between jobs (``<workflow>#<job>``) and the caps of the entries' jobs, as ``permissions.escalation_chains`` takes them."""
    levels = lambda c: permissions.normalised(*permissions.declared(F.col(c)))
    whole = estate.workflows.select("wf_id", levels("permissions").alias("wf"))
    jobs = estate.jobs.select("wf_id", "job_ord", F.concat_ws("#", "wf_id", "job_id").alias("node"), levels("permissions").alias("job"), "call").join(whole, "wf_id")
    calls = jobs.where("call.kind = 'local-workflow'").select(F.col("node").alias("src"), F.col("wf_id").alias("src_flow"), F.col("call.id").alias("wf_id"))
    calls = calls.join(jobs.select("wf_id", F.col("job_ord").alias("ord"), F.col("node").alias("dst"), "wf", "job"), "wf_id").withColumnRenamed("wf_id", "dst_flow")
    start = estate.triggers.where("is_entry").select("wf_id").distinct().join(jobs, "wf_id").select("node", F.col("wf_id").alias("flow"), permissions.effective(F.col("job"), F.col("wf")).alias("cap"))
    return calls, start


def escalations(estate: Estate) -> DataFrame:
    """Jobs of called workflows that declare more than their callers may pass on: root, node (both ``<workflow>#<job>``), scopes, caller, chain (from the root to the caller), key."""
    return permissions.escalation_chains(*_calls_and_caps(estate))


def permission_findings(estate: Estate) -> DataFrame:
    """All findings about permissions: pos, kind, severity, file, job_id, scopes, caller, chain, jobs.

    High before medium, then by file and job; of one place broad declarations before
    escalations, those by their entry's workflow and job, then by depth-first order.
    """
    none = lambda kind: F.lit(None).cast(kind)
    entry = permissions.entry_findings(estate.workflows, estate.jobs, estate.triggers).select("kind", "severity", F.col("wf_id").alias("file"), "job_id", none("array<string>").alias("scopes"), none("string").alias("caller"), none("array<string>").alias("chain"), "jobs", none("array<bigint>").alias("key"))
    jobs = estate.jobs.select(F.concat_ws("#", "wf_id", "job_id").alias("name"), "wf_id", "job_id", "job_ord")
    found = escalations(estate).join(jobs.select(F.col("name").alias("node"), F.col("wf_id").alias("file"), "job_id"), "node").join(jobs.select(F.col("name").alias("root"), F.col("wf_id").alias("root_flow"), F.col("job_ord").alias("root_ord")), "root")
    found = found.select(F.lit("Escalation").alias("kind"), F.lit("high").alias("severity"), "file", "job_id", "scopes", "caller", "chain", none("array<string>").alias("jobs"), "key", "root_flow", "root_ord")
    every = entry.withColumn("root_flow", none("string")).withColumn("root_ord", none("int")).unionByName(found)
    order = Window.orderBy("severity", F.concat_ws("::", "file", F.coalesce("job_id", F.lit(""))), F.col("kind") == "Escalation", "root_flow", "root_ord", "key")
    return every.withColumn("pos", F.row_number().over(order)).select("pos", "kind", "severity", "file", "job_id", "scopes", "caller", "chain", "jobs")


def secrets(estate: Estate) -> DataFrame:
    """Required secrets that a chain of calls from an entry drops: entry, callee, secret, depth, dropped_at, kind."""
    handed = F.col("secrets")
    mode = F.when(handed == "inherit", "inherit").when(handed.startswith("{"), "explicit").otherwise("none")
    given = F.when(mode == "explicit", plain(F.from_json(handed, "map<string,string>"))).otherwise(F.create_map().cast("map<string,string>"))
    calls = estate.jobs.where("call.kind = 'local-workflow'")
    calls = calls.select(named(F.lit("workflow"), "wf_id").alias("src"), named(F.lit("workflow"), "call.id").alias("dst"), F.col("job_ord").alias("ord"), mode.alias("mode"), given.alias("map"))
    needed = declarations(estate).where("what = 'secret' and required").select(F.col("owner").alias("node"), F.col("name").alias("secret"))
    return propagation.lost(calls, entries(estate), needed)


def shadowed_environments(estate: Estate) -> DataFrame:
    """Jobs with an environment in workflows that an entry calls, directly or through others: node, job_id, environment."""
    calls = estate.jobs.where("call.kind = 'local-workflow'").select(named(F.lit("workflow"), "wf_id").alias("src"), named(F.lit("workflow"), "call.id").alias("dst"))
    jobs = estate.jobs.select(named(F.lit("workflow"), "wf_id").alias("node"), "job_id", part(F.col("environment"), "name").alias("environment"))
    return propagation.shadowed_environments(jobs, graph.closure(calls, entries(estate)))


def extraction_steps(estate: Estate) -> DataFrame:
    """Steps as ``extract.grown`` takes them, with what a sketch shows: container, ord, sig, text.

    A container is a job or a composite action, in the estate's order: a struct of rank (0
    for jobs), owner, job_ord, name. A call of a workflow as a step has no signature, nor
    has a step without a meaningful line.
    """
    job = F.col("owner_kind") == "workflow"
    name = F.when(job, F.concat_ws(":", "owner_id", "job_id")).otherwise(F.concat("owner_id", F.lit(":_composite")))
    container = F.struct(F.when(job, 0).otherwise(1).alias("rank"), F.col("owner_id").alias("owner"), "job_ord", name.alias("name"))
    kind, ref = F.col("target.kind"), F.coalesce(F.concat(F.lit("@"), "target.ref"), F.lit(""))
    used = F.when(kind == "local-action", F.concat(F.lit("local-action:"), "target.id")).when(kind == "external-action", F.concat(F.lit("external:"), "target.id", ref)).when(kind == "docker", F.concat(F.lit("docker:"), "target.id"))
    known = kind.isNotNull() & (kind != "error")
    sig = F.when(known, F.concat(F.lit("uses:"), used)).otherwise(F.concat(F.lit("run:"), extract.first_meaningful_line(F.col("run"))))
    shown = F.when(kind == "local-action", F.concat(F.lit("./"), "target.id")).when(kind == "docker", F.concat(F.lit("docker://"), "target.id")).otherwise(F.concat("target.id", ref))
    asks = F.when(F.coalesce(F.size("with") > 0, F.lit(False)), "      # TODO: parametrize via inputs:\n").otherwise("")
    body = F.array_join(F.transform(F.split(F.regexp_replace("run", "\r?\n$", ""), "\r?\n"), lambda line: F.concat(F.lit("        "), line, F.lit("\n"))), "")
    text_ = F.when(known, F.concat(F.lit("    - uses: "), shown, F.lit("\n"), asks)).otherwise(F.concat(F.lit("    - shell: "), F.coalesce("shell", F.lit("bash")), F.lit("\n      run: |\n"), body))
    return estate.steps.select(container.alias("container"), F.col("step_ord").alias("ord"), sig.alias("sig"), text_.alias("text"))


#: How a proposed action begins.
SKETCH = "name: extracted-bootstrap\ndescription: Extracted from duplicated step sequences. Review and parametrize before using.\nruns:\n  using: composite\n  steps:\n"


def extraction(estate: Estate, min_length: int = 3, min_occurrences: int = 2) -> tuple[DataFrame, DataFrame]:
    """Step sequences worth an action of their own: (candidates, sites).

    candidates: rank, id, length, occurrences, score (length times the occurrences that go), sketch (the
    action as YAML, from the first occurrence); sites: id, container, start, end. Ranked by
    score, length and occurrences, all falling, then by the text of the first site.
    """
    steps = cut(extraction_steps(estate))
    sequences, sites = extract.grown(steps, min_length, min_occurrences)
    kept = cut(sequences.where("kept").drop("kept"))
    at = kept.select("id", "length", F.col("id.container").alias("container"), F.explode(F.expr("sequence(id.start, id.start + length - 1)")).alias("ord"))
    said = at.join(steps.select("container", F.col("ord").cast("int").alias("ord"), "text"), ["container", "ord"]).groupBy("id", "length").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"))
    score = F.col("length") * (F.col("occurrences") - 1)
    place = F.format_string("%s:%d-%d", F.col("id.container.name"), F.col("id.start"), F.col("id.start") + F.col("length"))
    order = Window.orderBy(F.desc("score"), F.desc("length"), F.desc("occurrences"), place)
    sketch = F.concat(F.lit(SKETCH), F.array_join(F.col("t.text"), ""))
    candidates = kept.join(said, ["id", "length"]).withColumn("score", score).select(F.row_number().over(order).alias("rank"), "id", "length", "occurrences", "score", sketch.alias("sketch"))
    cited = sites.join(kept.select("id", "length"), ["id", "length"], "left_semi").select("id", "length", F.col("container.name").alias("container"), "start", (F.col("start") + F.col("length")).alias("end"))
    return candidates, cited
