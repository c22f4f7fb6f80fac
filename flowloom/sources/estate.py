"""Estates: folders of workflow and action YAML, read into tables.

Files are found and read by Spark's binaryFile source and turned into JSON one by one;
everything else is column work on that JSON.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.functions import globs, text
from flowloom.functions.lineage import cut
from flowloom.operators import joins, permissions, triggers as events
from flowloom.sources.yaml_text import LINE, to_json

# Folders that are never searched.
PRUNED = (".git", "target", "node_modules")
PREFIX = "flowloom"
#: Lines of a file that are swept together.
LINES = 10_000

STEP = f"id string, name string, uses string, run string, `if` string, `with` map<string,string>, env map<string,string>, shell string, `continue-on-error` string, `timeout-minutes` string, `working-directory` string, `{LINE}` int"
JOB = f"""name string, needs string, `runs-on` string, `if` string, uses string, `with` map<string,string>, secrets string, permissions string, outputs map<string,string>,
 env map<string,string>, environment string, strategy string, concurrency string, defaults string, container string, services string, `{LINE}` int, steps array<struct<{STEP}>>"""
BODY = f"""branches string, `branches-ignore` string, tags string, `tags-ignore` string, paths string, `paths-ignore` string, types string, workflows string, __types_lines__ array<int>, `{LINE}` int,
 inputs map<string,string>, outputs map<string,string>, secrets map<string,string>"""
WORKFLOW = f"""name string, `run-name` string, permissions string, env map<string,string>, concurrency string, defaults string, `on` array<struct<event:string,body:string>>,
 jobs array<struct<id:string,body:struct<{JOB}>>>, __texts__ array<array<int>>, `{LINE}` int"""
ACTION = f"name string, inputs map<string,string>, outputs map<string,string>, runs struct<`using`: string, steps: array<struct<{STEP}>>>, __texts__ array<array<int>>, `{LINE}` int"


@dataclass(frozen=True)
class Estate:
    workflows: DataFrame
    triggers: DataFrame
    jobs: DataFrame
    actions: DataFrame
    steps: DataFrame
    annotations: DataFrame
    edges: DataFrame
    diagnostics: DataFrame
    tables: dict = field(default_factory=dict)


def scan(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """The estate's files: path (from the root), kind, mtime, content. One manifest for each folder: .yaml before .yml.

    Without the folder of workflows there are none.
    """
    read = spark.read.format("binaryFile")
    base = F.lit(root.rstrip("/") + "/")
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/+", "/")
    path = F.replace(path, F.regexp_replace(base, "^[a-z]+:/+", "/"), F.lit(""))
    cols = [path.alias("path"), F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content")]
    try:
        flows = read.option("pathGlobFilter", "*.y{a,}ml").load(f"{root}/.github/workflows").select(*cols)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        flows = spark.createDataFrame([], "path string, mtime timestamp, content string")
    flows = flows.withColumn("kind", F.lit("workflow"))
    found = read.option("recursiveFileLookup", "true").option("pathGlobFilter", "action.y{a,}ml").load(root).select(*cols)
    kept = found.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, PRUNED))))
    first = F.row_number().over(Window.partitionBy(folder_of(F.col("path"))).orderBy("path"))
    one = kept.withColumn("n", first).where("n = 1").drop("n")
    for glob in exclude:
        one = one.where(~F.col("path").rlike(file_glob(glob)))
    return flows.unionByName(one.withColumn("kind", F.lit("action")))


def file_glob(glob: str) -> str:
    """An exclude glob as a regular expression: ``*`` and ``?`` also match slashes, ``**/`` any folders or none, ``{a,b}`` either, ``[!a]`` another."""
    out, k, depth = [], 0, 0
    while k < len(glob):
        c, end = glob[k], glob.find("]", k + 2)
        if glob.startswith("**/", k) and (k == 0 or glob[k - 1] == "/"):
            out.append("(?:.*/)?")
            k += 2
        elif c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and end > 0:
            body = glob[k + 1 : end]
            out.append(("[^" if body[0] in "!^" else "[") + re.sub(r"([\[\]\\^&])", r"\\\1", body.lstrip("!^")) + "]")
            k = end
        elif c in "{}":
            depth += 1 if c == "{" else -1
            out.append("(?:" if c == "{" else ")")
        else:
            out.append("|" if c == "," and depth else re.escape(c))
        k += 1
    if depth:
        raise ValueError(f"unbalanced braces in {glob!r}")
    return "^(?s:" + "".join(out) + ")$"


def folder_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def parsed(files: DataFrame) -> DataFrame:
    """path, kind, content, doc (JSON, null if the file is broken), problem."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [to_json(c, p) for c, p in zip(frame["content"], frame["path"])]
            yield frame.assign(doc=[d for d, _ in found], problem=[p for _, p in found])[["path", "kind", "content", "doc", "problem"]]

    return files.select("path", "kind", "content").mapInPandas(run, "path string, kind string, content string, doc string, problem string")


def strings(json: Column) -> Column:
    """A JSON text, or list of texts, as an array; null stays null."""
    listed = F.from_json(json, "array<string>")
    return F.when(json.isNull(), None).when(json.startswith("["), listed).otherwise(F.array(json))


def plain(mapping: Column) -> Column:
    """A map of a document without its line number."""
    return F.map_filter(mapping, lambda name, _: name != LINE)


def ref_filter(body: str, what: str) -> Column:
    """What a trigger includes or excludes: a struct of kind and patterns; including comes first."""
    yes, no = strings(F.col(f"{body}.{what}")), strings(F.col(f"{body}.`{what}-ignore`"))
    kind = F.when(yes.isNotNull(), "include").when(no.isNotNull(), "exclude").otherwise("none")
    return F.struct(kind.alias("kind"), F.coalesce(yes, no, F.array().cast("array<string>")).alias("patterns"))


def classified(uses: Column, job_level: bool = False) -> Column:
    """What a ``uses`` names: a struct of kind, id and ref. A job only calls workflows; an external one needs owner, repository and ref.

    Local ones begin with ./ or $/; the root is '.'. White space around it is ignored.
    """
    uses = F.trim(uses)
    local = uses.rlike(r"^(\./|\$/)")
    bare = F.regexp_replace(F.substring(uses, 3, 1 << 20), "/+$", "")
    bare = F.when(bare == "", ".").otherwise(bare)
    flow = F.lit(True) if job_level else text.classify_target(bare) == "workflow"
    kind = (
        F.when(uses.isNull(), None)
        .when(uses.startswith("docker://"), "docker")
        .when(local & flow, "local-workflow")
        .when(local, "local-action")
        .when(~uses.rlike("^[^@/]*/[^@]*@"), "error")
        .otherwise("external-workflow" if job_level else "external-action")
    )
    target = F.when(local, bare).when(uses.startswith("docker://"), F.substring(uses, 10, 1 << 20)).otherwise(F.substring_index(uses, "@", 1))
    return F.struct(kind.alias("kind"), target.alias("id"), F.nullif(F.when(~local, F.regexp_extract(uses, "@(.*)$", 1)), F.lit("")).alias("ref"))


def docker_parts(image: Column) -> Column:
    """Host, image and tag of an image name."""
    first = F.substring_index(image, "/", 1)
    hosted = F.contains(image, F.lit("/")) & (first.rlike("[.:]") | (first == "localhost"))
    rest = F.when(hosted, F.regexp_replace(image, "^[^/]*/", "")).otherwise(image)
    return F.struct(F.when(hosted, first).alias("host"), F.regexp_replace(rest, ":[^:/]*$", "").alias("image"), F.nullif(F.regexp_extract(rest, ":([^:/]*)$", 1), F.lit("")).alias("tag"))


def load(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), prefix: str = PREFIX) -> Estate:
    """All tables of the estate under ``root``. The files are read and parsed once, now, into the session's shared folder."""
    return built(cut(parsed(scan(spark, root, exclude))), prefix)


def built(docs: DataFrame, prefix: str = PREFIX) -> Estate:
    """The tables of an estate from its parsed files (``parsed``)."""
    flows = docs.where("kind = 'workflow' and doc is not null").select("path", F.from_json("doc", WORKFLOW).alias("d"))
    acts = docs.where("kind = 'action' and doc is not null").select("path", F.from_json("doc", ACTION).alias("d"))
    workflows = flows.select(F.col("path").alias("wf_id"), "d.name", F.col("d.`run-name`").alias("run_name"), "d.permissions", plain(F.col("d.env")).alias("env"), "d.concurrency", "d.defaults")
    triggers = flows.select(F.col("path").alias("wf_id"), F.posexplode("d.on").alias("trig_ord", "t"))
    triggers = triggers.select("wf_id", "trig_ord", F.col("t.event").alias("event"), F.from_json("t.body", BODY).alias("b"), F.from_json("t.body", "array<struct<cron:string>>")["cron"].alias("crons"))
    triggers = triggers.select(
        "wf_id", "trig_ord", "event", strings(F.col("b.types")).alias("types"), *[ref_filter("b", w).alias(w) for w in ("branches", "tags", "paths")],
        strings(F.col("b.workflows")).alias("upstream"), *[plain(F.col(f"b.{w}")).alias(w) for w in ("inputs", "outputs", "secrets")], F.when(F.col("event") == "schedule", F.col("crons")).alias("crons"), (F.col("event") != "workflow_call").alias("is_entry"),
        F.coalesce(F.col(f"b.`{LINE}`"), F.lit(1)).alias("line"), F.col("b.__types_lines__").alias("types_lines"),
    )
    jobs = flows.select(F.col("path").alias("wf_id"), F.posexplode("d.jobs").alias("job_ord", "j"))
    jobs = jobs.select("wf_id", "job_ord", F.col("j.id").alias("job_id"), "j.body.*").withColumnRenamed(LINE, "line").withColumns({w: plain(F.col(w)) for w in ("with", "outputs", "env")}).withColumn("call", classified(F.col("uses"), job_level=True))
    in_jobs = jobs.select(F.lit("workflow").alias("owner_kind"), F.col("wf_id").alias("owner_id"), "job_ord", "job_id", F.col("if").alias("job_if"), F.posexplode("steps").alias("step_ord", "s"))
    kind = F.when(F.col("d.runs.using") == "composite", "composite").when(F.col("d.runs.using").startswith("node"), "node").when(F.col("d.runs.using") == "docker", "docker")
    actions = acts.select(folder_of(F.col("path")).alias("act_id"), F.col("path").alias("file"), "d.name", kind.alias("kind"), plain(F.col("d.inputs")).alias("inputs"), plain(F.col("d.outputs")).alias("outputs"), F.col("d.runs.steps").alias("steps"))
    composite = actions.where("kind = 'composite'").select(F.lit("action").alias("owner_kind"), F.col("act_id").alias("owner_id"), F.lit(0).alias("job_ord"), F.lit(None).cast("string").alias("job_id"), F.lit(None).cast("string").alias("job_if"), F.posexplode("steps").alias("step_ord", "s"))
    steps = in_jobs.unionByName(composite).select("owner_kind", "owner_id", "job_ord", "job_id", "job_if", "step_ord", "s.*").withColumnRenamed(LINE, "line").withColumns({w: plain(F.col(w)) for w in ("with", "env")}).withColumn("target", classified(F.col("uses")))
    actions = actions.where("kind is not null").drop("steps")
    broken = docs.where("problem is not null").select(F.col("path").alias("file"), F.lit(1).alias("line"), F.col("problem").alias("message"))
    odd = acts.where("d.runs.using is null or not (d.runs.using in ('composite', 'docker') or startswith(d.runs.using, 'node'))")
    odd = odd.select(F.col("path").alias("file"), F.lit(1).alias("line"), F.lit("unknown kind of action").alias("message"))
    bare = jobs.where("`runs-on` is null and uses is null").select(F.col("wf_id").alias("file"), "line", F.concat(F.lit("no runs-on in job "), "job_id").alias("message"))
    wrong = steps.where("target.kind = 'error'").select(F.col("owner_id").alias("file"), "line", F.concat(F.lit("no ref in uses "), "uses").alias("message"))
    notes = annotations(docs, jobs, steps, actions, prefix)
    late = notes.where("job_ord is null").select(F.col("owner_id").alias("file"), "line", F.lit("no job or step below the annotation").alias("message"))
    dangling = notes.where("reason is not null").select(F.col("owner_id").alias("file"), "line", F.concat(F.lit("annotation leads nowhere: "), "reason").alias("message"))
    found = [broken, odd, bare, wrong, late, dangling, *value_problems(workflows, triggers, jobs)]
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return Estate(workflows, triggers.drop("types_lines"), jobs.drop("steps"), actions, steps, notes, edges(jobs, steps, notes), found[0])


def value_problems(workflows: DataFrame, triggers: DataFrame, jobs: DataFrame) -> list[DataFrame]:
    """Values that mean nothing: activity types that the event doesn't have, malformed patterns, unknown permissions; file, line, message."""
    row = lambda file, line, message: [F.col(file).alias("file"), line.alias("line"), message.alias("message")]
    typed = triggers.select("wf_id", "event", "line", F.posexplode(F.arrays_zip("types", "types_lines")).alias("k", "t"), events.allowed_types(F.col("event")).alias("allowed"))
    unknown = typed.where("allowed is not null and not array_contains(allowed, t.types)")
    unknown = unknown.select(*row("wf_id", F.coalesce("t.types_lines", "line"), F.concat(F.lit("unknown activity type "), "t.types", F.lit(" of "), "event", F.lit("; valid are "), F.array_join("allowed", ", "))))
    wrong = triggers.select("wf_id", "line", F.explode(F.concat(*[globs.malformed(F.col(f"{w}.patterns")) for w in ("branches", "tags", "paths")])).alias("pattern"))
    wrong = wrong.select(*row("wf_id", F.col("line"), F.concat(F.lit("malformed pattern "), "pattern")))
    levels = workflows.select("wf_id", F.lit(1).alias("line"), "permissions").unionByName(jobs.select("wf_id", "line", "permissions"))
    levels = levels.withColumn("line", F.coalesce(F.get_json_object("permissions", f"$.{LINE}").cast("int"), "line")).select("wf_id", "line", F.explode(permissions.problems(F.col("permissions"))).alias("said"))
    return [unknown, wrong, levels.select(*row("wf_id", F.col("line"), F.col("said")))]


def annotations(docs: DataFrame, jobs: DataFrame, steps: DataFrame, actions: DataFrame, prefix: str) -> DataFrame:
    """Comments ``# <prefix>:<verb> <path>`` outside texts, at the next job or step below: file, line, verb, target, reason, job_ord, step_ord."""
    known = docs.where("doc is not null").select("path", "content", F.from_json("doc", "__texts__ array<array<int>>").alias("t"))
    lines = known.select("path", F.posexplode(F.split("content", "\n")).alias("p", "l")).where(F.col("l").rlike(rf"^\s*#\s*{prefix}:\S+"))
    parts = lines.select("path", (F.col("p") + 1).alias("line"), F.regexp_extract("l", rf"#\s*{prefix}:(\S+)\s*(\S*)", 1).alias("verb"), F.regexp_replace(F.regexp_extract("l", rf"#\s*{prefix}:(\S+)\s*(\S*)", 2), r"^(?:\./)+|(?<=.)/+$", "").alias("target"))
    ranges = known.select("path", F.explode("t.__texts__").alias("r")).select("path", F.col("r")[0].alias("lo"), F.col("r")[1].alias("hi"))
    free = joins.outside_ranges(parts, ranges, "path", "line", "lo", "hi", LINES)
    nodes = jobs.select(F.col("wf_id").alias("path"), "line", "job_ord", F.lit(-1).alias("step_ord")).unionByName(steps.where("owner_kind = 'workflow'").select(F.col("owner_id").alias("path"), "line", "job_ord", "step_ord"))
    inside = steps.where("owner_kind = 'action'").join(actions.select(F.col("act_id").alias("owner_id"), "file"), "owner_id")
    nodes = nodes.unionByName(inside.select(F.col("file").alias("path"), "line", "job_ord", "step_ord"))
    nodes = nodes.withColumn("node", F.struct("job_ord", "step_ord"))
    numbered = free.withColumn("note", F.col("line").cast("long"))
    at = joins.asof_forward(numbered, nodes, "path", "line", "note", "node", F.floor(F.col("line") / LINES)).select("path", "line", "node")
    t = F.col("target")
    reason = (
        F.when(~F.col("verb").isin("dispatches", "triggers"), "unknown verb")
        .when(t == "", "empty").when(t.startswith("/"), "not relative").when(F.exists(F.split(t, "/"), lambda s: s.isin("", ".", "..")), "bad segment")
        .when(~t.rlike(r"\.ya?ml$"), "not YAML").when(text.classify_target(t) != "workflow", "not a workflow")
    )
    return free.join(at, ["path", "line"], "left").select(F.col("path").alias("owner_id"), "line", "verb", "target", reason.alias("reason"), "node.job_ord", "node.step_ord")


def edges(jobs: DataFrame, steps: DataFrame, notes: DataFrame) -> DataFrame:
    """All edges in their fixed order: by job, at each its annotations in lines' order, its call, then its steps with annotations before uses.

    An annotation in a manifest belongs to the action, the manifest's folder; one whose target
    isn't a workflow's path is an edge to an ``unresolved`` end.
    """
    cols = ("src_kind", "src", "job_ord", "step_ord", "tier", "edge_kind", "dst_kind", "dst", "dst_ref", "job_if", "step_if", "at")
    null = F.lit(None).cast("string")
    call = jobs.where("call.kind is not null and call.kind <> 'error'").select(
        F.lit("workflow").alias("src_kind"), F.col("wf_id").alias("src"), "job_ord", F.lit(-1).alias("step_ord"), F.lit(1).alias("tier"), F.lit("call").alias("edge_kind"), F.col("call.kind").alias("dst_kind"), F.col("call.id").alias("dst"), F.col("call.ref").alias("dst_ref"), F.col("if").alias("job_if"), null.alias("step_if"), F.lit(0).alias("at")
    )
    use = steps.where("target.kind is not null and target.kind <> 'error'").select(
        F.col("owner_kind").alias("src_kind"), F.col("owner_id").alias("src"), "job_ord", "step_ord", F.lit(1).alias("tier"), F.lit("uses").alias("edge_kind"), F.col("target.kind").alias("dst_kind"), F.col("target.id").alias("dst"), F.col("target.ref").alias("dst_ref"), "job_if", F.col("if").alias("step_if"), F.lit(0).alias("at")
    )
    manifest = F.col("owner_id").rlike(r"(?:^|/)action\.ya?ml$")
    guards = steps.where("owner_kind = 'workflow'").select("owner_id", "job_ord", "step_ord", F.col("job_if").alias("note_job_if"), F.col("if").alias("note_if"))
    note = notes.join(guards, ["owner_id", "job_ord", "step_ord"], "left").select(
        F.when(manifest, "action").otherwise("workflow").alias("src_kind"), F.when(manifest, folder_of(F.col("owner_id"))).otherwise(F.col("owner_id")).alias("src"), F.coalesce("job_ord", F.lit(-1)).alias("job_ord"), F.coalesce("step_ord", F.lit(-1)).alias("step_ord"), F.lit(0).alias("tier"), F.col("verb").alias("edge_kind"), F.when(F.col("reason").isNull(), "local-workflow").otherwise("unresolved").alias("dst_kind"), F.col("target").alias("dst"), null.alias("dst_ref"), F.col("note_job_if").alias("job_if"), F.col("note_if").alias("step_if"), F.col("line").alias("at")
    )
    found = call.unionByName(use).unionByName(note).select(*cols)
    order = F.row_number().over(Window.partitionBy("src_kind", "src").orderBy("job_ord", "step_ord", "tier", "at", "dst"))
    return found.withColumn("edge_ord", order).drop("at")
