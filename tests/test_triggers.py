"""Filter patterns in columns, the reader's odd cases, and traces by ref, path and activity."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from flowloom.functions import globs
from flowloom.operators import questions
from flowloom.sources import estate
from flowloom.sources.yaml_text import to_json


def make(spark, tmp_path, files):
    for path, content in files.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(content)
    return estate.load(spark, str(tmp_path))


def push(filters):
    return f"on:\n  push:\n{filters}jobs:\n  noop:\n    runs-on: x\n    steps: [{{run: echo}}]\n"


def traced(loaded, event="push", **how):
    return {r["node"].rsplit("/", 1)[-1].removesuffix(".yml") for r in questions.started(loaded, event, **how).collect()}


PUSHES = {
    "main-only": "    branches: [main]\n", "feat-only": "    branches: ['feat/*']\n", "ignore-main": "    branches-ignore: [main]\n", "v-tag": "    tags: ['v*']\n", "rel-tag": "    tags: ['release-*']\n",
    "both": "    branches: [main]\n    tags: ['v*']\n", "none": "", "src": "    paths: ['src/**']\n", "not-docs": "    paths-ignore: ['docs/**']\n", "main-src": "    branches: [main]\n    paths: ['src/**']\n",
    "tag-paths": "    tags: ['v*']\n    paths: ['src/**']\n", "releases": "    branches: ['releases/**', '!releases/**-alpha']\n", "broken": "    branches: ['[main', main2]\n", "only-no": "    branches: ['!main']\n",
}


@pytest.fixture(scope="module")
def pushes(spark, tmp_path_factory):
    return make(spark, tmp_path_factory.mktemp("pushes"), {f".github/workflows/{name}.yml": push(f) for name, f in PUSHES.items()})


@pytest.mark.parametrize(
    "how, expected",
    [
        ({"branches": ["main"]}, "main-only both none src not-docs main-src"),
        ({"branches": ["feat/a"]}, "feat-only ignore-main none src not-docs"),
        ({"branches": ["feat/a/b"]}, "ignore-main none src not-docs"),
        ({"tags": ["v1.0"]}, "v-tag both none src not-docs tag-paths"),
        ({"paths": ["src/foo.rs"]}, "main-only feat-only ignore-main both none src not-docs main-src releases broken only-no"),
        ({"paths": ["docs/x.md"]}, "main-only feat-only ignore-main both none releases broken only-no"),
        ({"branches": ["main"], "paths": ["src/foo.rs"]}, "main-only both none src not-docs main-src"),
        ({"branches": ["main"], "paths": ["docs/x.md"]}, "main-only both none"),
        ({"branches": ["main"], "tags": ["v1.0.0"]}, "both none src not-docs"),
        ({"tags": ["v1.0.0"], "paths": ["docs/x.md"]}, "v-tag both none src not-docs tag-paths"),
        ({"branches": ["releases/10"]}, "ignore-main none src not-docs releases"),
        ({"branches": ["releases/10-alpha"]}, "ignore-main none src not-docs"),
        ({"branches": ["main2", "feat/a"]}, "feat-only ignore-main none src not-docs broken"),
        ({}, " ".join(PUSHES)),
    ],
)
def test_pushes(pushes, how, expected):
    assert traced(pushes, **how) == set(expected.split())


def test_a_trace_begins_where_the_event_starts(pushes):
    rows = questions.trace(pushes, "push", branches=["feat/a"]).where("depth = 0").collect()
    assert {r["node"].rsplit("/", 1)[-1] for r in rows} == {f"{n}.yml" for n in ("feat-only", "ignore-main", "none", "src", "not-docs")}


def test_malformed_patterns_are_diagnostics(pushes):
    assert [(r["file"], r["line"], r["message"]) for r in pushes.diagnostics.collect()] == [(".github/workflows/broken.yml", 3, "malformed pattern [main")]


def test_activities(spark, tmp_path):
    flows = {
        "closed": "on:\n  pull_request:\n    types: [closed, opend]\n", "bare": "on: pull_request\n", "issues": "on:\n  issues:\n    types: opened\n", "all": "on: issues\n", "empty": "on:\n  pull_request:\n    types: []\n",
        "custom": "on:\n  repository_dispatch:\n    types: [anything]\n", "called": "on:\n  workflow_call:\n  push:\n", "two": "on:\n  pull_request_target:\n  pull_request:\n    types:\n      - labeled\n      - wrong\n",
    }
    loaded = make(spark, tmp_path, {f".github/workflows/{n}.yml": f + "permissions: {colour: read}\njobs: {a: {runs-on: x, permissions: sometimes}}\n" if n == "all" else f + "jobs: {a: {runs-on: x}}\n" for n, f in flows.items()})
    assert traced(loaded, "pull_request", types=["opened"]) == {"bare"}
    assert traced(loaded, "pull_request", types=["labeled", "closed"]) == {"closed", "two"}
    assert traced(loaded, "issues", types=["closed"]) == {"all"} and traced(loaded, "issues") == {"issues", "all"}
    assert traced(loaded, "workflow_call") == set() and traced(loaded, "push", types=["x"]) == {"called"}
    said = {(r["node"].rsplit("/", 1)[-1], r["event"]): (r["types_kind"], r["types_line"]) for e in ("pull_request", "issues", "repository_dispatch", "push") for r in questions.started(loaded, e).collect()}
    assert said == {
        ("closed.yml", "pull_request"): ("explicit", "types: closed, opend"), ("bare.yml", "pull_request"): ("implicit-default", "types: opened, synchronize, reopened (default)"), ("empty.yml", "pull_request"): ("explicit", "types: "),
        ("two.yml", "pull_request"): ("explicit", "types: labeled, wrong"), ("issues.yml", "issues"): ("explicit", "types: opened"), ("all.yml", "issues"): ("implicit-all", "types: any"),
        ("custom.yml", "repository_dispatch"): ("explicit", "types: anything"), ("called.yml", "push"): (None, None),
    }
    problems = sorted((r["file"].rsplit("/", 1)[-1], r["line"], r["message"].split(";")[0]) for r in loaded.diagnostics.collect())
    assert problems == [("all.yml", 2, "unknown scope colour"), ("all.yml", 3, "unknown permissions sometimes"), ("closed.yml", 3, "unknown activity type opend of pull_request"), ("two.yml", 6, "unknown activity type wrong of pull_request")]


def by_hand(pattern, value):
    """A pattern matched with backtracking, part by part."""
    parts, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k):
            parts, k = [*parts, ["folders"]], k + 3
        elif pattern.startswith("**", k):
            parts, k = [*parts, ["any"]], k + 2
        elif c == "*":
            parts, k = [*parts, ["star"]], k + 1
        elif c in "?+" and k:
            parts[-1].append(c)
            k += 1
        elif c == "[":
            end = pattern.find("]", k)
            if end in (-1, k + 1):
                return None
            body, chars, j = pattern[k + 1 : end], set(), 0
            while j < len(body):
                if j + 2 < len(body) and body[j + 1] == "-":
                    if body[j] > body[j + 2]:
                        return None
                    chars |= {chr(x) for x in range(ord(body[j]), ord(body[j + 2]) + 1)}
                    j += 3
                else:
                    chars.add(body[j])
                    j += 1
            parts, k = [*parts, [frozenset(chars)]], end + 1
        elif c == "\\":
            if k + 1 == len(pattern):
                return None
            parts, k = [*parts, [frozenset(pattern[k + 1])]], k + 2
        else:
            parts, k = [*parts, [frozenset(c)]], k + 1

    def ends(part, at):
        kind, *run = part
        if kind == "folders":
            return {at} | {j + 1 for j in range(at + 1, len(value)) if value[j] == "/"}
        if kind in ("any", "star"):
            stop = len(value) if kind == "any" else next((j for j in range(at, len(value)) if value[j] == "/"), len(value))
            return set(range(at, stop + 1))
        none = many = fresh = False
        for q in run:
            if q == "?" and fresh:
                fresh = False
            else:
                none, many, fresh = none or q == "?", many or q == "+", True
        out, j = ({at} if none else set()), at
        while j < len(value) and value[j] in kind:
            j += 1
            out.add(j)
            if not many:
                break
        return out

    places = {0}
    for part in parts:
        places = {e for p in places for e in ends(part, p)}
    return len(value) in places


def test_patterns_equal_a_walk(spark):
    rnd = random.Random(4)
    pieces = ["a", "b", "c", "/", "*", "**", "**/", "?", "+", "[ab]", "[a-c]", "[c-a]", "[", "]", "\\", "\\*", "!", ".", "-", "é", "^", "$", "{", "|", "(", "[^a]", "[]"]
    patterns = ["".join(rnd.choices(pieces, k=rnd.randint(0, 5))) for _ in range(1500)]
    values = ["".join(rnd.choices("abc/*.-é^!", k=rnd.randint(0, 5))) for _ in range(1500)]
    values = [v if rnd.random() < 0.6 else re.sub(r"[\\\[\]?+]", "", p).replace("**/", "b/").replace("*", "a") for p, v in zip(patterns, values)]
    df = spark.createDataFrame(list(enumerate(zip(patterns, values))), "k int, x struct<p:string,v:string>").repartition(3)
    regex = globs.regex(F.col("x.p"))
    got = {r["k"]: r["hit"] for r in df.select("k", F.when(regex.isNotNull(), F.rlike(F.col("x.v"), regex)).alias("hit")).collect()}
    wrong = [(p, v, got[k], by_hand(p, v)) for k, (p, v) in enumerate(zip(patterns, values)) if got[k] != by_hand(p, v)]
    assert not wrong
    assert sum(g is True for g in got.values()) > 100 and sum(g is None for g in got.values()) > 100


def test_scalars_and_broken_files():
    read = lambda s: json.loads(to_json(s, "x")[0])
    got = read("on: push\nv: [08, 020, 0x1F, 0o17, 1e3, .5, -7, '08', on, yes, true, ~, !!str 5, !!int 5, !own x, 2001-01-01, .inf, 1_000]\n")
    assert got["v"] == [8, 20, 31, 15, 1000.0, 0.5, -7, "08", "on", "yes", True, None, "5", 5, "x", "2001-01-01", ".inf", "1_000"]
    for bad, said in (("a: !!int x\n", "not of kind int"), ("a: &a [*a]\n", "alias to what holds it"), ("a: " + "[" * 3000 + "]" * 3000, ""), ("- a\n", "not a mapping"), ("a: [\n", ""), ("a: *gone\n", "undefined alias")):
        doc, problem = to_json(bad, "x")
        assert doc is None and said in problem
    bomb = "a0: &a0 [x, x]\n" + "".join(f"a{k}: &a{k} [*a{k - 1}, *a{k - 1}]\n" for k in range(1, 40))
    assert to_json(bomb, "x") == (None, "more than 1000000 values")
    assert read("on: push\nb: &b {c: 1}\nd: *b\n")["d"]["c"] == 1


def test_loading_again_sees_changes_and_no_folder_is_no_workflows(spark, tmp_path):
    loaded = make(spark, tmp_path, {"tools/a/action.yml": "runs: {using: docker, image: x}\n"})
    assert loaded.workflows.count() == 0 and loaded.actions.count() == 1 and loaded.diagnostics.count() == 0
    files = {f".github/workflows/{n}.yml": push("") for n in "ab"}
    assert make(spark, tmp_path, files).workflows.count() == 2
    again = make(spark, tmp_path, {".github/workflows/c.yml": push(""), ".github/workflows/08.yml": "on: push\njobs: {a: {runs-on: x, steps: [{uses: a/b@v1, with: {node-version: 08}}]}}\n", ".github/workflows/no.yml": "a: !!int x\n"})
    assert again.workflows.count() == 4
    assert again.steps.where("uses is not null").select("with").first()["with"] == {"node-version": "8"}
    assert [r["file"] for r in again.diagnostics.collect()] == [".github/workflows/no.yml"]


def test_annotations_in_line_order_and_refs(spark, tmp_path):
    flow = "on: push\njobs:\n  # flowloom:dispatches ./.github/workflows/zz.yml\n  # flowloom:triggers .github/workflows/aa.yml\n  j:\n    runs-on: x\n    steps: [{uses: a/b@v1}, {uses: a/b@v2}]\n"
    loaded = make(spark, tmp_path, {".github/workflows/x.yml": flow, ".github/workflows/zz.yml": push(""), ".github/workflows/aa.yml": push("")})
    rows = questions.trace(loaded, "push").where("root like '%x.yml'").orderBy("pos").collect()
    assert [r["node"] for r in rows] == ["workflow:.github/workflows/x.yml", "workflow:.github/workflows/zz.yml", "workflow:.github/workflows/aa.yml", "external-action:a/b@v1", "external-action:a/b@v2"]
    assert loaded.diagnostics.count() == 0
