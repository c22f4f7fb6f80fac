"""Typed fields of jobs, and the browsable graph with findings, on a small estate and against walks on random ones."""

import json

import pytest
from pyspark.sql import functions as F

from flowloom.operators import browse, questions
from flowloom.sources import estate
from tests.test_enrich import described, written

FILES = {
    ".github/workflows/a.yml": """name: First
on: {pull_request_target: {}, push: {}, workflow_call: {}}
permissions: write-all
jobs:
  one:
    if: github.ref == 'x'
    runs-on: [self-hosted, 8, linux]
    needs: [two, three]
    strategy:
      fail-fast: false
      max-parallel: 2
      matrix:
        os: [ubuntu, {name: "a{\\"__line__\\":1", n: 1}, 3, true, null, 1.5, [x]]
        include: [{os: mac}]
        word: text
    environment: {name: prod, url: "https://x"}
    container: {image: "ghcr.io/o/i:1", credentials: {username: u, password: p}, env: {A: 1, B: true}, ports: ["80", 81], volumes: /v, options: --x}
    services: {db: {image: "postgres:16", credentials: {username: u}}, odd: {ports: ["1"]}, plain: redis}
    steps:
      - {id: s, name: N, if: always(), uses: ./act}
      - uses: docker://alpine:3
      - uses: o/r/sub@v1
      - uses: ./.github/workflows/b.yml
      - uses: ./gone
      # flowloom:dispatches .github/workflows/b.yml
      - run: x
  two: {runs-on: {group: g, labels: l}, needs: one, environment: stage, container: "img"}
  three: {uses: o/r/.github/workflows/x.yml@v2}
  four: {uses: ./.github/workflows/b.yml, runs-on: {labels: [p, 1]}, environment: {url: u}, strategy: text}
""",
    ".github/workflows/b.yml": "on: workflow_call\njobs:\n  n: {runs-on: x, steps: [{run: y}]}\n",
    "act/action.yml": "name: Act\nruns:\n  using: composite\n  steps:\n    - {run: x, if: never()}\n",
}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("browse")
    for name, content in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    return estate.load(spark, str(root))


def test_job_fields(small):
    one, two, three, four = (r.asDict(recursive=True) for r in questions.job_fields(small).where("wf_id like '%a.yml'").orderBy("job_ord").collect())
    assert one["runs_on"] == {"labels": ["self-hosted", "linux"], "group": None} and one["needs"] == ["two", "three"]
    assert two["runs_on"] == {"labels": ["l"], "group": "g"} and two["needs"] == ["one"]
    assert three["runs_on"] is None and three["needs"] == [] and four["runs_on"] == {"labels": ["p"], "group": None}
    assert (one["strategy"]["fail_fast"], one["strategy"]["max_parallel"], sorted(one["strategy"]["matrix"])) == (False, 2, ["include", "os"])
    assert [j["strategy"] for j in (two, three, four)] == [None] * 3
    assert one["environment"] == {"name": "prod", "url": "https://x"} and two["environment"] == {"name": "stage", "url": None} and four["environment"] is None
    assert one["container"] == {"image": "ghcr.io/o/i:1", "credentials": {"username": "u", "password": "p"}, "env": {"A": "1", "B": "true"}, "ports": ["80"], "volumes": ["/v"], "options": "--x"}
    assert two["container"]["image"] == "img" and two["container"]["env"] == {} and three["container"] is None
    assert {k: (v["image"], v["credentials"]) for k, v in one["services"].items()} == {"db": ("postgres:16", None), "plain": ("redis", None)} and two["services"] == {}


def test_matrix_and_images(small):
    got = questions.matrix(small).select("dimension", "pos", F.to_json("value").alias("v")).orderBy("dimension", "pos").collect()
    assert [(r[0], r[1], json.loads(r[2])) for r in got] == [("include", 0, {"os": "mac"}), *(("os", k, v) for k, v in enumerate(["ubuntu", {"name": 'a{"__line__":1', "n": 1}, 3, True]))]
    assert {tuple(r) for r in questions.images(small).collect()} == {
        ("workflow:.github/workflows/a.yml", "one", "container", None, "ghcr.io", "o/i", "1"), ("workflow:.github/workflows/a.yml", "two", "container", None, None, "img", None),
        ("workflow:.github/workflows/a.yml", "one", "service", "db", None, "postgres", "16"), ("workflow:.github/workflows/a.yml", "one", "service", "plain", None, "redis", None),
        ("workflow:.github/workflows/a.yml", "one", "step", "1", None, "alpine", "3"),
    }


A, B = "wf:.github/workflows/a.yml", "wf:.github/workflows/b.yml"


def test_graph(small):
    assert {tuple(r) for r in browse.nodes(small).collect()} == {
        (A, "First", "workflow"), (B, ".github/workflows/b.yml", "workflow"), ("la:act", "Act", "local-action"), ("ea:o/r/sub@v1", "o/r/sub@v1", "external-action"),
        ("ew:o/r/.github/workflows/x.yml@v2", "o/r/.github/workflows/x.yml@v2", "external-workflow"), ("dk:alpine:3", "alpine:3", "docker"),
    }
    ends = [("la:act", "uses-local-action"), ("dk:alpine:3", "uses-docker"), ("ea:o/r/sub@v1", "uses-external-action"), (B, "uses-local-workflow"), (B, "annotation"), ("ew:o/r/.github/workflows/x.yml@v2", "calls-workflow"), (B, "calls-workflow")]
    assert [tuple(r) for r in browse.edges(small).orderBy("pos").collect()] == [(k, A, t, kind) for k, (t, kind) in enumerate(ends)]


def test_details(small):
    got = {r["id"]: r for r in browse.details(small).collect()}
    assert set(got) == {A, B, "la:act", "ea:o/r/sub@v1"}
    assert (got[A]["summary"], got[A]["file"], sorted(got[A]["entry_triggers"])) == ("4 job(s), 3 trigger(s)", A[3:], ["pull_request_target", "push"])
    assert [tuple(c) for c in got[A]["if_conditions"]] == [("one", None, None, None, "github.ref == 'x'"), ("one", 1, "s", "N", "always()")]
    assert (got["la:act"]["summary"], got["la:act"]["file"], [tuple(c) for c in got["la:act"]["if_conditions"]]) == ("composite; 1 step(s)", "act/action.yml", [(None, 1, None, None, "never()")])
    assert (got["ea:o/r/sub@v1"]["summary"], got["ea:o/r/sub@v1"]["file"], got["ea:o/r/sub@v1"]["if_conditions"]) == ("o/r@v1", "", [])
    assert (got[B]["entry_triggers"], got[B]["if_conditions"], got[B]["summary"]) == ([], [], "1 job(s), 1 trigger(s)")


def test_overlay(spark, small):
    found = spark.createDataFrame([(B[3:], None, "high", "zizmor"), (B[3:], 3, "info", "Other"), ("none.rs", 1, "error", "x")], "path string, start_line int, severity string, source string")
    nodes, edges = browse.overlaid(small, found)
    rows = {r["id"]: r.asDict() for r in nodes.collect()}
    assert {k: rows[B][k] for k in ("error", "high", "info", "total", "reachable_from_risky", "is_orphan", "has_write", "sources")} == {"error": 0, "high": 1, "info": 1, "total": 2, "reachable_from_risky": True, "is_orphan": False, "has_write": False, "sources": ["Other", "zizmor"]}
    assert rows[A]["total"] == 0 and rows[A]["sources"] == [] and len(rows) == 6
    assert {(r["target"], r["on_dangerous_path"]) for r in edges.collect()} == {(B, True), ("la:act", False), ("dk:alpine:3", False), ("ea:o/r/sub@v1", False), ("ew:o/r/.github/workflows/x.yml@v2", False)}
    bare, _ = browse.overlaid(small, found.where("false"))
    assert bare.where("total > 0 or is_orphan or has_write").count() == 0


@pytest.mark.parametrize("seed", [3])
def test_dangerous_equals_a_walk(spark, tmp_path, seed):
    flows, acts, model = described(seed)
    written(tmp_path, flows, acts, model)
    loaded = estate.load(spark, str(tmp_path))
    hit = flows[1]
    _, edges = browse.overlaid(loaded, spark.createDataFrame([(hit, None, "low", "t")], "path string, start_line int, severity string, source string"))
    rows = edges.collect()
    pairs = {(r["source"], r["target"]) for r in rows}

    def reach(start, links):
        seen, todo = set(start), list(start)
        while todo:
            n = todo.pop()
            for s, t in links:
                if s == n and t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    down = reach({f"wf:{f}" for f in flows if {"pull_request_target", "workflow_run"} & set(model[f]["events"])}, pairs)
    up = reach({f"wf:{hit}"}, {(t, s) for s, t in pairs})
    assert rows and all(r["on_dangerous_path"] == (r["source"] in down and r["target"] in up) for r in rows)


def test_line_items_are_not_sorted_to_find_their_orders(spark):
    from flowloom.plans import audits

    plan = audits.browse_edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ShuffledHashJoin [l_orderkey") == 2
