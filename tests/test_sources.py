import re
import json

import pytest

from flowloom.operators import graph
from flowloom.sources import estate, render, sarif

CALLER = """name: Caller
on:
  push:
    branches: [main, 'release/**']
  pull_request:
    types: []
  workflow_call:
jobs:
  # flowloom:dispatches .github/workflows/other.yml
  first:
    uses: ./.github/workflows/leaf.yml
    secrets: inherit
    if: github.ref == 'x'
  second:
    runs-on: ubuntu-latest
    steps:
      - uses: actions/checkout@v4
      - uses: ./tools/act
        if: runner.os == 'Linux'
      - run: |
          # flowloom:dispatches .github/workflows/in-text.yml
          echo on
      - uses: docker://ghcr.io/a/b:1.2
      - uses: broken
"""
LEAF = "on: workflow_call\njobs:\n  only:\n    steps: [{run: 'yes'}]\n"
ACT = "name: Act\nruns:\n  using: composite\n  steps:\n    - uses: ./.github/workflows/leaf.yml\n    - run: x\n"


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("estate")
    for path, content in {
        ".github/workflows/caller.yml": CALLER, ".github/workflows/leaf.yml": LEAF, ".github/workflows/bad.yaml": "on: [push\n", ".github/workflows/sub/skipped.yml": LEAF,
        "tools/act/action.yml": "runs: {using: node20}", "tools/act/action.yaml": ACT, "node_modules/x/action.yml": ACT, "odd/action.yml": "name: odd", "gone/action.yml": ACT,
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    return estate.load(spark, str(root), exclude=("gone/**",))


def test_triggers_keep_order_and_filters(loaded):
    rows = {r["event"]: r for r in loaded.triggers.where("wf_id like '%caller.yml'").collect()}
    assert [r["event"] for r in sorted(rows.values(), key=lambda r: r["trig_ord"])] == ["push", "pull_request", "workflow_call"]
    assert rows["push"]["branches"].asDict() == {"kind": "include", "patterns": ["main", "release/**"]}
    assert rows["push"]["types"] is None and rows["pull_request"]["types"] == []
    assert not rows["workflow_call"]["is_entry"]


def test_edges_in_order(loaded):
    rows = loaded.edges.where("src like '%caller.yml'").orderBy("edge_ord").collect()
    assert [(r["edge_kind"], r["dst_kind"], r["dst"]) for r in rows] == [
        ("dispatches", "local-workflow", ".github/workflows/other.yml"),
        ("call", "local-workflow", ".github/workflows/leaf.yml"),
        ("uses", "external-action", "actions/checkout"),
        ("uses", "local-action", "tools/act"),
        ("uses", "docker", "ghcr.io/a/b:1.2"),
    ]
    assert rows[3]["step_if"] == "runner.os == 'Linux'" and rows[1]["job_if"] == "github.ref == 'x'"


def test_actions_one_for_each_folder(loaded):
    assert {(r["act_id"], r["kind"]) for r in loaded.actions.collect()} == {("tools/act", "composite")}


def test_diagnostics(loaded):
    said = {(r["file"].rsplit("/", 1)[-1], r["message"].split()[0]) for r in loaded.diagnostics.collect()}
    assert ("action.yml", "unknown") in said and any(f == "bad.yaml" for f, _ in said)
    assert ("leaf.yml", "no") in said and ("caller.yml", "no") in said


def test_closure_over_the_estate(spark, loaded):
    seeds = loaded.triggers.where("is_entry").select(loaded.triggers["wf_id"].alias("node"))
    edges = loaded.edges.where("dst_kind like 'local-%'").select("src", "dst")
    reached = {r["node"]: r["depth"] for r in graph.closure(edges, seeds).collect()}
    assert reached == {".github/workflows/caller.yml": 0, ".github/workflows/leaf.yml": 1, ".github/workflows/other.yml": 1, "tools/act": 1}


def test_sarif(spark, tmp_path):
    doc = {"runs": [{"tool": {"driver": {"name": "Zizmor", "rules": [{"id": "r", "properties": {"security-severity": "8.1", "tags": ["a"]}}, {"id": "q"}]}}, "results": [
        {"ruleId": "r", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "file://a\\b.yml"}, "region": {"startLine": 3}}}]},
        {"ruleId": "q", "level": "note", "properties": {"security-severity": "odd"}}, {"ruleId": "none", "rank": 55.0}]}]}
    (tmp_path / "x.sarif").write_text(json.dumps(doc))
    rows = {r["rule_id"]: r for r in sarif.read(spark, str(tmp_path)).collect()}
    assert rows["r"]["severity"] == "high" and rows["r"]["id"] == "zizmor:r:a/b.yml:3:?" and rows["r"]["tags"] == ["a"]
    assert rows["q"]["severity"] == "low" and rows["none"]["severity"] == "medium"


def test_renderers(spark):
    df = spark.createDataFrame([("a|b", 1), ("漢", None)], "x string, n int")
    assert render.markdown(df).splitlines()[2] == "| a\\|b | 1 |"
    assert render.text_table(df).splitlines()[2] == "漢"
    assert render.tree([(0, "r"), (1, "a"), (2, "b"), (1, "c")]) == "r\n├─ a\n│  └─ b\n└─ c"


def test_targets_uses_and_globs(spark):
    from pyspark.sql import functions as F

    from flowloom.functions import text

    def each(function, values):
        return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").orderBy("k").select(function(F.col("v"))).collect()]

    paths = ["././.github/workflows/a/x.yml", ".github/workflows/b.yaml/", "/.github/workflows/b.yml", ".github/workflows/b.txt", "sub/action"]
    assert each(text.classify_target, paths) == ["workflow", "workflow", "action", "action", "action"]
    uses = [" ./.github/workflows/a/x.yml", "$/tools/lint/", "./", "/abs/x@v1", "broken@v1", "owner/repo/sub@v1", "docker://alpine:3", None]
    assert [(c["kind"], c["id"]) for c in each(estate.classified, uses)] == [
        ("local-workflow", ".github/workflows/a/x.yml"), ("local-action", "tools/lint"), ("local-action", "."), ("external-action", "/abs/x"),
        ("error", "broken"), ("external-action", "owner/repo/sub"), ("docker", "alpine:3"), (None, None),
    ]
    cases = {"vendor/*": "vendor/a/b/action.yml", "**/old/**": "x/old/y/action.yml", "a?b": "a/b", "{x,y}/[!a]*": "y/b/action.yml", "a,b": "a,b"}
    assert all(re.search(estate.file_glob(g), p) for g, p in cases.items())
    assert not re.search(estate.file_glob("vendor/*"), "my/vendor/x") and not re.search(estate.file_glob("{x,y}/[!a]*"), "y/a")
    with pytest.raises(ValueError):
        text.glob_to_regex("release[]")
