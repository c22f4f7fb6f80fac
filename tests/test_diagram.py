"""The diagram of an estate, line by line."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.functions.ranks import numbered
from flowloom.operators.diagram import diagram
from flowloom.sources import estate

W = ".github/workflows/"
FILES = {
    f"{W}ci.yml": 'name: "CI [x] <1>"\non: {push: {}, pull_request: {}, fork: {}}\njobs:\n  # flowloom:dispatches .github/workflows/night.yml\n  b:\n    runs-on: x\n    steps:\n'
    "      - uses: ./tools/a\n      - uses: actions/checkout@v4\n      - uses: docker://ghcr.io/o/i:1\n      - uses: docker://alpine\n      - uses: ./tools/gone\n      - uses: o/r/sub@v1\n  c: {uses: ./.github/workflows/called.yml}\n  d: {uses: o/r/.github/workflows/x.yml@v2}\n  e: {uses: ./.github/workflows/none.yml}\n",
    f"{W}called.yml": "on: workflow_call\njobs:\n  j:\n    runs-on: x\n    steps: [{uses: actions/checkout@v4}]\n",
    f"{W}night.yml": "name: Night\non: workflow_dispatch\njobs: {j: {runs-on: x, steps: [{uses: actions/cache@v3}]}}\n",
    f"{W}after.yml": "on: {workflow_run: {workflows: [Night, Ghost]}}\njobs: {j: {runs-on: x, steps: [{run: echo}]}}\n",
    f"{W}alone.yml": "on: workflow_call\njobs: {j: {runs-on: x, steps: [{uses: never/seen@v9}]}}\n",
    "tools/a/action.yml": "name: A\nruns:\n  using: composite\n  steps:\n    # flowloom:triggers .github/workflows/night.yml\n    - uses: ./tools/b\n",
    "tools/b/action.yml": "runs: {using: node20}\n",
    "tools/c/action.yml": "runs: {using: node20}\n",
}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("drawn")
    for path, content in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    return estate.load(spark, str(root))


def lines(df):
    rows = df.orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(len(rows)))
    return [r["line"] for r in rows]


CI = f"{W}ci.yml<br/>CI [x&#93; #lt;1#gt;"


def test_all_of_it(loaded):
    """Workflows are numbered by path: after 0, alone 1, called 2, ci 3, night 4."""
    drawn = [f"{{}} --> {t}" for t in ("act_0", "dock_0", "dock_1", "ext_1", "ext_3", "extwf_0", "wf_2")]
    assert lines(diagram(loaded)) == [
        "%% generated by flowloom", "graph LR",
        "subgraph push", f'  wf_3__push["{CI}"]', "end",
        "subgraph pull_request", f'  wf_3__pull_request["{CI}"]', "end",
        "subgraph workflow_dispatch", f'  wf_4__workflow_dispatch["{W}night.yml<br/>Night"]', "end",
        "subgraph workflow_run", f'  wf_0__workflow_run["{W}after.yml"]', "end",
        "subgraph fork", f'  wf_3__fork["{CI}"]', "end",
        f'wf_2["{W}called.yml"]', f'wf_4["{W}night.yml<br/>Night"]',
        'act_0["tools/a<br/>A"]', 'act_1["tools/b"]',
        'ext_0["actions/cache@v3"]', 'ext_1["actions/checkout@v4"]', 'ext_3["o/r/sub@v1"]',
        'dock_0["alpine"]', 'dock_1["ghcr.io/o/i:1"]',
        'extwf_0["o/r/.github/workflows/x.yml@v2"]',
        "%% workflow_run unresolved: Ghost",
        "%% unresolved local-action: tools/gone", f"%% unresolved local-workflow: {W}none.yml",
        "act_0 --> act_1",
        "wf_2 --> ext_1",
        *[d.format("wf_3__fork") for d in drawn], *[d.format("wf_3__pull_request") for d in drawn], *[d.format("wf_3__push") for d in drawn],
        "wf_4 -->|workflow_run| wf_0__workflow_run", "wf_4__workflow_dispatch --> ext_0",
        "act_0 -. triggers .-> wf_4", "wf_3__fork -. dispatches .-> wf_4", "wf_3__pull_request -. dispatches .-> wf_4", "wf_3__push -. dispatches .-> wf_4",
        "classDef flowloomAnnotation stroke:#dca,stroke-dasharray:5 5",
    ]


def test_one_event(loaded):
    """Night is drawn as what annotations lead to, without edges of its own: it is no entry of this event."""
    got = lines(diagram(loaded, "push"))
    assert [x for x in got if x.startswith("subgraph")] == ["subgraph push"] and f'wf_4["{W}night.yml<br/>Night"]' in got
    assert not any("workflow_run" in x or x.startswith("wf_4 ") for x in got) and 'ext_0["actions/cache@v3"]' in got
    assert lines(diagram(loaded, "release")) == ["%% generated by flowloom", "graph LR", "%% (no entry-point matches event release)"]


def test_findings_on_it(spark, loaded):
    marks = spark.createDataFrame([(f"workflow:{W}night.yml", "H:2 <", "fill:#f8d7da"), ("action:tools/b", "", ""), ("action:tools/c", "L:1", "fill:#fff")], "node string, badge string, style string")
    got = lines(diagram(loaded, None, marks))
    assert f'wf_4["{W}night.yml<br/>Night<br/>H:2 #lt;"]' in got and f'  wf_4__workflow_dispatch["{W}night.yml<br/>Night<br/>H:2 #lt;"]' in got and 'act_1["tools/b"]' in got
    assert got[-2:] == ["style wf_4 fill:#f8d7da", "style wf_4__workflow_dispatch fill:#f8d7da"]


def test_places_in_a_global_order(spark):
    dice = random.Random(1)
    rows = [(dice.randint(0, 50), None if dice.random() < 0.1 else f"k{dice.randint(0, 99)}") for _ in range(3000)]
    got = numbered(spark.createDataFrame(rows, "a int, b string").repartition(5).withColumn("c", F.lit(1)), ["a", "b"], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(3000))
    assert [(r["a"], r["b"] or "") for r in got] == sorted((a, b or "") for a, b in rows)
    assert numbered(spark.createDataFrame([], "a int"), ["a"], "n").count() == 0
