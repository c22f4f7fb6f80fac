"""Traces as documents, and their order without a window over a root."""

import json
import random

from pyspark.sql import functions as F

from flowloom.operators import graph, questions

from .test_questions import CI, DEPLOY, LEAF, NIGHTLY, loaded  # noqa: F401


def test_documents(loaded):  # noqa: F811
    rows = questions.trace_documents(loaded, "push").collect()
    assert [r["root"] for r in rows] == [CI]
    got = json.loads(rows[0]["document"])
    assert got["trigger"] == {"event": "push"}
    out = {"kind": "external-action", "owner": "a", "repo": "b", "gitref": "v1"}
    night = lambda verb: {"kind": "annotated", "verb": verb, "dangling": False, "label": NIGHTLY, "children": [{"kind": "workflow", "id": NIGHTLY, "children": [out]}]}
    guarded = lambda expr, inner: {"kind": "guarded", "if_expr": expr, "inner": inner}
    assert got["root"] == {"kind": "workflow", "id": CI, "children": [
        guarded("(github.ref == 'a') && (always())", {"kind": "action", "id": "tools/lint", "children": [night("triggers"), {"kind": "action", "id": "tools/lint/deep", "children": []}]}),
        guarded("(github.ref == 'a') && (ok())", night("dispatches")),
        guarded("github.ref == 'a'", {"kind": "action", "id": "tools/absent", "children": []}),
        {"kind": "workflow", "id": DEPLOY, "children": [{"kind": "workflow", "id": LEAF, "children": [{"kind": "cycle", "target_kind": "workflow", "target": DEPLOY}]}]},
    ]}
    assert questions.trace_documents(loaded, "release").count() == 0


def test_types_in_documents(spark, tmp_path):
    from flowloom.sources import estate

    for name, on in {"a": "pull_request", "b": "{pull_request: {types: [closed]}}", "c": "issues"}.items():
        (tmp_path / ".github/workflows").mkdir(parents=True, exist_ok=True)
        (tmp_path / f".github/workflows/{name}.yml").write_text(f'on: {on}\njobs:\n  # flowloom:dispatches lost"path\n  j: {{runs-on: x, steps: [{{uses: "docker://i:1"}}]}}\n')
    found = estate.load(spark, str(tmp_path))
    docs = {r["root"][-5]: json.loads(r["document"]) for e in ("pull_request", "issues") for r in questions.trace_documents(found, e).collect()}
    assert {k: d["trigger"].get("types") for k, d in docs.items()} == {
        "a": {"kind": "implicit-default", "values": ["opened", "synchronize", "reopened"]}, "b": {"kind": "explicit", "values": ["closed"]}, "c": {"kind": "implicit-all"},
    }
    assert docs["a"]["root"]["children"] == [{"kind": "annotated", "verb": "dispatches", "dangling": True, "label": 'lost"path', "children": []}, {"kind": "docker", "image": "i:1"}]


def test_places_of_roots(spark):
    dice = random.Random(2)
    edges = [(a, b, k) for k, (a, b) in enumerate((dice.randint(0, 9), dice.randint(0, 9)) for _ in range(14))]
    found = graph.paths(spark.createDataFrame(edges, "src long, dst long, ord long"), spark.createDataFrame([(0,), (3,), (5,)], "node long"))
    rows = graph.preorder(found.withColumn("x", F.lit(1))).collect()
    for root in (0, 3, 5):
        mine = sorted((r for r in rows if r["root"] == root), key=lambda r: r["sort_key"])
        assert [r["pos"] for r in mine] == list(range(1, len(mine) + 1))
