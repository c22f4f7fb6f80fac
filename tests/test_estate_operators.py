import random

import pytest

from flowloom.functions import text
from flowloom.operators import dedup, graph, permissions, search
from flowloom.sources import estate, render, store
from flowloom.streaming import refresh
from pyspark.sql import functions as F

FLOWS = {
    "broad.yml": "on: push\npermissions: write-all\njobs:\n  a: {runs-on: x, permissions: write-all, steps: []}\n  b: {runs-on: x, steps: []}\n",
    "bare.yml": "on: push\njobs:\n  z: {runs-on: x, steps: []}\n  m: {runs-on: x, permissions: {}, steps: []}\n  a: {runs-on: x, steps: []}\n",
    "called.yml": "on: workflow_call\npermissions: write-all\njobs:\n  a: {runs-on: x, steps: []}\n",
    "map.yml": "on: push\npermissions: {contents: read, issues: write, colour: read, pages: most}\njobs:\n  a: {runs-on: x, permissions: odd, steps: []}\n",
}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("flows")
    (root / ".github/workflows").mkdir(parents=True)
    for name, content in FLOWS.items():
        (root / ".github/workflows" / name).write_text(content)
    return estate.load(spark, str(root))


def test_declarations(loaded):
    coarse, scopes = permissions.declared(F.col("permissions"))
    levels = permissions.normalised(coarse, scopes).alias("levels")
    rows = {r["wf_id"].rsplit("/", 1)[-1]: r for r in loaded.workflows.select("wf_id", levels, permissions.problems(F.col("permissions")).alias("problems")).collect()}
    assert set(rows["broad.yml"]["levels"]) == {2} and rows["bare.yml"]["levels"] is None
    by_scope = dict(zip(permissions.SCOPES, rows["map.yml"]["levels"]))
    assert by_scope["contents"] == 1 and by_scope["issues"] == 2 and by_scope["pages"] == 0
    assert rows["map.yml"]["problems"] == ["unknown level of pages", "unknown scope colour"]
    assert rows["broad.yml"]["problems"] == rows["bare.yml"]["problems"] == []
    jobs = {(r["wf_id"].rsplit("/", 1)[-1], r["job_id"]): r for r in loaded.jobs.select("wf_id", "job_id", levels, permissions.problems(F.col("permissions")).alias("problems")).collect()}
    assert set(jobs["bare.yml", "m"]["levels"]) == {0}
    assert jobs["map.yml", "a"]["problems"] == ["unknown permissions odd"]


def test_findings_on_entries_only(loaded):
    found = permissions.entry_findings(loaded.workflows, loaded.jobs, loaded.triggers).collect()
    assert {(r["kind"], r["wf_id"].rsplit("/", 1)[-1], r["job_id"], tuple(r["jobs"] or ())) for r in found} == {
        ("OverlyBroad", "broad.yml", None, ()), ("OverlyBroad", "broad.yml", "a", ()), ("ImplicitDefault", "bare.yml", None, ("z", "a")),
    }
    assert len(found) == 3


def test_stored_estate(spark, loaded, tmp_path):
    path = str(tmp_path / "store")
    assert store.load(spark, path) is None
    store.save(loaded, path)
    again = store.load(spark, path)
    for name in store.TABLES:
        assert getattr(again, name).count() == getattr(loaded, name).count()
    store._mark(spark, path, store.VERSION + 1)
    assert store.load(spark, path) is None


@pytest.mark.parametrize("seed", range(3))
def test_escalations_equal_walks(spark, seed):
    """All walks that stop at cycles, level by level, on a small random graph with cycles."""
    dice = random.Random(seed)
    nodes, n = list(range(7)), len(permissions.SCOPES)
    level = lambda: None if dice.random() < 0.3 else [dice.randint(0, 2) for _ in range(n)]
    layers = {k: (level(), level()) for k in nodes}
    calls = sorted({(dice.choice(nodes), dice.choice(nodes)) for _ in range(11)})
    caps = {k: layers[k][1] or layers[k][0] for k in (0, 1)}
    expected: dict[tuple[int, int], int] = {}

    def walk(root, node, cap, seen):
        for a, b in calls:
            if a != node or b in seen:
                continue
            wf, job = layers[b]
            mine = job if job is not None else wf
            if mine is not None and any(x > y for x, y in zip(mine, cap)):
                expected[root, b] = min(expected.get((root, b), 99), len(seen))
            walk(root, b, [min(v) for v in zip(cap, wf or cap, job or cap)], [*seen, b])

    for root, cap in caps.items():
        if cap is not None:
            walk(root, root, cap, [root])
    edges = spark.createDataFrame([(a, b, k, *layers[b]) for k, (a, b) in enumerate(calls)], "src long, dst long, ord long, wf array<int>, job array<int>")
    entries = spark.createDataFrame(list(caps.items()), "node long, cap array<int>")
    assert {(r["root"], r["node"]): r["chain"] for r in permissions.escalations(edges, entries).collect()} == expected


def test_reached_pairs_end_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 4), (1, 2)], "src long, dst long")
    roots = spark.createDataFrame([(1,), (5,), (9,), (5,)], "node long")
    assert sorted(map(tuple, graph.reached(edges, roots).collect())) == [(1, 1), (1, 2), (1, 3), (1, 4), (5, 4), (5, 5), (9, 9)]


def test_cluster_numbers(spark):
    members = spark.createDataFrame([(f"r{k % 40:02}", k) for k in range(100)], "representative string, doc long")
    rows = dedup.numbered(members).collect()
    assert len(rows) == 100 and all(r["cluster"] == int(r["representative"][1:]) for r in rows)
    assert dedup.numbered(members.limit(0)).count() == 0


def test_search_by_kind(spark):
    nodes = spark.createDataFrame([(1, "a", "a", "job"), (2, "a", "a", "step")], "id long, label string, text string, kind string")
    assert [r["id"] for r in search.scored(nodes, "a", kind="step").collect()] == [2]
    assert search.scored(nodes, "a").count() == 2


def test_deleted_sources(spark):
    before = spark.createDataFrame([("a",), ("b",)], "file string")
    assert refresh.has_deleted(before, before.where("file = 'a'"))
    assert not refresh.has_deleted(before.where("file = 'a'"), before) and not refresh.has_deleted(before.limit(0), before)


def test_output_references(spark):
    said = "needs.x.outputs.no ${{ needs.a.outputs.v1 == steps.s-1.outputs.w }} ${{ needs.a.outputs.v1 }} ${{ needs[format('a')] }} ${{ steps.open.outputs.q"
    df = spark.createDataFrame([(said,), (None,)], "t string")
    row, null = df.select(text.output_refs(F.col("t"), "needs").alias("n"), text.output_refs(F.col("t"), "steps").alias("s"), text.is_dynamic(F.col("t"), "needs").alias("dn"), text.is_dynamic(F.col("t"), "steps").alias("ds")).collect()
    assert [tuple(p) for p in row["n"]] == [("a", "v1")] and [tuple(p) for p in row["s"]] == [("s-1", "w")]
    assert row["dn"] and not row["ds"] and null["n"] is None and null["dn"] is None


def test_nested_traces():
    rows = [(0, {"id": "a"}), (1, {"id": "b"}), (2, {"id": "c"}), (1, {"id": "d"}), (0, {"id": "e"})]
    assert render.nested(rows) == [
        {"id": "a", "children": [{"id": "b", "children": [{"id": "c", "children": []}]}, {"id": "d", "children": []}]},
        {"id": "e", "children": []},
    ]
