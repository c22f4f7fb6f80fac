"""Escalations and secrets by states against walks of every way, on random graphs with cycles."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import graph, permissions, questions, secrets
from flowloom.sources import estate

N = len(permissions.SCOPES)


@pytest.mark.parametrize("seed", range(4))
def test_chains_equal_walks(spark, seed):
    """Workflows of several jobs; a way enters a workflow once. Of equal findings the shortest chain, the first in depth-first order."""
    dice = random.Random(seed)
    flows = [f"w{k}" for k in range(6)]
    jobs = {w: [f"{w}#{j}" for j in range(dice.randint(1, 3))] for w in flows}
    level = lambda: None if dice.random() < 0.4 else [2 if dice.random() < 0.8 else dice.randint(0, 1) for _ in range(N)]
    whole, own = {w: level() for w in flows}, {j: level() for w in flows for j in jobs[w]}
    calls = {j: dice.choice(flows) for w in flows for j in jobs[w] if dice.random() < 0.8}
    found: dict[tuple, tuple] = {}

    def walk(root, job, cap, chain, around):
        callee = calls.get(job)
        if callee is None or callee in around:
            return
        for j in jobs[callee]:
            mine = own[j] if own[j] is not None else whole[callee]
            more = tuple(s for s, a, b in zip(permissions.SCOPES, mine or cap, cap) if a > b)
            key = (root, j, more)
            if more and (key not in found or len(found[key]) > len(chain)):
                found[key] = tuple(chain)
            low = [min(v) for v in zip(cap, whole[callee] or cap, own[j] or cap)]
            walk(root, j, low, [*chain, j], around | {callee})

    start = []
    for w in flows[:2]:
        for j in jobs[w]:
            cap = own[j] if own[j] is not None else whole[w]
            start.append((j, w, cap))
            if cap is not None:
                walk(j, j, cap, [j], {w})
    rows = [(j, t, k, whole[c], own[t], w, c) for w in flows for j in jobs[w] if (c := calls.get(j)) for k, t in enumerate(jobs[c])]
    df = spark.createDataFrame(rows, "src string, dst string, ord int, wf array<int>, job array<int>, src_flow string, dst_flow string")
    got = permissions.escalation_chains(df, spark.createDataFrame(start, "node string, flow string, cap array<int>")).collect()
    assert {(r["root"], r["node"], tuple(r["scopes"])): tuple(r["chain"]) for r in got} == found and len(got) == len(found)
    assert all(r["caller"] == r["chain"][-1] for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_lost_secrets_equal_walks(spark, seed):
    dice = random.Random(seed)
    nodes, names = list(range(7)), ["A", "B", "a"]
    values = ["${{ secrets.A }}", "${{ secrets.b }}", "fixed", "${{ secrets.GITHUB_TOKEN }}", "${{ secrets.A }}x"]
    calls = []
    for k in range(13):
        mode = dice.choice(["inherit", "inherit", "explicit", "explicit", "none"])
        calls.append((dice.choice(nodes), dice.choice(nodes), k, mode, {n: dice.choice(values) for n in names if dice.random() < 0.5}))
    required = [(n, s) for n in nodes[2:] for s in ("A", "B") if dice.random() < 0.6]
    entries, want = [0, 1], set()

    def drop(hops, name):
        exact = True
        for src, _, _, mode, given in reversed(hops):
            if mode == "inherit":
                continue
            value = next((v for k, v in given.items() if (k == name if exact else k.lower() == name.lower())), None)
            if mode != "explicit" or value is None:
                return src
            source = value.removeprefix("${{ secrets.").removesuffix(" }}") if value.startswith("${{") and value.endswith("}}") else None
            if source is None or source == "GITHUB_TOKEN":
                return None
            name, exact = source, False
        return None

    def walk(entry, node, hops, around):
        for n, s in required:
            if n == node and hops and (at := drop(hops, s)) is not None:
                want.add((entry, node, s, len(hops), at))
        for c in calls:
            if c[0] == node and c[1] not in around:
                walk(entry, c[1], [*hops, c], around | {c[1]})

    for e in entries:
        walk(e, e, [], {e})
    df = spark.createDataFrame(calls, "src long, dst long, ord int, mode string, map map<string,string>")
    got = secrets.lost(df, spark.createDataFrame([(e,) for e in entries], "node long"), spark.createDataFrame(required, "node long, secret string"))
    rows = [(r["entry"], r["callee"], r["secret"], r["depth"], r["dropped_at"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_a_ladder_of_diamonds_ends(spark):
    """2^20 ways, 40 levels."""
    n = 20
    edges = [(3 * k, 3 * k + d) for k in range(n) for d in (1, 2)] + [(3 * k + d, 3 * k + 3) for k in range(n) for d in (1, 2)]
    df = spark.createDataFrame([(a, b, k, "inherit" if a else "none") for k, (a, b) in enumerate(edges)], "src long, dst long, ord int, mode string").withColumn("map", F.create_map().cast("map<string,string>"))
    rows = secrets.lost(df, spark.createDataFrame([(0,)], "node long"), spark.createDataFrame([(3 * n, "X")], "node long, secret string")).collect()
    assert [(r["depth"], r["dropped_at"]) for r in rows] == [(2 * n, 0)]


@pytest.mark.parametrize("seed", range(3))
def test_knots_and_labels_equal_reachability(spark, seed):
    dice = random.Random(seed)
    edges = [(dice.randint(0, 14), dice.randint(0, 14)) for _ in range(20)]
    reach = {n: {n} for n in range(15)}
    for _ in range(15):
        for a, b in edges:
            reach[a] |= {b}
            for n in reach:
                if a in reach[n]:
                    reach[n] |= reach[b]
    want = {n: min(mates) for n in reach if (mates := {m for m in reach[n] if n in reach[m]}) != {n}}
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r["node"]: r["knot"] for r in graph.knots(df).collect()} == want
    seeds = [(0, "x"), (3, "y"), (3, "z"), (7, "x")]
    labels = {n: sorted({s for m, s in seeds if n in reach[m]}) for n in reach}
    got = {r["node"]: r["labels"] for r in graph.handed_down(df, spark.createDataFrame(seeds, "node long, label string")).collect()}
    assert {n: v for n, v in labels.items() if v} == got
    assert graph.knots(df.where("src < dst")).count() == 0


def test_a_cycle_of_workflows_is_no_way_back(spark, tmp_path):
    """a.yml calls b.yml, which calls a.yml: a.yml's other job isn't called through it."""
    files = {
        "a": "on: push\npermissions: {contents: read}\njobs:\n  one: {uses: ./.github/workflows/b.yml}\n  two: {runs-on: x, permissions: write-all}\n",
        "b": "on: workflow_call\njobs:\n  back: {uses: ./.github/workflows/a.yml}\n  deep: {uses: ./.github/workflows/c.yml}\n",
        "c": "on: workflow_call\njobs:\n  go: {runs-on: x, permissions: {contents: write, packages: read}}\n",
    }
    for name, content in files.items():
        (tmp_path / ".github/workflows").mkdir(parents=True, exist_ok=True)
        (tmp_path / f".github/workflows/{name}.yml").write_text(content)
    rows = questions.permission_findings(estate.load(spark, str(tmp_path))).orderBy("pos").collect()
    w = ".github/workflows/"
    assert [(r["kind"], r["severity"], r["file"], r["job_id"], r["scopes"], r["chain"]) for r in rows] == [
        ("OverlyBroad", "high", f"{w}a.yml", "two", None, None),
        ("Escalation", "high", f"{w}c.yml", "go", ["contents", "packages"], [f"{w}a.yml#one", f"{w}b.yml#deep"]),
    ]


def test_permission_layers_are_made_after_the_join_and_levels_of_any_size_agree(spark, monkeypatch):
    from flowloom.operators import permissions
    from flowloom.plans import graphs

    sf = "/root/testdata/sf0.001"
    plan = graphs.entry_perm(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "array(" not in plan.split("Join LeftSemi", 1)[1]  # below the join are orders as they were read
    sent = sorted(map(tuple, graphs.escalated(spark, sf).collect()))
    monkeypatch.setattr(permissions, "SMALL_LEVEL", 0)
    assert sent and sent == sorted(map(tuple, graphs.escalated(spark, sf).collect()))
