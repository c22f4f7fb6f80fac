"""Enriched findings on random estates against a walk over the files' own description."""

import random

import pytest
import yaml

from flowloom.operators import questions
from flowloom.sources import estate

RANKS = ["info", "low", "medium", "high", "error"]


def described(seed):
    """Workflows and actions with calls, uses and annotations in any direction, cycles too."""
    dice = random.Random(seed)
    flows = [f".github/workflows/w{k}.yml" for k in range(12)]
    acts = [f"tools/a{k}" for k in range(6)] + ["fixtures/x"]
    model = {}
    for f in flows:
        events = dice.choice([["push"], ["workflow_call"], ["workflow_call"], ["workflow_call", "push"], ["pull_request_target"], ["workflow_run", "issues"]])
        perms = dice.choice([None, None, "write-all", "read-all", {"contents": "write", "pages": "write", "issues": "read"}])
        jobs = {}
        for k in range(dice.randint(1, 3)):
            if dice.random() < 0.4:
                call = dice.choice([*flows, "o/r/.github/workflows/z.yml@v1"])
                jobs[f"j{k}"] = {"call": call, "secrets": dice.choice([None, "inherit", {"A": "x"}, {}]), "notes": dice.sample(flows, dice.randint(0, 1))}
            else:
                jobs[f"j{k}"] = {"uses": dice.choices([*acts, "o/r/sub@v2", "docker://img:1"], k=dice.randint(1, 2)), "notes": [], "permissions": dice.choice([None, None, {"id-token": "write"}])}
        model[f] = {"events": events, "permissions": perms, "jobs": jobs, "needs": dice.random() < 0.5}
    for a in acts:
        model[a] = {"uses": dice.choices([*acts, ".github/workflows/w0.yml", "o/r@v3"], k=dice.randint(0, 2)), "notes": dice.sample(flows, dice.randint(0, 1))}
    return flows, acts, model


def local(name):
    return "./" + name if name.startswith((".github/", "tools/", "fixtures/")) and "@" not in name else name


def written(root, flows, acts, model):
    for f in flows:
        m, lines = model[f], ["on:"]
        for e in m["events"]:
            lines.append(f"  {e}:" + (" {secrets: {S: {required: true}}}" if e == "workflow_call" and m["needs"] else " {workflows: [none]}" if e == "workflow_run" else ""))
        lines += [f"permissions: {yaml.safe_dump(m['permissions'], default_flow_style=True).splitlines()[0]}"] if m["permissions"] else []
        lines.append("jobs:")
        for name, j in m["jobs"].items():
            lines += [f"  # flowloom:dispatches {n}" for n in j["notes"]] + [f"  {name}:"]
            if "call" in j:
                lines += [f"    uses: {local(j['call'])}"] + ([] if j["secrets"] is None else [f"    secrets: {yaml.safe_dump(j['secrets'], default_flow_style=True).splitlines()[0]}"])
            else:
                lines += ["    runs-on: x"] + (["    permissions: {id-token: write}"] if j["permissions"] else []) + ["    steps:"] + [f"      - uses: {local(u)}" for u in j["uses"]]
        (root / f).parent.mkdir(parents=True, exist_ok=True)
        (root / f).write_text("\n".join(lines) + "\n")
    for a in acts:
        m = model[a]
        steps = [f"    - uses: {local(u)}" for u in m["uses"]]
        lines = ["runs:", "  using: composite", "  steps:", *[f"    # flowloom:triggers {n}" for n in m["notes"]], "    - run: echo", *steps]
        (root / a).mkdir(parents=True, exist_ok=True)
        (root / a / "action.yml").write_text("\n".join(lines) + "\n")


def walked(flows, acts, model):
    """Context of every node, by reachability from each entry."""
    known = {*flows, *acts}
    edges = []
    for f in flows:
        for j in model[f]["jobs"].values():
            edges += [(f, n, "note") for n in j["notes"]] + [(f, t, "use") for t in ([j["call"]] if "call" in j else j["uses"])]
    for a in acts:
        edges += [(a, n, "note") for n in model[a]["notes"]] + [(a, t, "use") for t in model[a]["uses"]]
    entry = {f for f in flows if set(model[f]["events"]) - {"workflow_call"}}

    def reach(start, skip):
        seen, todo = set(start), list(start)
        while todo:
            n = todo.pop()
            for s, t, kind in edges:
                if s == n and t in known and t not in seen and not (skip and s in acts and kind == "use" and t in flows):
                    seen.add(t)
                    todo.append(t)
        return seen

    by_entry = {e: reach([e], True) for e in entry}
    live = reach(entry, False)
    out = {}
    for n in known:
        above = sorted(e for e in entry if n in by_entry[e])
        out[n] = {
            "reachable_from": sorted({v for e in above for v in model[e]["events"] if v != "workflow_call"}), "affected_entrypoints": above,
            "callers": sorted({s for s, t, _ in edges if t == n}), "is_orphan": n not in live and (n in acts or "workflow_call" in model[n]["events"]),
            "callees": sorted({"o/r@v1" if t.startswith("o/r/.github") else t for s, t, kind in edges if s == n and kind == "use"}),
        }
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_walk(spark, tmp_path, seed):
    flows, acts, model = described(seed)
    written(tmp_path, flows, acts, model)
    want = walked(flows, acts, model)
    loaded = estate.load(spark, str(tmp_path))
    assert loaded.diagnostics.where("message not like 'no runs-on%'").count() == 0
    places = [(f, None) for f in flows] + [(f, 10_000) for f in flows] + [(f"{a}/action.yml", None) for a in acts] + [("src/none.rs", 3), (None, None)]
    rows = [(k, p, line, RANKS[k % 5]) for k, (p, line) in enumerate(places)]
    got = questions.enrich(loaded, spark.createDataFrame(rows, "id long, path string, start_line int, severity string")).collect()
    assert sorted(r["id"] for r in got) == list(range(len(rows)))
    for r in got:
        name = r["node"] and r["node"].split(":", 1)[1]
        seen = {k: r[k] for k in ("reachable_from", "affected_entrypoints", "callers", "callees", "is_orphan")}
        if name is None:
            assert r["confidence"] == "file_only" and not any(seen.values()) and r["permission_context"] is None and r["priority"] == r["severity"] and r["priority_reasons"] == []
            continue
        assert seen == want[name], name
        reasons = [("reachable_from_risky_trigger", e) for e in seen["reachable_from"] if e in ("pull_request_target", "workflow_run")]
        if name in flows:
            m, job = model[name], r["job_id"]
            own = m["jobs"][job].get("permissions") if job else None
            said = own or m["permissions"]
            source = f"job:{job}" if own else "workflow" if m["permissions"] else "none-declared"
            scopes = sorted(k for k, v in said.items() if v == "write") if isinstance(said, dict) else []
            assert r["permission_context"].asDict() == {"write_all": said == "write-all", "write_scopes": scopes, "source": source}
            calls = [j for j in m["jobs"].values() if "call" in j]
            assert tuple(r["secret_context"]) == ("workflow_call" in m["events"] and m["needs"], any(j["secrets"] == "inherit" for j in calls), any(isinstance(j["secrets"], dict) and j["secrets"] for j in calls))
            reasons += [("write_all_available", None)] * (said == "write-all") + [("sensitive_write_scope", s) for s in scopes if s in ("contents", "id-token")]
        else:
            assert r["permission_context"] is None and r["secret_context"] is None
        demoted = [("orphaned", None)] * seen["is_orphan"] + [("under_test_fixtures", None)] * (name == "fixtures/x")
        assert [tuple(x) for x in r["priority_reasons"]] == reasons + demoted
        rank = RANKS.index(r["severity"])
        assert r["priority"] == RANKS[min(rank, 1) if demoted else max(rank, 3) if reasons else rank]
