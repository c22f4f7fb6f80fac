"""Parsed files that are kept up to date."""

import os

import pytest

from flowloom.sources import estate, store

FLOW = "on: push\njobs: {{a: {{runs-on: x, steps: [{{run: echo {}}}]}}}}\n"


@pytest.fixture
def root(tmp_path):
    for n in "abc":
        write(tmp_path, n, n)
    (tmp_path / "tools/t").mkdir(parents=True)
    (tmp_path / "tools/t/action.yml").write_text("runs: {using: node20}\n")
    return tmp_path


def write(root, name, said, when=1_000_000):
    path = root / f".github/workflows/{name}.yml"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(FLOW.format(said))
    os.utime(path, (when, when))


def stale(spark, root, **how):
    files, gone, _ = store.status(spark, str(root), f"{root}/.store", **how)
    return {r["path"].rsplit("/", 1)[-1] for r in files.collect()}, gone


def said(found):
    return {r["owner_id"].rsplit("/", 1)[-1]: r["run"].split()[-1] for r in found.steps.collect()}


def refresh(spark, root, **how):
    return store.refresh(spark, str(root), f"{root}/.store", **how)


ALL = {"a.yml", "b.yml", "c.yml", "action.yml"}


def test_only_what_changed_is_parsed_again(spark, root, monkeypatch):
    assert stale(spark, root) == (ALL, False)
    first = refresh(spark, root)
    assert said(first) == {"a.yml": "a", "b.yml": "b", "c.yml": "c"} and stale(spark, root) == (set(), False)
    write(root, "b", "new", 2_000_000)
    write(root, "d", "d")
    (root / ".github/workflows/c.yml").unlink()
    assert stale(spark, root) == ({"b.yml", "d.yml"}, True)
    parsed, seen = estate.parsed, []
    monkeypatch.setattr(estate, "parsed", lambda files: (seen.append({r["path"].rsplit("/", 1)[-1] for r in files.select("path").collect()}), parsed(files))[1])
    second = refresh(spark, root)
    assert seen == [{"b.yml", "d.yml"}] and said(second) == {"a.yml": "a", "b.yml": "new", "d.yml": "d"}
    assert said(first) == {"a.yml": "a", "b.yml": "b", "c.yml": "c"}  # who read before goes on reading that
    fresh = estate.load(spark, str(root))
    for name in store.TABLES:
        assert sorted(map(repr, getattr(second, name).collect())) == sorted(map(repr, getattr(fresh, name).collect()))
    number, times = store._last(spark, f"{root}/.store")["number"], len(seen)
    refresh(spark, root)
    assert store._last(spark, f"{root}/.store")["number"] == number and len(seen) == times  # nothing changed: nothing is parsed or written


def test_revisions(spark, root):
    """Files that keep their time but changed between revisions are stale; a revision on one side only makes all stale."""
    refresh(spark, root, revision="r1")
    write(root, "a", "silent")
    changed = spark.createDataFrame([(".github/workflows/a.yml",), ("README.md",)], "path string")
    assert stale(spark, root, revision="r1") == (set(), False)
    assert stale(spark, root, revision="r2", changed=changed) == ({"a.yml"}, False)
    assert stale(spark, root, revision="r2") == (ALL, False) and stale(spark, root) == (ALL, False)
    assert said(refresh(spark, root, revision="r2", changed=changed))["a.yml"] == "silent"
    assert stale(spark, root, revision="r2") == (set(), False)


def test_other_roots_versions_and_unfinished_writes(spark, root, tmp_path_factory):
    refresh(spark, root)
    other = tmp_path_factory.mktemp("other")
    write(other, "z", "z")
    files, gone, _ = store.status(spark, str(other), f"{root}/.store")
    assert [r["path"] for r in files.collect()] == [".github/workflows/z.yml"] and gone
    (root / ".store/unfinished/files").mkdir(parents=True)
    assert stale(spark, root) == (set(), False)
    store._mark(spark, f"{root}/.store", store.VERSION + 1)
    assert stale(spark, root) == (ALL, False)
