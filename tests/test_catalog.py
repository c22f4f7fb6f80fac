"""Every registered query of the estate engine against its SQL counterpart."""

import os

import duckdb
import pytest

from flowloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = sorted(tuple(plain(v) for _, v in sorted(r.asDict().items())) for r in df.collect())
    if name in catalog.ORACLE_SQL:
        found = duck.execute(catalog.ORACLE_SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows == sorted(tuple(plain(v) for _, v in sorted(zip(columns, r))) for r in found.fetchall())
    else:
        assert rows


def test_llm_subpackage_is_optional():
    """The catalog and everything it imports must not need the training-data subpackage."""
    import pathlib
    import re

    root = pathlib.Path(catalog.__file__).parents[1]
    users = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and re.search(r"flowloom\.llm|from \.+llm", p.read_text())]
    assert not users


def test_entry_without_the_subpackage(tmp_path):
    """A copy without the training-data folders and the pipeline still imports and has all queries of the catalog."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(catalog.__file__).parents[2]
    shutil.copytree(root / "flowloom", tmp_path / "flowloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLE_SQL))], said.stderr
