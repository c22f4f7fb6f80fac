"""Components and closures over all parts and both kinds of edge, by brute force."""

import pytest

from flowloom.plans import catalog

from .test_operators import reach


@pytest.mark.parametrize("keys", [[1, 2, 3, 5, 8, 13, 21, 34], list(range(1, 41))])
def test_all_parts_and_both_edges(spark, tmp_path, keys):
    sizes = {p: 50 if p == keys[3] else p % 50 for p in keys}
    spark.createDataFrame(list(sizes.items()), "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    edges = [e for p in keys for e in ((p, (7 * p + 3) % (max(keys) + 1)), (p, p // 2))]
    back = [(b, a) for a, b in edges]
    want = {n: min(reach(edges + back, [n])) for e in edges for n in e}
    assert {r["node"]: r["root"] for r in catalog.QUERIES["connected_components"](spark, str(tmp_path)).collect()} == want
    seeds = [p for p in keys if sizes[p] == 50]
    assert {r["node"] for r in catalog.QUERIES["bidirectional_closure"](spark, str(tmp_path)).collect()} == reach(edges, seeds) | reach(back, seeds)
