"""Every stage of the pipeline as a stage over the odd and the empty table."""

import corpus_pipeline
import pytest

STAGES = dict(corpus_pipeline.STAGES)
SF = "/root/testdata/sf0.001"
FILTERS = list(STAGES)[:-1]
#: Rows of the odd table that must stay; the trained filters may drop some.
STAYING = {"n-gram Jaccard join": 9, "benchmark decontamination": 10}


def counted(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", FILTERS)
def test_filters(spark, odd, name):
    out = STAGES[name](spark, odd, SF)
    before, after = counted(odd.collect()), counted(out.collect())
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    for row in set(after):
        assert after.count(row) <= before.count(row)
    if name in STAYING:
        assert len(after) == STAYING[name] and set(after) == set(before)


def test_mix(spark, odd):
    rows = STAGES["mixing sources to target weights"](spark, odd, SF).collect()
    assert len(rows) == odd.count()
    words = sum(r["size"] for r in rows)
    assert all(r["taken"] <= 2 * r["size"] for r in rows) and words < sum(r["taken"] for r in rows) <= 2 * words
    assert all(r["taken"] == 0 for r in rows if r["doc_id"] in (2, 3, 7))


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables(spark, empty, name):
    out = STAGES[name](spark, empty, SF)
    assert out.count() == 0 and (name not in FILTERS or out.columns == empty.columns)
