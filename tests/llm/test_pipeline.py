import corpus_pipeline
import pytest

from flowloom.llm import common
from .test_decontam import brute as hits_of
from .test_jaccard import brute as groups_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = common.table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.stored(stage(spark, out[-1], SF), "test"))
    return [o.collect() for o in out], [o.columns for o in out]


def test_stages_keep_the_columns_of_documents(stages):
    rows, columns = stages
    assert all(c == columns[0] for c in columns[1:-1])
    before = {tuple(r) for r in rows[0]}
    assert all(tuple(r) in before for part in rows[1:-1] for r in part)


def test_one_of_each_group_stays(stages):
    rows, _ = stages
    want = {i for i, _, low in groups_of([(r["doc_id"], r["text"]) for r in rows[2]]) if low == i}
    assert {r["doc_id"] for r in rows[3]} == want and len(rows[3]) == len(want)


def test_leaks_go(spark, stages):
    rows, _ = stages
    items = [(r["item_id"], r["text"]) for r in common.table(spark, SF, "benchmark").collect()]
    want = {r[0] for r in hits_of([(r["doc_id"], r["text"]) for r in rows[3]], items) if not r[5]}
    assert {r["doc_id"] for r in rows[4]} == want


def test_mix_takes_its_targets(stages):
    rows, _ = stages
    assert {r["doc_id"] for r in rows[5]} == {r["doc_id"] for r in rows[4]}
    assert sum(r["taken"] for r in rows[5]) == pytest.approx(1.5 * sum(r["size"] for r in rows[5]), abs=20)


def test_filters_keep_most_documents(stages):
    rows, _ = stages
    assert len(rows[1]) > 0.8 * len(rows[0]) and len(rows[2]) > 0.6 * len(rows[1])


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns[0] == "doc_id"
