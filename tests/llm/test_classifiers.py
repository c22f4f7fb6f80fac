import numpy as np
import pytest

from flowloom.llm import features, quality, queries, toxicity

SF = "/root/testdata/sf0.01"



@pytest.fixture(scope="module")
def halves(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").withColumnRenamed("quality", "q").withColumnRenamed("toxic", "t")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi").cache()
    from pyspark.sql import functions as F

    labels = labels.withColumn("unfit", 1 - F.col("q"))
    return docs, labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")


def test_quality_on_held_out_ratings(halves):
    docs, train, test = halves
    model = quality.train(docs, train, "q")
    rows = quality.grade_documents(docs, model).join(test, "doc_id").select("keep", "q").collect()
    right = np.mean([r["keep"] == (r["q"] == 1) for r in rows])
    kept = np.mean([r["keep"] for r in rows if r["q"] == 1])
    assert right > 0.93 and kept > 0.98


def test_toxicity_on_held_out_labels(halves):
    docs, train, test = halves
    chain = toxicity.train(docs, train, ["unfit", "t"])
    rows = toxicity.classify(docs, chain, ["unfit", "t"]).join(test, "doc_id").select("toxic", "t").collect()
    caught = np.mean([r["toxic"] for r in rows if r["t"] == 1])
    wrong = np.mean([r["toxic"] for r in rows if r["t"] == 0])
    assert caught > 0.7 and wrong < 0.01


def test_ordinal_model_orders_its_thresholds():
    chance = np.random.default_rng(1)
    truth = chance.normal(size=600)
    rows = features.Rows.of([(np.array([int(v > c) * 7 + k for k, c in enumerate((-1, 0, 1))]), np.ones(3)) for v in truth])
    grades = np.digitize(truth, [-1, 0, 1]).astype(float)
    model = quality.fit(rows, grades)
    assert (np.diff(model.thresholds) > 0).all()
    scores = rows.times(model.weights)
    assert np.abs(model.expected(scores) - grades).mean() < 0.3
    assert np.allclose(model.tail(scores, 0), 1) and (model.tail(scores, 9) == 0).all()
    assert (model.tail(scores, 2) >= model.tail(scores, 3)).all()


def test_odd_rows_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (6, None, 1), (8, 1, None), (5, 0, 0)], "doc_id long, quality int, toxic int")
    for docs, known in ((odd, labels), (empty, labels), (odd, labels.limit(0))):
        model = quality.train(docs, known)
        chain = toxicity.train(docs, known, ["quality", "toxic"])
        assert quality.grade_documents(docs, model).count() == docs.count()
        assert toxicity.classify(docs, chain, ["quality", "toxic"]).count() == docs.count()
        for kept in (quality.select(docs, model), toxicity.reject(docs, chain, ["quality", "toxic"])):
            assert kept.columns == docs.columns and kept.count() <= docs.count()


def test_queries_run(spark):
    assert queries.op2_quality_classifier(spark, "/root/testdata/sf0.001").columns == ["doc_id", "expected_grade", "tail_probability", "keep"]
    assert queries.op5_toxicity(spark, "/root/testdata/sf0.001").columns == ["doc_id", "p_unfit", "p_toxic", "toxic"]


def test_models_are_fitted_off_the_driver(spark):
    import os

    docs = spark.createDataFrame([(k, f"word {k} and word", k % 2) for k in range(9)], "doc_id long, text string, y long").repartition(3)
    rows = features.labelled(docs, docs, ["y"], "doc_id", "text", 5)
    plainly = rows.orderBy("place", "y0").collect()
    process, labels, numbers = features.fitted(rows, lambda x, y: [(np.array([os.getpid()]), y[:, 0], x.numbers)], share=True)[0]
    assert process[0] != os.getpid()
    assert labels.tolist() == [r["y0"] for r in plainly] and numbers.tolist() == [n for r in plainly for n in r["numbers"]]
    assert features.fitted(rows.limit(0), lambda x, y: [(np.array([len(x.numbers)]), y[:, 0])], share=False)[0][1].shape == (0,)
