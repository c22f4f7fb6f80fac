from flowloom.llm import urls


def answer(spark, captures, entries):
    c = spark.createDataFrame(captures, "page_id long, url string, fetch_day int, key string, list string")
    e = spark.createDataFrame(entries, "list string, key string, action string, day int")
    return {(r["page_id"], r["fetch_day"]): (r["n_active"], r["lists"], r["deciding_key"], r["blocked"]) for r in urls.filter_captures(c, e).collect()}


ENTRIES = [("spam", "bad.org", "add", 10), ("spam", "bad.org", "remove", 20), ("spam", "bad.org", "add", 30), ("allow", "bad.org/ok", "add", 0), ("spam", "org", "add", 35), ("allow", "org", "add", 35), ("odd", "x.y", "add", 5), ("odd", "x.y", "remove", 5)]


def test_entries_count_only_while_active(spark):
    rows = [(1, "http://u:p@www.BAD.org.:80/a/b?q#f", day, "k", "l") for day in (9, 10, 19, 20, 30)]
    got = answer(spark, rows, ENTRIES)
    assert [got[1, d][3] for d in (9, 10, 19, 20, 30)] == [False, True, True, False, True]
    assert got[1, 10] == (1, "spam", "bad.org", True)


def test_most_specific_key_decides(spark):
    got = answer(spark, [(1, "https://bad.org/ok/page", 36, "", ""), (2, "https://good.org/", 36, "", ""), (3, "http://x.y/", 5, "", "")], ENTRIES)
    assert got[1, 36] == (4, "allow,spam", "bad.org/ok", False)
    assert got[2, 36] == (2, "allow,spam", "org", False)
    assert got[3, 5] == (0, "", None, False)


def test_odd_rows(spark):
    rows = [(1, None, 1, None, None), (1, None, 1, None, None), (2, "", None, "", ""), (3, "not a url", 40, "", ""), (None, "http://bad.org", 40, "", ""), (4, "http://bad.org/" + "a/" * 500, 40, "", "")]
    c = spark.createDataFrame(rows, "page_id long, url string, fetch_day int, key string, list string")
    e = spark.createDataFrame(ENTRIES, "list string, key string, action string, day int")
    assert urls.filter_captures(c, e).count() == len(rows)
    assert urls.filter_captures(c.limit(0), e).count() == 0
    assert not any(r["blocked"] for r in urls.filter_captures(c, e.limit(0)).collect())


def test_runs_without_python_on_executors(spark):
    plan = urls.evaluated_pages(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
