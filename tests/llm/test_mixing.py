import re
from collections import defaultdict

import numpy as np
import pytest

from flowloom.llm import mixing


def checked(docs, **kw):
    rows = mixing.taken_words(mixing.mix(docs, **kw), kw.get("block_words", mixing.BLOCK_WORDS)).collect()
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]][0] += r["size"]
        by[r["source"]][1] += r["taken"]
        by[r["source"]][2] = r["target"]
        assert r["source_size"] >= r["size"]
    for size, taken, target in by.values():
        assert abs(taken - target) <= 1 and target <= 2 * size + 1e-6
    assert sum(t for _, _, t in by.values()) == pytest.approx(1.5 * sum(s for s, _, _ in by.values()))
    return sorted(((r["id"], r["source"], r["size"], r["taken"]) for r in rows), key=str)


@pytest.mark.parametrize("block_words", [3, 64])
def test_given_table_meets_targets_and_reruns_agree(spark, block_words):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = checked(docs, block_words=block_words)
    assert first == checked(docs.repartition(5), block_words=block_words)
    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    assert {r[0]: r[2] for r in first} == sizes


def test_odd_rows(odd, empty):
    assert len(checked(odd)) == odd.count()
    assert checked(empty) == []


def test_targets_reshare_what_caps_cut_off(spark):
    def targets(sizes, weights):
        table = spark.createDataFrame([(k, s, float(w)) for k, (s, w) in enumerate(zip(sizes, weights))], "number long, size long, weight double")
        return [r["target"] for r in mixing.targets_of(table).orderBy("number").collect()]

    assert targets([10, 100, 100], [3, 1, 2]) == [20.0, pytest.approx(295 / 3), pytest.approx(590 / 3)]
    assert targets([10, 30, 0, 1000], [3, 3, 2, 1]) == [20.0, 60.0, 0.0, pytest.approx(1480)]
    assert targets([], []) == []


def test_draws_agree_in_any_range_and_follow_the_multinomial():
    whole = list(mixing.shard_counts(100_000, 37, 0, 37, 17, 3))
    assert sum(n for *_, n in whole) == 100_000 and [s for s, *_ in whole] == list(range(37))
    assert all(first == sum(n for *_, n in whole[:k]) for k, (_, first, _) in enumerate(whole))
    assert whole[10:20] == list(mixing.shard_counts(100_000, 37, 10, 20, 17, 3))
    expected = 100_000 / 37
    assert sum((n - expected) ** 2 / expected for *_, n in whole) < 80  # chi-square with 36 degrees of freedom


def test_permutation_is_one_to_one_and_inverts():
    for n in (1, 2, 3, 7, 64, 1000):
        passes = np.zeros(n, np.int64)
        p = mixing.permuted(np.arange(n), n, passes, 5, 1)
        assert sorted(p) == list(range(n))
        assert (mixing.permuted(p, n, passes, 5, 1, inverse=True) == np.arange(n)).all()


@pytest.mark.parametrize("block_words, part_words", [(3, 200), (64, 6_000_000)])
def test_shards_hold_the_drawn_words(spark, odd, monkeypatch, block_words, part_words):
    """Each slot holds the words of its block of the stream, in order and with their space, as a plain walk cuts them."""
    monkeypatch.setattr(mixing, "PART_WORDS", part_words)
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 7)
    spaced = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
    for docs in (spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60), odd):
        mixed = mixing.mix(docs, block_words=block_words)
        texts = defaultdict(list)
        for r in docs.collect():
            texts[r["doc_id"]].append(spaced.findall(r["text"] or ""))
        stream, rows = defaultdict(dict), mixed.docs.collect()
        for r in rows:
            if r["start"] is not None:
                words = next(w for w in texts[r["id"]] if len(w) == r["size"])
                for k, w in enumerate(words):
                    assert r["start"] + k not in stream[r["number"]]
                    stream[r["number"]][r["start"] + k] = w
        slots = mixed.slots.collect()
        stored = {(r["number"], r["slot"]): r for r in mixed.shards.collect()}
        assert len(stored) == len(slots) == len({(r["number"], r["slot"]) for r in slots})
        taken = defaultdict(int)
        for s in slots:
            got, at = stored[s["number"], s["slot"]], s["block"] * block_words
            want = [stream[s["number"]][k] for k in range(at, min(at + s["words"], len(stream[s["number"]])))]
            assert got["shard"] == s["shard"] and got["words"] == len(want)
            assert "".join(p["text"] for p in got["pieces"]) == "".join(want)
            for p in got["pieces"]:
                taken[s["number"], p["start"]] += p["words"]
        assert sorted(((r["id"], r["taken"]) for r in mixing.taken_words(mixed).collect()), key=str) == sorted(((r["id"], taken[r["number"], r["start"]]) for r in rows), key=str)


def test_parts_are_bounded_by_words_however_few_documents():
    part = mixing.PART_WORDS
    for documents, words in ((1, 10), (999, 999 * part), (5_000_000, part), (10, 3 * part), (0, 0)):
        parts = min(mixing.bucket_count(documents, words), words // part + 1)
        assert words / parts <= part
