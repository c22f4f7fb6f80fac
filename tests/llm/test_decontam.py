import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from flowloom.llm import decontam


def brute(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    phrases = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            phrases.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    sizes = {len(p) for p in phrases}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in range(len(w)):
            for n in sizes:
                if (p := tuple(w[k : k + n])) in phrases and len(p) == n:
                    hit.update(range(k, k + n))
                    found |= phrases[p]
        yield (i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))


def answer(index, items):
    return sorted(((r["id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["n_hit"] > 0) for r in decontam.match_phrases(index, items).collect()), key=str)


def test_matches_brute_force_on_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = answer(decontam.build_index(docs), items)
    want = sorted(brute(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect()), key=str)
    assert got == want and any(r[5] for r in want)


def test_odd_rows_and_several_blocks(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(decontam, "MAX_PHRASES", 2)
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 20)
    texts = [(1, "one"), (1, "one"), (2, None), (3, "brown fox jumps over the lazy dog again and again"), (4, "word " * 12), (5, "friend of the night"), (None, "lazy DOG"), (10, "   ")]
    items = spark.createDataFrame(texts, "item_id long, text string")
    want = sorted(brute(odd.select("doc_id", "text").collect(), [("" if i is None else i, t) for i, t in texts]), key=str)
    assert answer(decontam.build_index(odd), items) == want
    assert answer(decontam.build_index(empty), items) == []
    assert all(r[2] == 0 for r in answer(decontam.build_index(odd), items.limit(0)))


def test_decontaminate_keeps_clean_rows_whole(spark, odd):
    items = spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string")
    kept = decontam.decontaminate(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2


def test_common_words_take_slices(monkeypatch):
    monkeypatch.setattr(decontam, "MAX_STARTS", 500)
    words = [b"a", b"b"]
    chance = random.Random(4)
    text = [chance.choice(words) for _ in range(3_000)]
    phrases = sorted({tuple(text[k : k + 6]) for k in range(40)})
    lists = [[k for k, w in enumerate(text) if w == x] for x in words]
    steps = np.diff(np.concatenate([np.array(x, np.int32) for x in lists]), prepend=np.int32(0)).astype(np.int32)
    row = {"lengths": [len(text)], "counts": np.array([len(x) for x in lists], np.int32).tobytes(), "postings": pa.compress(steps.tobytes(), codec="zstd", asbytes=True), "terms": words}
    segment = decontam.Segment(row, pa.array(words, pa.binary()))
    terms = np.array([[words.index(w) for w in p] for p in phrases], np.int64)
    got = sorted(zip(*map(np.ndarray.tolist, segment.phrases(terms, np.full(len(phrases), 6)))))
    assert got == sorted((n, k) for n, p in enumerate(phrases) for k in range(len(text) - 5) if tuple(text[k : k + 6]) == p)


def test_near(spark, odd):
    index = decontam.build_index(odd)
    pair = spark.createDataFrame([(1, "fox DOG"), (2, None), (3, "dog fox fox")], "item_id long, text string")
    assert {(r["id"], tuple(r["items"]), r["first_word"], r["last_word"]) for r in decontam.near(index, pair, 6).collect()} == {(1, ("1", "3"), 3, 8)}
    assert not decontam.near(index, pair, 5).collect() and not decontam.near(index, pair.limit(0), 5).collect()


def test_near_against_brute_force(spark):
    chance = random.Random(8)
    docs = [(k, " ".join(chance.choice("abcdef") for _ in range(chance.randint(0, 30)))) for k in range(30)]
    items = [(1, "a b"), (2, "c d e"), (3, "f"), (4, "a z")]
    want = set()
    for k, text in docs:
        words = text.split()
        for i, item in items:
            need = set(item.split())
            runs = [(a, b) for a in range(len(words)) for b in range(a, min(len(words), a + 5)) if need <= set(words[a : b + 1])]
            want |= {(k, str(i), a, b) for a, b in runs if not any((c, d) != (a, b) and a <= c and d <= b for c, d in runs)}
    index = decontam.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    got = [(r["id"], *r["items"], r["first_word"], r["last_word"]) for r in decontam.near(index, spark.createDataFrame(items, "item_id long, text string"), 5).collect()]
    assert len(got) == len(want) and set(got) == want
