import random
import re
from collections import Counter, defaultdict

import pytest

from flowloom.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, min_docs=3, top=200):
    """All groups and terms, one after the other, with Python's integers."""
    texts = defaultdict(lambda: defaultdict(list))
    for text, lang, source in rows:
        texts[lang or ""][source or ""].append(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))
    out = []
    for lang, groups in texts.items():
        frequency = Counter(t for docs in groups.values() for d in docs for t in set(d))
        kept = {t for t, n in frequency.items() if n >= min_docs}
        counts = {s: Counter(t for d in docs for t in d if t in kept) for s, docs in groups.items()}
        whole = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        for s in groups:
            pairs = [(-sum(f(share(counts[s], t), share(counts[o], t)) for t in kept), o) for o in groups if o != s]
            terms = [(-f(share(counts[s], t), share(whole, t)), t) for t in kept if counts[s][t] and share(counts[s], t) > share(whole, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def audited(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "text string, lang string, source string, term string, rank int, other string").repartition(3)
    found = divergence.audit(docs, **how)
    assert dict(found.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    return sorted(map(tuple, found.collect()))


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdeéü漢" for b in "xyzÄß字"] + ["Foo", "FOO", "foo", "ÉTÉ", "été"]
    rows = [(" ".join(rnd.choices(words, k=rnd.randint(0, 60))), rnd.choice(["en", "de", "xx"]), f"s{rnd.randint(0, 6)}") for _ in range(200)]
    rows += [("foo foo " * 5000, "en", "hot")] * 60
    rows += [(None, None, None), ("", "en", "wordless"), ("123 _", "en", "wordless"), ("alone", "zz", "a"), ("other", "zz", "b"), (None, "zz", None), ("one source", "yy", "a")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert audited(spark, rows) == by_hand(rows)


def test_small_memory_and_other_limits(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "PIECE", 100)
    rows = corpus(3)
    assert audited(spark, rows, min_docs=1, top=7) == by_hand(rows, 1, 7)


def test_odd_and_empty_tables(spark, odd, empty):
    rows = [(r["text"], None, r["source"]) for r in odd.collect()]
    found = divergence.audit(odd.withColumn("lang", odd["id"]).withColumn("lang", odd["text"].substr(1, 0)))
    assert sorted(map(tuple, found.collect())) == by_hand(rows)
    assert divergence.audit(empty.withColumn("lang", empty["id"])).count() == 0


def test_large_counts_are_exact():
    import numpy as np

    counts = np.array([0, 9_223_372_034, 9_223_372_036, 10**15], np.int64)
    assert divergence.share(counts, np.full(4, 10**15 + 7)).tolist() == [1 + 10**9 * (int(c) + 1) // (10**15 + 7) for c in counts]


def test_a_term_beyond_a_piece_stays_whole(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 10)
    text = b"ab " + b"c" * 50 + b" de " + b"f" * 9 + b"1g"
    assert [t for p in divergence._pieces(text) for t in divergence.TERM.findall(p)] == divergence.TERM.findall(text)
