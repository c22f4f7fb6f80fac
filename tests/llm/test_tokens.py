import random
import tracemalloc

import public_tokenizers
import pytest
import sentencepiece

from flowloom.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def machine():
    return tokens.TokenTransducer(tokens.read_vocabulary(PATH))


def test_given_texts(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in tokens.count_tokens(docs, PATH).collect()}
    for r in docs.collect():
        text, found = r["text"] or "", got[r["doc_id"]]
        assert found["n_tokens"] == len(library.encode(text)) and found["n_bytes"] == len(text.encode())
        assert found["over_limit"] == (found["n_tokens"] > 4096)


def test_random_texts_in_chunks_of_any_size(library, machine):
    chance = random.Random(7)
    parts = [*" \n\tabcthe.,é▁ABC0123!<>s", "漢", "😀", "\x00", "the", "  ", "ing", "<s>", "</s>", "<0x0A>", "ß", "​"]
    for _ in range(3000):
        text = "".join(chance.choice(parts) for _ in range(chance.randint(0, 40)))
        want = len(library.encode(text))
        assert machine.count(text) == want and machine.count(text, chance.randint(1, 9)) == want, repr(text)


def test_tables_that_outgrow_their_bounds_start_again(library, machine, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_STATES", 5)
    monkeypatch.setattr(tokens, "MAX_MEMO", 3)
    text = "antidisestablishmentarianism and other long words " * 3
    assert tokens.TokenTransducer(machine.pieces).count(text) == len(library.encode(text))


def test_maps_compose_associatively(machine):
    chance = random.Random(2)
    for _ in range(300):
        a, b, c = (machine.chunk_map("".join(chance.choice("▁▁ab\nthe") for _ in range(chance.randint(1, 6)))) for _ in range(3))
        left, right = machine.compose(machine.compose(a, b), c), machine.compose(a, machine.compose(b, c))
        assert machine.finish(left) == machine.finish(right)


def test_unbroken_texts_in_bounded_memory(library, machine):
    chance = random.Random(5)
    text = "".join(chance.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(400_000))
    assert machine.count(text, 1 << 12) == machine.count(text) == sum(len(library.encode(text)) for _ in range(1))
    tracemalloc.start()
    try:
        n = machine.count("ab" * 8_000_000)
        assert tracemalloc.get_traced_memory()[1] < 150e6
    finally:
        tracemalloc.stop()
    assert n == machine.count("ab" * 8_000_000, 1 << 20)


def test_odd_rows(odd, empty, library):
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in tokens.count_tokens(odd, PATH).collect())
    assert got == sorted((str(r["doc_id"]), len(library.encode(r["text"] or ""))) for r in odd.collect())
    assert tokens.count_tokens(empty, PATH).count() == 0
