"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by documents: a segment row holds the documents of some
SEGMENT_WORDS words, their sorted terms and, for each term, the ascending positions of
its occurrences. No posting list outgrows its segment however common its term is, and
building takes no shuffle. A phrase is found by taking the list of its rarest term in
the segment, shifted by the term's place in the phrase, and keeping the starts at which
each further term, from rare to common, has a posting at its own shift. Test phrases
are made and told apart on the executors and held against every segment in blocks of
MAX_PHRASES phrases, which bounds what is broadcast; inside a segment, phrases are taken
in slices of MAX_STARTS postings of their rarest terms.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm import common

SEGMENT_WORDS = 1_000_000
MAX_PHRASES = 200_000
MAX_STARTS = 2_000_000
WINDOW = 10

_words = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: A-Z lower-cased, runs of digits, letters and non-ASCII characters."""
    return _words(text.encode("utf-8", "surrogatepass").lower()) if text else []


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the postings of all words of all documents; a row for each segment.

    Columns: segment, ids, keys (64-bit text hashes), lengths (words of each document),
    terms, counts (occurrences of each term), postings (compressed steps from position to
    position, term by term). Positions run through the segment with a gap of one after
    each document, so no phrase crosses documents. Null and empty texts are documents of
    no words.
    """
    source = docs.select(docs[id_col].alias("id"), F.xxhash64(common.text_of(text_col)).alias("key"), docs[text_col].cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def segment(ids: list, keys: list, lengths: list[int], words: list[bytes]) -> pd.DataFrame:
        coded = pa.array(words, pa.binary()).dictionary_encode()
        codes, terms = coded.indices.to_numpy(), coded.dictionary
        by_term = pc.sort_indices(terms).to_numpy()
        rank = np.empty(len(terms), np.int32)
        rank[by_term] = np.arange(len(terms), dtype=np.int32)
        codes = rank[codes] if len(terms) else codes
        position = np.arange(len(words), dtype=np.int32) + np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        counts = np.bincount(codes, minlength=len(terms)).astype(np.int32)
        lists = position[np.argsort(codes, kind="stable")]
        steps = np.diff(lists, prepend=np.int32(0)).astype(np.int32)
        packed = pa.compress(steps.tobytes(), codec="zstd", asbytes=True)
        row = {"segment": uuid.uuid4().hex, "ids": ids, "keys": keys, "lengths": lengths, "terms": terms.take(pa.array(by_term)).to_pylist(), "counts": counts.tobytes(), "postings": packed}
        return pd.DataFrame({k: [v] for k, v in row.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, lengths, words = [], [], [], []
        for batch in batches:
            for id_, key, text in zip(batch.column("id").to_pylist(), batch.column("key").to_pylist(), batch.column("text")):
                found = words_of(text.as_py())
                ids.append(id_), keys.append(key), lengths.append(len(found))
                words += found
                if len(words) + len(ids) >= SEGMENT_WORDS:
                    yield pa.RecordBatch.from_pandas(segment(ids, keys, lengths, words), schema=arrow)
                    ids, keys, lengths, words = [], [], [], []
        if ids:
            yield pa.RecordBatch.from_pandas(segment(ids, keys, lengths, words), schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"segment string, ids array<{id_type}>, keys array<bigint>, lengths array<int>, terms array<binary>, counts binary, postings binary")
    arrow = to_arrow_schema(schema)
    return common.stored(source.mapInArrow(run, schema), "postings")


class Segment:
    """A segment row with the posting lists of some terms."""

    def __init__(self, row: dict, vocabulary: pa.Array) -> None:
        self.lengths = np.asarray(row["lengths"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1]
        counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        ends = np.cumsum(counts)
        steps = np.frombuffer(pa.decompress(row["postings"], 4 * int(counts.sum()), codec="zstd"), np.int32)
        lists = np.cumsum(steps, dtype=np.int64)
        place = pc.index_in(vocabulary, value_set=pa.array(row["terms"], pa.binary())).to_numpy(zero_copy_only=False)
        place = np.where(np.isnan(place.astype(float)), -1, place).astype(np.int64)
        self.count = np.where(place >= 0, counts[place] if len(counts) else 0, 0)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        spans = [lists[ends[p] - counts[p] : ends[p]] for p in place if p >= 0]
        self.lists = np.concatenate(spans) if spans else np.zeros(0, np.int64)
        #: Postings as term * 2^40 + position, ascending: one search tells if a term stands at a position.
        self.keys = (np.repeat(np.arange(len(place), dtype=np.int64), self.count) << 40) + self.lists

    def phrases(self, terms: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The occurrences of phrases (rows of term numbers, -1 behind the end): phrase numbers and start positions."""
        inside = terms >= 0
        length = np.where(inside, self.count[terms], np.iinfo(np.int64).max)
        phrase = np.flatnonzero((length > 0).all(axis=1))
        order = np.argsort(length[phrase], axis=1, kind="stable")  # from the rarest term
        rarest = terms[phrase, order[:, 0]]
        n = self.count[rarest]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        ends, low = np.cumsum(n), 0
        while low < len(phrase):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + MAX_STARTS, "right")))
            found.append(self._starts(terms, phrase[low:high], order[low:high], rarest[low:high], n[low:high]))
            low = high
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([p for p, _ in found]), np.concatenate([s for _, s in found])

    def _starts(self, terms: np.ndarray, phrase: np.ndarray, order: np.ndarray, rarest: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(phrase)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[rarest], n)
        start = self.lists[at] - order[row, 0]
        keep = start >= 0
        row, start = row[keep], start[keep]
        for k in range(1, terms.shape[1]):
            offset = order[row, k]
            term = terms[phrase[row], offset]
            key = (term << 40) + start + offset
            found = np.searchsorted(self.keys, key)
            keep = (term < 0) | ((found < len(self.keys)) & (self.keys[np.minimum(found, len(self.keys) - 1)] == key)) if len(self.keys) else term < 0
            row, start = row[keep], start[keep]
        return phrase[row], start

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, side="right") - 1

    def near(self, terms: list[int], within: int) -> list[tuple[int, int, int]]:
        """The shortest runs of at most ``within`` words that hold all of some terms: document, first and last word.

        A run that holds another one is left out.
        """
        if not terms or (self.count[terms] == 0).any():
            return []
        position = np.concatenate([self.lists[self.first[t] : self.first[t + 1]] for t in terms])
        term = np.repeat(np.arange(len(terms)), self.count[terms])
        order = np.argsort(position, kind="stable")
        last, found, doc, begun = {}, [], -1, -1
        for p, t, d in zip(position[order].tolist(), term[order].tolist(), self.doc_of(position[order]).tolist()):
            if d != doc:
                last, doc, begun = {}, d, -1
            last[t] = p
            if len(last) == len(terms) and (low := min(last.values())) > begun and p - low < within:
                begun = low
                found.append((d, int(low - self.starts[d]), int(p - self.starts[d])))
        return found


def windows_of(text: str | None, window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """The phrases of a test item: its runs of ``window`` words, or all of a shorter item."""
    words = words_of(text)
    return [tuple(words[k : k + window]) for k in range(max(1, len(words) - window + 1))] if words else []


def _by_item(items: DataFrame, id_col: str, text_col: str, parts, name: str) -> DataFrame:
    """Rows (item, words joined by spaces) of what ``parts`` makes of each item's text."""
    source = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text")):
                made = parts(text.as_py())
                for k in range(0, len(made), 10_000):
                    some = [b" ".join(p) for p in made[k : k + 10_000]]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(some), pa.string()), pa.array(some, pa.binary())], ["item", "words"])

    grouped = source.mapInArrow(run, "item string, words binary").groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return common.stored(grouped, name)


def _blocks(phrases: DataFrame) -> Iterator[tuple[list[list[bytes]], list[list[str]]]]:
    """Stored phrases and the ids of their items, in blocks of some MAX_PHRASES phrases."""
    blocks = -(-phrases.count() // MAX_PHRASES)
    for k in range(blocks):
        rows = phrases.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).toArrow()
        if rows.num_rows:
            yield [w.split(b" ") for w in rows.column("words").to_pylist()], rows.column("items").to_pylist()


def match_phrases(index: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Every indexed document with what it shares with the test items.

    Columns: id, key, n_words, n_hit (words inside any occurrence of a test phrase),
    items (sorted ids, as strings, of the items whose phrases occur), spans (merged
    [lo, hi) word ranges). Documents and items without words match nothing; equal items
    count once each; an empty index or item table gives no hits.
    """
    spark = index.sparkSession
    schema = "segment string, row int, items array<string>, spans array<struct<lo:int,hi:int>>"

    def searched(phrases: list[list[bytes]], owners: list[list[str]]) -> DataFrame:
        """The documents that hold phrases of a block, stored."""
        vocabulary = sorted({w for phrase in phrases for w in phrase})
        number = {w: k for k, w in enumerate(vocabulary)}
        width = max(map(len, phrases))
        terms = np.array([[number[w] for w in phrase] + [-1] * (width - len(phrase)) for phrase in phrases], np.int64)
        sent = spark.sparkContext.broadcast((vocabulary, terms, owners))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, terms, owners = sent.value
            sizes, vocabulary = (terms >= 0).sum(axis=1), pa.array(vocabulary, pa.binary())
            for batch in batches:
                for row in batch.to_pylist():
                    segment = Segment(row, vocabulary)
                    phrase, start = segment.phrases(terms, sizes)
                    items, spans = {}, {}
                    order = np.lexsort((start, segment.doc_of(start)))
                    docs = segment.doc_of(start)
                    for d, p, s in zip(docs[order].tolist(), phrase[order].tolist(), (start - segment.starts[docs])[order].tolist()):
                        items.setdefault(d, set()).update(owners[p])
                        mine, end = spans.setdefault(d, []), s + int(sizes[p])
                        if mine and s <= mine[-1][1]:
                            mine[-1][1] = max(mine[-1][1], end)
                        else:
                            mine.append([s, end])
                    rows = sorted(spans)
                    out = {"segment": [row["segment"]] * len(rows), "row": rows, "items": [sorted(items[d]) for d in rows], "spans": [[{"lo": a, "hi": b} for a, b in spans[d]] for d in rows]}
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)

        found = common.stored(index.mapInArrow(run, schema), "hits")
        sent.destroy()
        return found

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    found = spark.createDataFrame([], schema)
    for phrases, owners in _blocks(_by_item(items, item_id, item_text, lambda text: windows_of(text, window), "test-phrases")):
        found = found.unionByName(searched(phrases, owners))
    # A document meets each block once; its items and spans of all blocks are put together.
    hits = found.groupBy("segment", "row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    each = F.posexplode(F.arrays_zip("ids", "keys", "lengths")).alias("row", "d")
    docs = index.select("segment", each).select("segment", "row", F.col("d.ids").alias("id"), F.col("d.keys").alias("key"), F.col("d.lengths").cast("long").alias("n_words"))
    none = lambda column, kind: F.coalesce(column, F.array().cast(kind))
    whole = docs.join(hits, ["segment", "row"], "left").select("id", "key", "n_words", none("items", "array<string>").alias("items"), none("spans", "array<struct<lo:int,hi:int>>").alias("spans"))
    merged = F.expr("""aggregate(spans, named_struct('hi', 0, 'n', 0L), (a, s) -> named_struct(
        'hi', greatest(a.hi, s.hi), 'n', a.n + greatest(0, s.hi - greatest(a.hi, s.lo))), a -> a.n)""")
    return whole.select("id", "key", "n_words", merged.alias("n_hit"), "items", "spans")


def near(index: DataFrame, items: DataFrame, within: int, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Where documents hold all words of a test item close together: id, key, items (with these words), first_word, last_word.

    A row for each of the shortest runs of at most ``within`` words; runs that hold another
    one are left out. Items without words are nowhere; null ids of items count as ''; items
    of the same set of words share their rows; an empty index or item table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    id_type = index.schema["ids"].dataType.elementType.simpleString()
    schema = f"id {id_type}, key bigint, items array<string>, first_word int, last_word int"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    found = index.sparkSession.createDataFrame([], schema)
    for terms, owners in _blocks(_by_item(items, item_id, item_text, lambda text: [sorted(set(words_of(text)))] if words_of(text) else [], "test-terms")):
        vocabulary = sorted({w for words in terms for w in words})
        number = {w: k for k, w in enumerate(vocabulary)}
        sent = index.sparkSession.sparkContext.broadcast((vocabulary, [[number[w] for w in words] for words in terms], owners))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            vocabulary, terms, owners = sent.value
            for batch in batches:
                for row in batch.to_pylist():
                    segment = Segment(row, pa.array(vocabulary, pa.binary()))
                    hits = [(d, own, a, b) for words, own in zip(terms, owners) for d, a, b in segment.near(words, within)]
                    yield pa.RecordBatch.from_pydict({"id": [row["ids"][d] for d, *_ in hits], "key": [row["keys"][d] for d, *_ in hits], "items": [h[1] for h in hits], "first_word": [h[2] for h in hits], "last_word": [h[3] for h in hits]}, schema=arrow)

        found = found.unionByName(common.stored(index.mapInArrow(run, schema), "near"))
        sent.destroy()
    return found


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that share no phrase with any test item.

    Rows are told apart by id and text; a row with a null id or text is judged like any other.
    """
    hits = match_phrases(build_index(docs, id_col, text_col), items).where("n_hit > 0").select("id", "key").distinct()
    key, id_ = common.fresh(docs, "text_key"), common.fresh(docs, "hit_id")
    hits = hits.select(F.col("id").alias(id_), F.col("key").alias(f"{key}_hit"))
    keyed = docs.withColumn(key, F.xxhash64(common.text_of(text_col)))
    same = (keyed[key] == hits[f"{key}_hit"]) & keyed[id_col].eqNullSafe(hits[id_])
    return keyed.join(hits, same, "left_anti").drop(key)
