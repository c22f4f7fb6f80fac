"""Mixing sources to target weights.

Each source's texts form a stream of words that is packed into blocks of fixed length.
The mix is a row of output shards. How a source's slots fall to the shards is drawn from a
multinomial distribution, given how many slots the source has in all: free draws miss the
target of a small source by a good part of it. The draws split a range of shards in two,
again and again, each split by a generator of its own, so any task can draw its shards. A
source's slots are numbered through all shards, and slot numbers go through a pseudorandom
permutation of the source's block indexes, one permutation for each pass over the source.
Blocks then are joined by index: texts and drawn slots meet by parts of the source's stream,
each part's blocks are joined with its slots by their index, each text is cut once, and the
pieces are dealt to the shards and written there. Texts and pieces travel in compressed packs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm import common

BLOCK_WORDS = 64
SHARD_SLOTS = 1 << 16  # on average
DRAWN_SLOTS = 1 << 20  # of a source that a task draws at once
BUCKET_DOCS = 1_000
BUCKETS = 1_000  # of a source that are summed first
PART_WORDS = 6_000_000  # of the texts that a task cuts at once
PACK_BYTES = 32 << 20
NEAR = 4_096  # blocks that look up their part together
WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"


def targets_of(sources: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sources`` (size, weight, ...) with a target by weight; all sum to ``share`` of all sizes, none is over ``cap`` times its size.

    What a cap cuts off is shared anew, by weight, among the sources below theirs: a
    source is capped if its size by weight is under a level, which rises until it holds.
    """
    per, level, open_ = F.col("size") / F.col("weight"), 0.0, -1
    total = sources.agg(F.sum("size")).first()[0] or 0
    while True:
        over = per > level
        n, whole, limits = sources.agg(F.count(F.when(over, 1)), F.sum(F.when(over, F.col("weight"))), F.sum(F.when(~over, cap * F.col("size")))).first()
        rest = share * total - (limits or 0.0)
        if n in (0, open_):
            return sources.withColumn("target", F.when(over, F.lit(rest) * F.col("weight") / F.lit(whole or 1.0)).otherwise(cap * F.col("size")).cast("double"))
        level, open_ = rest / (cap * whole), n


def _packed(data) -> bytes:
    return pa.Codec("zstd", compression_level=5).compress(np.ascontiguousarray(data) if isinstance(data, np.ndarray) else data, asbytes=True)


def _unpacked(data: bytes, size: int) -> pa.Buffer:
    return pa.decompress(data, size, codec="zstd")


def _keys(seed: int, source: int, passes: np.ndarray, rounds: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        base = passes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + source * 7_919 + 1) & (2**63 - 1))
        return [_mixed(base + np.uint64(r * 0x632BE59BD9B4E019 & (2**64 - 1))) for r in range(rounds)]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, passes: np.ndarray, seed: int, source: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each pass: a Feistel network that walks on until it is inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    x, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        keys = _keys(seed, source, passes[todo], 4)
        a, b = x[todo] >> shift, x[todo] & mask
        with np.errstate(over="ignore"):
            if inverse:
                for key in reversed(keys):
                    a, b = b ^ (_mixed(a + key) & mask), a
            else:
                for key in keys:
                    a, b = b, a ^ (_mixed(b + key) & mask)
        x[todo] = (a << shift) | b
        todo = x >= n
    return x.astype(np.int64)


class SourcePlan(NamedTuple):
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int
    last_words: int  # words that the last slot takes from its block


def plan_source(name: str | None, size: int, target: float, number: int, block_words: int, seed: int) -> SourcePlan:
    """How many slots a source gets, so that its words sum to its rounded target."""
    blocks, words = -(-size // block_words), round(target)
    if not blocks or not words:
        return SourcePlan(name, size, target, blocks, 0, 0)
    passes, rest = divmod(words, size)
    if not rest:
        return SourcePlan(name, size, target, blocks, passes * blocks, block_words)
    short = size - (blocks - 1) * block_words  # words of the last block
    place = int(permuted(np.array([blocks - 1]), blocks, np.array([passes]), seed, number, inverse=True)[0])
    slots = -(-rest // block_words)
    if place < slots:  # the short block is among them
        slots = -(-(rest + block_words - short) // block_words)
        rest += block_words - short
        if place == slots - 1:
            return SourcePlan(name, size, target, blocks, passes * blocks + slots, rest - (slots - 1) * block_words - (block_words - short))
    return SourcePlan(name, size, target, blocks, passes * blocks + slots, rest - (slots - 1) * block_words)


class Mix(NamedTuple):
    docs: DataFrame  # id, source, number, size, source_size, target, start: where a document's words begin in its source's stream (null without words)
    sources: DataFrame  # number, source, source_size, target, blocks, slots, last_words
    slots: DataFrame  # shard, number, slot, block, words: what the mix draws
    shards: DataFrame  # number, slot, words, pieces (start of the document, words, text), shard: the mix as written, a folder for each shard


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, block_words: int = BLOCK_WORDS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Write the mix of all rows of ``docs``; sources by code point (null last) take ``weights`` in turn.

    Null and empty texts have size 0 and are never drawn; null is a source of its own;
    repeated rows are documents of their own; an empty table gives an empty mix. The
    order inside a source is by hash bucket, id and text hash, whatever the partitions
    are, so reruns agree. Sources, draws and texts all stay on the executors. ``docs`` is read twice.

    The shards are Parquet in the shared folder. A row is a slot, in an order that is
    drawn for the shard; its pieces are parts of documents with the space between their words.
    """
    size = F.expr(f"cast(regexp_count(text, '{WORD}') as bigint)")
    read = docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), common.text_of(text_col).alias("text"))
    rows = read.select("id", "source", size.alias("size"), F.xxhash64("text").alias("key"))
    rows = common.stored(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    sources = planned_sources(rows, weights, share, cap, block_words, seed)
    total = sources.agg(F.sum("slots").alias("slots"), F.sum("source_size").alias("words"), F.sum("n").alias("n")).first()
    # Documents of a source are dealt to hash buckets, and neighbouring buckets to parts of some PART_WORDS words.
    buckets = bucket_count(total["n"] or 0, total["words"] or 0)
    parts = F.expr(f"least({buckets}L, source_size div {PART_WORDS} + 1)").alias("parts")
    named = sources.select("number", F.col("source").alias("name"), "source_size", "target", parts)
    hash_ = F.xxhash64("id", "key")
    bucket = F.pmod(F.col("hash"), F.lit(buckets)).alias("bucket")
    part = F.expr(f"bucket * parts div {buckets}L").alias("part")
    rows = rows.join(named, rows["source"].eqNullSafe(named["name"])).drop("name").withColumn("hash", hash_).select("*", bucket).select("*", part)

    # Where each document begins in its source's stream: sums inside buckets, over buckets, over groups of buckets.
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda column, window: F.coalesce(F.sum(column).over(window), F.lit(0))
    sums = rows.groupBy("number", "bucket", "part").agg(F.sum("size").alias("total")).withColumn("group", F.expr(f"bucket div {BUCKETS}"))
    groups = sums.groupBy("number", "group").agg(F.sum("total").alias("all")).select("number", "group", upto("all", before("number").orderBy("group")).alias("low"))
    bases = sums.withColumn("base", upto("total", before("number", "group").orderBy("bucket"))).join(groups, ["number", "group"])
    bases = common.stored(bases.select("number", "bucket", "part", "total", (F.col("base") + F.col("low")).alias("base")), "bases")
    inside = upto("size", before("number", "bucket").orderBy("hash", "key"))
    placed = rows.withColumn("inside", inside).join(bases.select("number", "bucket", "base"), ["number", "bucket"])
    placed = placed.select("id", "source", "number", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("inside") + F.col("base")).alias("start"))

    slots = drawn_slots(sources, max(1, -(-(total["slots"] or 0) // SHARD_SLOTS)), total["slots"] or 0, block_words, seed)
    spans = bases.groupBy("number", "part").agg(F.min("base").alias("base"), F.sum("total").alias("total")).where("total > 0")
    keyed = read.withColumn("key", F.xxhash64("text")).withColumn("hash", hash_)
    texts = keyed.join(named, keyed["source"].eqNullSafe(named["name"])).select("number", "parts", "hash", "key", "text", bucket).select("*", part)
    return Mix(placed, sources, slots, _written(texts, spans, slots, block_words, seed))


def bucket_count(documents: int, words: int) -> int:
    """Hash buckets of a source: some BUCKET_DOCS documents each, and enough of them to split any source at PART_WORDS words."""
    return max(1, documents // BUCKET_DOCS, 2 * words // PART_WORDS)


def planned_sources(rows: DataFrame, weights: tuple[float, ...], share: float, cap: float, block_words: int, seed: int) -> DataFrame:
    """The sources by code point, null last, with their targets, blocks and slots, stored."""
    order = F.col("source").asc_nulls_last()
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).orderBy(order)
    found = common.stored(found.withColumn("part", F.spark_partition_id()), "sources")
    # Numbered inside the sorted parts; the parts, as many as shuffle partitions at most, are counted in one task.
    parts = found.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    parts = parts.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("low"))
    number = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.col("low")
    numbered = found.join(parts, "part").withColumn("number", number)
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    aimed = targets_of(common.stored(numbered.select("number", "source", "size", "n", turn.alias("weight")), "numbered-sources"), share, cap)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            plans = [plan_source(None, int(s), t, int(k), block_words, seed) for k, s, t in zip(frame["number"], frame["size"], frame["target"])]
            yield frame.rename(columns={"size": "source_size"}).assign(**{c: np.array([getattr(p, c) for p in plans], np.int64) for c in ("blocks", "slots", "last_words")})

    kinds = "number long, source string, source_size long, n long, target double, blocks long, slots long, last_words long"
    return common.stored(aimed.select("number", "source", "size", "n", "target").mapInPandas(run, kinds), "planned-sources")


def shard_counts(n: int, shards: int, low: int, high: int, seed: int, number: int) -> Iterator[tuple[int, int, int]]:
    """Of n slots of a source, dealt to ``shards`` by a multinomial draw, those of the shards in [low, high): shard, first slot, count.

    A draw splits a range of shards in two; any range is drawn alike by all who ask.
    """
    todo = [(0, shards, n, 0)]
    while todo:
        a, b, n, first = todo.pop()
        if not n or b <= low or a >= high:
            continue
        if b - a == 1:
            yield a, first, n
            continue
        middle = (a + b) // 2
        left = int(np.random.default_rng([seed, number, a, b]).binomial(n, (middle - a) / (b - a)))
        todo += [(middle, b, n - left, first + left), (a, middle, left, first)]


def drawn_slots(sources: DataFrame, shards: int, total: int, block_words: int, seed: int) -> DataFrame:
    """The slots of all shards: shard, number, slot, block (by the source's permutation), words."""
    parts = F.expr(f"greatest(1L, least({shards}L, slots div {DRAWN_SLOTS} + 1))")
    ranges = sources.where("slots > 0").withColumn("parts", parts).withColumn("range", F.explode(F.expr("sequence(0L, parts - 1)")))
    ranges = ranges.select("number", "blocks", "slots", "last_words", F.expr(f"range * {shards} div parts").alias("low"), F.expr(f"(range + 1) * {shards} div parts").alias("high"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, blocks, slots, last, low, high in frame.itertuples(index=False):
                for shard, first, n in shard_counts(slots, shards, low, high, seed, number):
                    slot = np.arange(first, first + n)
                    passes = slot // blocks
                    block = permuted(slot % blocks, blocks, passes, seed, number)
                    yield pd.DataFrame({"shard": shard, "number": number, "slot": slot, "block": block, "words": np.where(slot == slots - 1, last, block_words)})

    tasks = int(min(20_000, total // DRAWN_SLOTS + 8))
    return ranges.repartition(tasks, "number", "low").mapInPandas(run, "shard long, number long, slot long, block long, words long")


def _written(texts: DataFrame, spans: DataFrame, slots: DataFrame, block_words: int, seed: int) -> DataFrame:
    heads = ["number", "part", "bucket", "hash", "key"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts by source and part, a pack for each and PACK_BYTES."""
        rows, size = [], 0

        def flush() -> pa.RecordBatch:
            rows.sort(key=lambda r: r[:2])
            edges = [0, *(k for k in range(1, len(rows)) if rows[k][:2] != rows[k - 1][:2]), len(rows)]
            out = []
            for a, b in zip(edges, edges[1:]):
                head = np.array([(*r[2:5], len(r[5])) for r in rows[a:b]], np.int64)
                out.append((*rows[a][:2], b - a, _packed(head.T), int(head[:, 3].sum()), _packed(b"".join(r[5] for r in rows[a:b]))))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()))], ["number", "part", "n", "head", "size", "text"])

        for batch in batches:
            for *head, text in zip(*(batch.column(c).to_pylist() for c in heads), batch.column("text")):
                rows.append((*head, text.as_py().encode("utf-8", "surrogatepass")))
                size += len(rows[-1][-1])
                if size >= PACK_BYTES:
                    yield flush()
                    rows, size = [], 0
        if rows:
            yield flush()

    def cut(packs: pa.Table, drawn: pa.Table) -> pa.Table:
        """A part's blocks, joined by index with the slots that draw them: the pieces of its texts, a pack for each shard."""
        docs: list[tuple] = []
        for row in packs.to_pylist() if drawn.num_rows else ():
            head = np.frombuffer(_unpacked(row["head"], 32 * row["n"]), np.int64).reshape(4, -1)
            text, ends = memoryview(_unpacked(row["text"], row["size"])), np.cumsum(head[3]).tolist()
            docs += zip(*head[:3].tolist(), (text[a:b] for a, b in zip([0, *ends], ends)))
        docs.sort(key=lambda d: d[:3])
        starts = [word_starts(np.frombuffer(d[3], np.uint8)) for d in docs]
        sizes = np.array([len(s) for s in starts], np.int64)
        block, slot, shard, words = (drawn.column(c).to_numpy() for c in ("block", "slot", "shard", "words"))
        order = np.lexsort((slot, block))
        block, slot, shard, words = block[order], slot[order], shard[order], words[order]
        end = np.cumsum(sizes) + (drawn.column("base")[0].as_py() if drawn.num_rows else 0)
        begin = end - sizes
        n_blocks = np.where(sizes > 0, (end - 1) // block_words - begin // block_words + 1, 0)
        doc = np.repeat(np.arange(len(docs)), n_blocks)
        at = begin[doc] // block_words + np.arange(len(doc)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        low, high = np.searchsorted(block, at), np.searchsorted(block, at, "right")
        times = high - low
        doc, at = np.repeat(doc, times), np.repeat(at, times)
        draw = np.repeat(low, times) + np.arange(len(doc)) - np.repeat(np.cumsum(times) - times, times)
        lo, hi = np.maximum(begin[doc] - at * block_words, 0), np.minimum(np.minimum(end[doc] - at * block_words, block_words), words[draw])
        first = np.maximum(at * block_words - begin[doc], 0)
        taken = hi > lo
        doc, draw, lo, n, first = doc[taken], draw[taken], lo[taken], (hi - lo)[taken], first[taken]
        pieces: list[bytes] = []
        for d, a, b in zip(doc.tolist(), first.tolist(), (first + n).tolist()):
            text, at_ = docs[d][3], starts[d]
            pieces.append(bytes(text[at_[a] : at_[b] if b < len(at_) else len(text)]))
        number = np.full(len(doc), packs.column("number")[0].as_py() if len(docs) else 0, np.int64)
        shard, head = shard[draw], np.column_stack([number, slot[draw], lo, begin[doc], n, np.array([len(p) for p in pieces], np.int64)])
        by_shard = np.argsort(shard, kind="stable")
        shard, head = shard[by_shard], head[by_shard]
        edges = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist() if len(shard) else []
        spans = list(zip(edges, [*edges[1:], len(shard)]))
        columns = {
            "shard": pa.array([int(shard[a]) for a, _ in spans], pa.int64()),
            "n": pa.array([b - a for a, b in spans], pa.int64()),
            "head": pa.array([_packed(head[a:b].T) for a, b in spans], pa.binary()),
            "size": pa.array([int(head[a:b, 5].sum()) for a, b in spans], pa.int64()),
            "text": pa.array([_packed(b"".join(pieces[k] for k in by_shard[a:b])) for a, b in spans], pa.binary()),
        }
        return pa.table(columns)

    def assembled(packs: pa.Table) -> pa.Table:
        """A shard's slots in their drawn order, put together from all packs."""
        heads = np.concatenate([np.frombuffer(_unpacked(h, 48 * n), np.int64).reshape(6, -1) for h, n in zip(packs.column("head").to_pylist(), packs.column("n").to_pylist())], axis=1)
        data = b"".join(_unpacked(t, s) for t, s in zip(packs.column("text").to_pylist(), packs.column("size").to_pylist()))
        ends = np.append(0, np.cumsum(heads[5]))
        texts = pa.Array.from_buffers(pa.large_string(), heads.shape[1], [None, pa.py_buffer(ends), pa.py_buffer(data)])
        number, slot, lo, start, n, _ = heads
        drawn = _mixed(_mixed(number.astype(np.uint64) + np.uint64(seed)) + slot.astype(np.uint64))
        order = np.lexsort((lo, slot, number, drawn))
        number, slot, start, n = number[order], slot[order], start[order], n[order]
        new = np.flatnonzero(np.append(True, (slot[1:] != slot[:-1]) | (number[1:] != number[:-1])))
        inner = pa.StructArray.from_arrays([pa.array(start), pa.array(n), texts.take(pa.array(order)).cast(pa.string())], ["start", "words", "text"])
        pieces = pa.ListArray.from_arrays(pa.array(np.append(new, len(n)).astype(np.int32)), inner)
        shard = np.full(len(new), packs.column("shard")[0].as_py(), np.int64)
        return pa.table({"number": number[new], "slot": slot[new], "words": np.add.reduceat(n, new), "pieces": pieces, "shard": shard})

    # A slot's part: its block is among those of the part, at either end perhaps together with the next part.
    ends = spans.select("number", "part", "base", F.expr(f"base div {block_words}").alias("low"), F.expr(f"(base + total - 1) div {block_words}").alias("high"))
    ends = ends.withColumn("near", F.explode(F.expr(f"sequence(low div {NEAR}, high div {NEAR})")))
    # The planner would take the draws for as small as the table they unfold from, and broadcast them.
    routed = slots.withColumn("near", F.expr(f"block div {NEAR}")).hint("merge").join(ends, ["number", "near"]).where("block between low and high")
    routed = routed.select("number", "part", "base", "block", "slot", "shard", "words")
    packs = texts.select(*heads, "text").mapInArrow(pack, "number long, part long, n long, head binary, size long, text binary")
    pieces = packs.groupBy("number", "part").cogroup(routed.groupBy("number", "part")).applyInArrow(cut, "shard long, n long, head binary, size long, text binary")
    shape = "number long, slot long, words long, pieces array<struct<start:bigint,words:bigint,text:string>>, shard long"
    whole = pieces.groupBy("shard").applyInArrow(assembled, shape)
    path = common.shared_dir(texts.sparkSession, "mix-shards")
    whole.write.partitionBy("shard").option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6").option("parquet.page.size", str(4 << 20)).parquet(path)
    return texts.sparkSession.read.schema(whole.schema).parquet(path)


def word_starts(text: np.ndarray) -> np.ndarray:
    """Where the words of a text (UTF-8 bytes) begin."""
    word = (text != 32) & ((text < 9) | (text > 13))
    return np.flatnonzero(word & np.append(True, ~word[:-1])) if len(text) else np.zeros(0, np.int64)


def taken_words(mixed: Mix, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: id, size, source_size, target (of its source) and taken, the words of it in the shards as written.

    Any ``block_words`` gives the same: the pieces are counted.
    """
    pieces = mixed.shards.select("number", F.explode("pieces").alias("p"))
    sums = pieces.groupBy("number", F.col("p.start").alias("start")).agg(F.sum(F.expr(f"regexp_count(p.text, '{WORD}')")).alias("taken"))
    found = mixed.docs.join(sums, ["number", "start"], "left")
    return found.select("id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
