"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes.

Texts become sets of hashed word shingles; equal sets are one class. Two classes whose
sets have a Jaccard similarity of at least t overlap in ceil(t n) tokens of either, so
under one global token order they share at least m tokens among the first
n - ceil(t n) + m of each, for every m. Tokens are ordered from rare to common by exact
counts over all documents, so tokens that many documents share come last. Each class
picks its own m: it starts from 1 and lengthens its prefix while the estimated cost,
candidates to read plus candidates to verify, falls, as more shared tokens are asked for
before a pair is verified. Tokens beyond the MAX_COMMON most common ones weigh what they
weigh on average. A pair is verified when it shares at least as many prefix tokens as the
smaller m of the two, on short and long lists together.

A token's list of SMALL_LIST classes or fewer gives all its pairs, a longer one the pairs
with its first class. Of these each class first meets only the one that it shares most
tokens with; classes that turn out to be linked need no further pair between them, as
they are in one component already. The other pairs of short lists follow, and ROUNDS
draws of random groups from long ones, which join most of what is left. Pairs between
the components that then still share a list are taken in full, but for those that sizes
or a sketch of the sets rule out; members of the component that most of a list is in
don't meet each other. So groups of near copies never are expanded into all pairs, and no
link that could join two components is left out. Lists of more than HOT classes are dealt
over several groups, and where lists are joined, over salts.

Work on tokens is done on packed arrays: tasks send blocks of sorted tokens by token
range, so what is shuffled are a few bytes a token. Classes have 64-bit numbers, checked by
128 bits: the first pass finds numbers that different sets share, and those sets get others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm import common

SHINGLE = 5
PERCENT = 80
SMALL_LIST = 6
MAX_MATCHES = 4
VERIFY_COST = 8.0
MIN_COUNT = 4  # tokens of fewer documents count as rare alike
MAX_COMMON = 1_000_000  # tokens whose counts are broadcast; the least count is raised until they fit
FLUSH_TOKENS = 400_000  # tokens that a task holds at once, some 150 bytes each while they are sorted and packed
PIECE_BYTES = 1_000_000
MAX_FILTER_BITS = 27
SKETCH = 8  # words of 64 bits
SKETCHES = [f"s{k}" for k in range(SKETCH)]
GROUP = 48
ROUNDS = 1
HOT = 20_000  # documents on a token's list, above which it is dealt over groups
LEAST = 8  # tokens of a class by which the first one that a pair shares is known
BLOCK = 2_000  # classes of a list that a class meets in one task
SALTS = 32
DOUBT = 20  # two sets hold a pair of tokens that only look equal with a chance of 2^-DOUBT at most


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Per text its sorted distinct shingle hashes; a text of fewer words is one shingle, one of none is empty."""
    lists = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    coded = pa.array([w for words in lists for w in words], pa.binary()).dictionary_encode()
    terms = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    words = terms[coded.indices.to_numpy()] if len(terms) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        rolled = words[: max(0, len(words) - shingle + 1)]
        for k in range(1, shingle):
            rolled = _mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(rolled)])
        found, at = [], 0
        for n in map(len, lists):
            if n >= shingle:
                found.append(np.unique(rolled[at : at + n - shingle + 1]))
            else:
                one = np.array([n], np.uint64)
                for k in range(n):
                    one = _mixed(one * np.uint64(0xD6E8FEB86659FD93) + words[at + k : at + k + 1])
                found.append(one if n else one[:0])
            at += n
    return found


def width_of(n: int) -> int:
    """Bytes of a token that tell the tokens of two sets of n apart, but for the chance that DOUBT allows: 5 up to 1 024 tokens, 8 above 262 144."""
    return min(8, max(5, -(-(2 * max(1, n - 1).bit_length() + DOUBT) // 8)))


def set_bytes(tokens: np.ndarray) -> bytes:
    """A sorted set by the upper bytes of its tokens, as many as its size asks for."""
    return tokens.astype(">u8").view(np.uint8).reshape(-1, 8)[:, : width_of(len(tokens))].tobytes()


def set_of(data, n: int, width: int) -> np.ndarray:
    """The stored set of n tokens, by ``width`` bytes of each."""
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(n, width_of(n))[:, :width]
    return out.view(">u8").ravel().astype(np.uint64)


def shared_tokens(left, n: int, right, m: int) -> int:
    """How many tokens two stored sets share."""
    width = min(width_of(n), width_of(m))
    merged = np.sort(np.concatenate([set_of(left, n, width), set_of(right, m, width)]))
    return int((merged[1:] == merged[:-1]).sum())


def odd_buckets(tokens: np.ndarray, size: int) -> np.ndarray:
    """A bit for each of ``size`` buckets of tokens: if the set's tokens in it are odd in number."""
    odd = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def long_sketch(tokens: np.ndarray) -> bytes | None:
    """Odd buckets, half to one for each token, of sets that are too large for the sketch of SKETCH words."""
    return odd_buckets(tokens, 1 << (len(tokens) - 1).bit_length() - 1).tobytes() if len(tokens) > 64 * SKETCH else None


def differ_at_least(left: bytes | None, right: bytes | None) -> int:
    """A lower bound of how many tokens two sets differ in, by their long sketches; the longer one is folded."""
    if left is None or right is None:
        return 0
    x, y = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def class_of(tokens: np.ndarray, clashes: frozenset[int] = frozenset()) -> tuple[int, int]:
    """Two signed 64-bit hashes of a whole set: its number and a check. A number that several sets have gives way to the check."""
    digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    number, check = (int.from_bytes(digest[k : k + 8], "big", signed=True) for k in (0, 8))
    return (check, number) if number in clashes else (number, check)


def prefix_size(n: int, matches: int, percent: int = PERCENT) -> int:
    return min(n, n - -(-percent * n // 100) + matches)


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of batches of bounded text size, with the shingle sets of their column ``text``."""
    for batch in batches:
        size, first = 0, 0
        texts = batch.column("text")
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for k, n in enumerate(sizes):
            size += n
            if size >= PIECE_BYTES or k + 1 == len(sizes):
                yield batch.slice(first, k + 1 - first), shingle_sets(texts.slice(first, k + 1 - first).to_pylist(), shingle)
                size, first = 0, k + 1


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd"), kind)


class Join:
    """The steps of one join over ``docs`` (id, key, text)."""

    def __init__(self, docs: DataFrame, shingle: int, percent: int) -> None:
        self.docs, self.shingle, self.percent = docs, shingle, percent
        self.spark = docs.sparkSession
        shuffles = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        #: Token ranges: a power of two, a few for each shuffle partition, 64 at least.
        self.bits = max(6, min(20, (2 * shuffles - 1).bit_length()))
        self.hot = HOT
        self.common = self.spark.sparkContext.broadcast(self.counted())

    def counted(self) -> Common:
        """The most common tokens, how many documents hold them and the others on average, and clashing class numbers."""
        bits, shingle = self.bits, self.shingle

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting, n, seen = [], 0, {}

            def flush() -> pa.RecordBatch:
                tokens, counts = np.unique(np.concatenate(waiting), return_counts=True)
                edges = np.searchsorted(tokens, np.arange(1 << bits, dtype=np.uint64) << np.uint64(32 - bits))
                edges = np.append(edges, len(tokens))
                rows = [(p, int(b - a), _packed(np.diff(tokens[a:b], prepend=np.uint32(0))), _packed(counts[a:b].astype(np.uint32))) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
                numbers, checks = np.array(list(seen), np.int64), np.array(list(seen.values()), np.int64)
                place = numbers & ((1 << bits) - 1)
                order = np.argsort(place, kind="stable")
                edges = np.searchsorted(place[order], np.arange((1 << bits) + 1))
                rows += [(-1 - p, int(b - a), numbers[order[a:b]].tobytes(), checks[order[a:b]].tobytes()) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["part", "n", "tokens", "counts"])

            for batch, sets in _sets(batches, shingle):
                for tokens in sets:
                    if not len(tokens):
                        continue
                    number, check = class_of(tokens)
                    if seen.get(number) != check:
                        if number in seen:  # two sets with one number: both are told
                            yield flush()
                            waiting, n, seen = [], 0, {}
                        seen[number] = check
                        waiting.append((tokens >> np.uint64(32)).astype(np.uint32))
                        n += len(tokens)
                if n >= FLUSH_TOKENS:
                    yield flush()
                    waiting, n, seen = [], 0, {}
            if waiting:
                yield flush()

        def summed(table: pa.Table) -> pa.Table:
            if table.column("part")[0].as_py() < 0:
                numbers, checks = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("tokens", "counts"))
                order = np.lexsort((checks, numbers))
                numbers, checks = numbers[order], checks[order]
                clash = np.unique(numbers[1:][(numbers[1:] == numbers[:-1]) & (checks[1:] != checks[:-1])])
                return pa.table({"token": clash, "count": np.full(len(clash), -1, np.int64)})
            parts = [(np.cumsum(_unpacked(r["tokens"], np.uint32, r["n"]), dtype=np.uint32), _unpacked(r["counts"], np.uint32, r["n"])) for r in table.to_pylist()]
            tokens, counts = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(tokens, kind="stable")
            tokens, counts = tokens[order], counts[order].astype(np.int64)
            first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            counts = np.add.reduceat(counts, first)
            keep = counts >= MIN_COUNT
            return pa.table({"token": tokens[first][keep].astype(np.int64), "count": counts[keep]})

        blocks = self.docs.mapInArrow(counted, "part int, n int, tokens binary, counts binary")
        counts = common.stored(blocks.groupBy("part").applyInArrow(summed, "token long, count long"), "token-counts")
        powers = counts.where("count > 0").groupBy(F.expr("cast(log2(count) as int)").alias("power")).agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("total"))
        sizes = sorted(map(tuple, powers.collect()), reverse=True)
        least, taken = 1 << 62, 0
        for power, n, _ in sizes:
            if (taken := taken + n) > MAX_COMMON:
                break
            least = 1 << power
        rest = [(n, total) for power, n, total in sizes if 1 << power < least]
        other = sum(t for _, t in rest) / sum(n for n, _ in rest) if rest else 1.0
        found = counts.where(F.col("count") >= least).toArrow().sort_by("token")
        clashes = counts.where("count < 0").toArrow().column("token").to_pylist()  # next to none: n * n / 2^65 of n sets
        return Common(found.column("token").to_numpy().astype(np.uint32), found.column("count").to_numpy().astype(np.float32), other, frozenset(clashes))

    def postings(self) -> DataFrame:
        """Blocks of prefix tokens by token range: part, n, tokens, classes, shapes (size * MAX_MATCHES + matches - 1)."""
        sent, hot = self.common, self.hot
        bits, shingle, percent = self.bits, self.shingle, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common_ = sent.value
            waiting, n, seen = [], 0, set()

            def flush() -> pa.RecordBatch:
                tokens, classes, shapes, weights = (np.concatenate(x) for x in zip(*waiting))
                # The upper bits of a token are its part; tokens of long lists get one of the other parts for each salt.
                part = (tokens >> np.uint64(64 - bits)).astype(np.int64)
                if len(at := np.flatnonzero(weights > hot)):
                    salt = (_mixed(classes[at].view(np.uint64)) % np.ceil(weights[at] / hot).astype(np.uint64)).astype(np.uint64)
                    part[at] = (1 << bits) + (_mixed(tokens[at] + salt) >> np.uint64(64 - bits)).astype(np.int64)
                order = np.lexsort((tokens, part))
                tokens, classes, shapes, part = tokens[order], classes[order], shapes[order], part[order]
                edges = np.searchsorted(part, np.arange((2 << bits) + 1))
                rows = [(p, int(b - a), _packed(np.diff(tokens[a:b], prepend=np.uint64(0))), classes[a:b].tobytes(), _packed(shapes[a:b])) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["part", "n", "tokens", "classes", "shapes"])

            for batch, sets in _sets(batches, shingle):
                for tokens in sets:
                    if not len(tokens) or (cls := class_of(tokens, common_.clashes)[0]) in seen:
                        continue
                    seen.add(cls)
                    first, weights, matches = chosen_prefix(tokens, common_, percent)
                    waiting.append((first, np.full(len(first), cls, np.int64), np.full(len(first), len(tokens) * MAX_MATCHES + matches - 1, np.int64), weights))
                    n += len(first)
                if n >= FLUSH_TOKENS:
                    yield flush()
                    waiting, n, seen = [], 0, set()
            if waiting:
                yield flush()

        return self.docs.mapInArrow(run, "part int, n int, tokens binary, classes binary, shapes binary")

    def lists(self) -> DataFrame:
        """What token lists of two classes and more give, stored: pairs (a < b) with their shared tokens, or members.

        kind 0: the pairs of short lists; 1: pairs with the first class of long lists; 2: a
        long list's member (a: token, b: class, n: shape).
        """
        percent, dealt = self.percent, 1 << self.bits

        def run(table: pa.Table) -> pa.Table:
            short = SMALL_LIST if table.column("part")[0].as_py() < dealt else 0  # a part of a dealt list is never all of it
            parts = [(np.cumsum(_unpacked(r["tokens"], np.uint64, r["n"]), dtype=np.uint64), np.frombuffer(r["classes"], np.int64), _unpacked(r["shapes"], np.int64, r["n"])) for r in table.to_pylist()]
            token, cls, shape = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((cls, token))
            token, cls, shape = token[order], cls[order], shape[order]
            new = np.append(True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1]))  # a class may come from several tasks
            token, cls, shape = token[new], cls[new], shape[new]
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            size = np.diff(np.append(first, len(token)))
            a, b, kind, need = [], [], [], []

            def add(x: np.ndarray, y: np.ndarray, what: int) -> None:
                n, m = shape[x] // MAX_MATCHES, shape[y] // MAX_MATCHES
                keep = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
                x, y = x[keep], y[keep]
                a.append(cls[x]), b.append(cls[y]), kind.append(np.full(len(x), what, np.int64))
                need.append(np.minimum(shape[x] % MAX_MATCHES, shape[y] % MAX_MATCHES) + 1)

            for g in range(2, short + 1):
                at = first[size == g]
                for i in range(g):
                    for j in range(i + 1, g):
                        add(at + i, at + j, 0)
            long_ = size > short
            lead = np.repeat(first[long_], size[long_])
            member = lead + np.arange(len(lead)) - np.repeat(np.cumsum(size[long_]) - size[long_], size[long_])
            add(lead[member > lead], member[member > lead], 1)
            if short and len(member):  # whole lists: members without another one of like size are out
                by_size = member[np.lexsort((shape[member], token[member]))]
                n, same = shape[by_size] // MAX_MATCHES, token[by_size][1:] == token[by_size][:-1]
                like = same & (100 * n[:-1] >= percent * n[1:])
                member = by_size[np.append(like, False) | np.append(False, like)]
            a, b, kind, need = (np.concatenate(x) for x in (a, b, kind, need))
            order = np.lexsort((b, a, kind))
            a, b, kind, need = a[order], b[order], kind[order], need[order]
            head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (kind[1:] != kind[:-1]))) if len(a) else np.zeros(0, np.int64)
            shared = np.diff(np.append(head, len(a)))
            a, b, kind, need = a[head], b[head], kind[head], need[head]
            columns = {"kind": (kind, np.full(len(member), 2, np.int64)), "a": (a, token[member].astype(np.int64)), "b": (b, cls[member]), "n": (shared, shape[member]), "need": (need, np.zeros(len(member), np.int64))}
            return pa.table({k: np.concatenate(v) for k, v in columns.items()})

        return common.stored(self.postings().groupBy("part").applyInArrow(run, "kind long, a long, b long, n long, need long"), "token-lists")

    def bitmap(self, classes: DataFrame) -> tuple[int, np.ndarray]:
        """Which classes are in a column ``c``, as a bitmap of at most 2^MAX_FILTER_BITS bits.

        It may let some others through, never keeps one out.
        """
        bits = max(16, min(MAX_FILTER_BITS, int(classes.count() * 16).bit_length()))
        place = classes.select(F.expr(f"c & {(1 << bits) - 1}L").alias("p"))
        words = place.groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("m")).toArrow()
        out = np.zeros(1 << (bits - 6), np.int64)
        out[words.column("w").to_numpy()] = words.column("m").to_numpy()
        return bits, out

    def described(self, lists: DataFrame) -> DataFrame:
        """All documents: id, key, n, cls; and of those whose class is in some list the set and its sketches, stored."""
        classes = lists.where("kind < 2").select(F.explode(F.array("a", "b")).alias("c")).union(lists.where("kind = 2").select("b")).distinct()
        bits, known = self.bitmap(classes)
        sent, common_, shingle = self.spark.sparkContext.broadcast(known), self.common, self.shingle
        id_type = self.docs.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, clashes = set(), common_.value.clashes
            for batch, sets in _sets(batches, shingle):
                classes = np.array([class_of(tokens, clashes)[0] if len(tokens) else 0 for tokens in sets], np.int64)
                wanted = marked(classes, bits, sent.value)
                blobs, long_, sketches = [], [], np.zeros((len(sets), SKETCH), np.uint64)
                for k, tokens in enumerate(sets):
                    take = len(tokens) and wanted[k] and classes[k] not in seen
                    blobs.append(set_bytes(tokens) if take else None)
                    long_.append(long_sketch(tokens) if take else None)
                    if take:
                        seen.add(classes[k])
                        sketches[k] = odd_buckets(tokens, 64 * SKETCH).view(np.uint64)
                sizes = np.array([len(t) for t in sets], np.int64)
                columns = [batch.column("id"), batch.column("key"), pa.array(sizes), pa.array(classes, mask=sizes == 0), pa.array(blobs, pa.binary()), pa.array(long_, pa.binary())]
                columns += [pa.array(sketches[:, j].view(np.int64)) for j in range(SKETCH)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "key", "n", "cls", "tokens", "long", *SKETCHES])

        kinds = "".join(f", {s} long" for s in SKETCHES)
        return common.stored(self.docs.mapInArrow(run, f"id {id_type}, key long, n long, cls long, tokens binary, long binary{kinds}"), "shingle-sets")

    def verified(self, pairs: DataFrame, rows: DataFrame, sketches: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough, stored.

        Sketches go first: two sets differ in at least as many tokens as their sketches in
        bits. Only what that leaves open gets whole sets.
        """
        percent = self.percent
        x = sketches.select(F.col("cls").alias("a"), F.col("n").alias("xn"), F.col("long").alias("xlong"), *[F.col(s).alias(f"x{s}") for s in SKETCHES])
        y = sketches.select(F.col("cls").alias("b"), F.col("n").alias("yn"), F.col("long").alias("ylong"), *[F.col(s).alias(f"y{s}") for s in SKETCHES])
        near = pairs.join(by_shuffle(x), "a").join(by_shuffle(y), "b").where(may_link("xn", "x", "yn", "y", percent))

        def by_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = zip(batch.column("xn").to_pylist(), batch.column("yn").to_pylist())
                bounds = map(differ_at_least, batch.column("xlong").to_pylist(), batch.column("ylong").to_pylist())
                yield batch.select(["a", "b", "xn", "yn"]).filter(pa.array([(100 + percent) * d <= (100 - percent) * (n + m) for (n, m), d in zip(sizes, bounds)], pa.bool_()))

        open_ = common.stored(near.select("a", "b", "xn", "yn", "xlong", "ylong").mapInArrow(by_long, "a long, b long, xn long, yn long"), "pairs")
        bits, known = self.bitmap(open_.select(F.explode(F.array("a", "b")).alias("c")).distinct())
        sent = self.spark.sparkContext.broadcast(known)

        def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(marked(batch.column("cls").to_numpy(zero_copy_only=False).astype(np.int64), bits, sent.value)))

        sets = rows.where("tokens is not null").select("cls", "tokens").mapInArrow(wanted, "cls long, tokens binary").groupBy("cls").agg(F.first("tokens").alias("tokens"))
        right = open_.join(by_shuffle(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("right"))), "b")
        both = right.join(by_shuffle(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("left"))), "a")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, n, y, m in zip(batch.column("left"), batch.column("xn").to_pylist(), batch.column("right"), batch.column("yn").to_pylist()):
                    both = shared_tokens(x.as_buffer(), n, y.as_buffer(), m)
                    keep.append(100 * both >= percent * (n + m - both))
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

        return common.stored(both.select("a", "b", "xn", "yn", "left", "right").mapInArrow(run, "a long, b long"), "links")

    def open_lists(self, lists: DataFrame, found: DataFrame) -> DataFrame:
        """The long lists that hold classes of several components: token, cls, shape, root, stored."""
        member = lists.where("kind = 2").select(F.col("a").alias("token"), F.col("b").alias("cls"), F.col("n").alias("shape"))
        placed = member.join(by_shuffle(found), member["cls"] == found["node"], "left").select("token", "cls", "shape", F.coalesce("root", "cls").alias("root"))
        mixed = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
        return common.stored(by_salts(placed, mixed, "token"), "open-lists")

    def drawn_pairs(self, open_: DataFrame, number: int) -> DataFrame:
        """Some pairs between components of open lists: each class picks a list, in each list classes meet in
        random groups of about GROUP. A pick is the list's least hash, so similar classes pick alike."""
        pick = open_.groupBy("cls", "root").agg(F.min_by("token", F.xxhash64("token", F.lit(number))).alias("token"))
        sizes = pick.groupBy("token").agg(F.count(F.lit(1)).alias("size"))
        dealt = by_salts(pick, sizes, "token").withColumn("g", F.pmod(F.xxhash64("cls", F.lit(number)), F.ceil(F.col("size") / GROUP).cast("long")))
        x, y = (dealt.select("token", "g", F.col("cls").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
        return x.join(by_shuffle(y), ["token", "g"]).where("a < b and a_root <> b_root").select("a", "b")

    def all_pairs(self, open_: DataFrame, sketches: DataFrame) -> DataFrame:
        """Every pair (a, b) between components that shares an open list and may link by its sketches.

        A pair is made at the first token that it shares, not at each: every class carries its LEAST least
        tokens, and where two have one in common, lists behind that one leave the pair out. Of a list, the classes outside the component that most of it is in meet all others, those of like size in
        blocks of BLOCK, so a list of very many near copies isn't squared.
        """
        size = F.expr(f"shape div {MAX_MATCHES}")
        # Sizes of 80 % and more lie in the same or in neighbouring bands.
        band = F.floor(F.log(100 / self.percent + 0.01, size)) if self.percent > 50 else F.lit(0)
        rows = open_.withColumn("band", band.cast("long"))
        first = open_.groupBy("cls").agg(F.slice(F.array_sort(F.collect_set("token")), 1, LEAST).alias("first"))
        roots = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
        lists = roots.groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.ceil(F.sum("n") / BLOCK).cast("long").alias("blocks"))
        known = sketches.drop("long").join(by_shuffle(first), "cls")
        rich = by_salts(rows, lists, "token").join(by_shuffle(known), "cls")
        y = rich.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks"))).alias("y")
        x = rich.where("root <> main").withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("band", F.explode(F.expr("sequence(band - 1, band + 1)"))).alias("x")
        same = (F.col("x.token") == F.col("y.token")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.band") == F.col("y.band"))
        apart = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.cls") < F.col("y.cls")))
        # Evaluated last: the tokens of both ascend, so what they have in common is the least of it.
        here = F.coalesce(F.get(F.array_intersect("x.first", "y.first"), F.lit(0)) >= F.col("x.token"), F.lit(True))
        met = x.join(by_shuffle(y), same & apart & may_link("x.n", "x.", "y.n", "y.", self.percent) & here)
        return met.select(F.expr("least(x.cls, y.cls)").alias("a"), F.expr("greatest(x.cls, y.cls)").alias("b"))


class Common(NamedTuple):
    """What the first pass finds: the upper halves of the most common tokens, ascending, the number of documents of each
    and of other tokens on average, and the numbers that several classes have."""

    tokens: np.ndarray
    counts: np.ndarray
    other: float
    clashes: frozenset[int]

    def weights(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.full(len(tokens), self.other)
        upper = (tokens >> np.uint64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(self.tokens, upper), len(self.tokens) - 1)
        return np.where(self.tokens[at] == upper, self.counts[at], self.other).astype(np.float64)


def by_salts(rows: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """Join classes with something that each list has one row of; a list's classes are dealt over SALTS tasks."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int"))
    each = lists.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    return salted.join(by_shuffle(each), [key, "salt"]).drop("salt")


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: the planner takes packed files for smaller than they are and would broadcast them."""
    return df.hint("merge")


def marked(classes: np.ndarray, bits: int, bitmap: np.ndarray) -> np.ndarray:
    place = classes & ((1 << bits) - 1)
    return (bitmap[place >> 6] >> (place & 63)) & 1 == 1


def may_link(xn: str, x: str, yn: str, y: str, percent: int):
    """If sizes and sketches of two sets allow the similarity: sets that are similar differ in few tokens."""
    differ = " + ".join(f"bit_count({x}{s} ^ {y}{s})" for s in SKETCHES)
    return F.expr(f"100 * least({xn}, {yn}) >= {percent} * greatest({xn}, {yn}) and {100 + percent} * ({differ}) <= {100 - percent} * ({xn} + {yn})")


def chosen_prefix(tokens: np.ndarray, common_: Common, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, int]:
    """The prefix of a set under the global order, its tokens' weights, and how many of its tokens a partner must share.

    The cost of m shared tokens: the documents on the prefix's lists, plus VERIFY_COST
    for each of the candidates, at most the m-th part of those documents.
    """
    weight = common_.weights(tokens)
    order = np.lexsort((tokens, weight))
    read = np.cumsum(weight[order])
    sizes = [prefix_size(len(tokens), m, percent) for m in range(1, MAX_MATCHES + 1)]
    costs = [read[size - 1] * (1 + VERIFY_COST / m) for m, size in enumerate(sizes, 1) if size == len(tokens) + m - -(-percent * len(tokens) // 100)]
    matches = int(np.argmin(costs)) + 1 if costs else 1
    first = order[: sizes[matches - 1]]
    return tokens[first], weight[first], matches


def components(links: DataFrame) -> DataFrame:
    """Connected components of an edge list (a, b): node, root (the smallest node), stored, by large-star and small-star steps.

    Each step takes minima by key with partial sums and joins them back, so a node of very
    many edges is dealt over tasks. It is over when every node has one edge, to a node
    without: then all components are stars. Nodes without edges don't appear.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = common.stored(both.where("v > u").join(by_shuffle(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(by_shuffle(least), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        edges = common.stored(moved.select("e.u", "e.v").where("u <> v").distinct(), "small-star")
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e")).select("e.*")
        if ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out + into > 1").isEmpty():
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return common.stored(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root"))), "components")


def joined(found: DataFrame, more: DataFrame) -> DataFrame:
    """Components that new links (a, b) join: only their roots go through ``components`` again."""
    x, y = (found.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
    rooted = more.join(by_shuffle(x), "a", "left").join(by_shuffle(y), "b", "left")
    a, b = F.coalesce("a_root", "a"), F.coalesce("b_root", "b")
    moved = components(rooted.select(a.alias("a"), b.alias("b")))
    ups = moved.select(F.col("node").alias("root"), F.col("root").alias("up"))
    old = found.join(by_shuffle(ups), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    new = moved.join(by_shuffle(found.select("node")), "node", "left_anti")
    return common.stored(old.unionByName(new.select("node", "root")), "components")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Components of the links between documents whose shingle sets have a Jaccard similarity of percent / 100 or more.

    Per row of ``docs``: id, key (64-bit text hash), n_shingles, component_id (the smallest
    id reachable by links, itself included), cls and component (the classes of equal
    sets, null without words). Null, empty and wordless texts have the empty set and are linked
    with nothing; repeated rows are linked copies; a null id never is a smallest one unless
    all are null; an empty table gives an empty result.
    """
    source = docs.select(docs[id_col].alias("id"), F.xxhash64(common.text_of(text_col)).alias("key"), docs[text_col].cast("string").alias("text"))
    join = Join(source, shingle, percent)
    lists = join.lists()
    rows = join.described(lists)
    sketches = rows.where("tokens is not null").groupBy("cls").agg(F.first("n").alias("n"), F.first("long").alias("long"), *[F.first(k).alias(k) for k in SKETCHES])
    sketches = common.stored(sketches, "sketches")
    # Each class first meets the one that it shares most tokens with, as far as the pairs at hand tell.
    on_short = F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("short")
    pairs = lists.where("kind < 2").groupBy("a", "b").agg(F.sum("n").alias("n"), on_short, F.min("need").alias("need"))
    found = components(join.verified(pairs.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"), rows, sketches))

    # Pairs inside a component need no look. Those of short lists between components are taken, with some random ones of
    # long lists; last, all that long lists leave open. Pairs that share too few tokens on short lists alone share the
    # others on long lists.
    short = pairs.where("short is not null and n >= need").select("a", "b")
    for number in range(ROUNDS + 1):
        open_ = join.open_lists(lists, found)
        drawn = join.drawn_pairs(open_, number) if number < ROUNDS else join.all_pairs(open_, sketches).distinct()
        if number == 0:
            x, y = (found.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
            apart = short.join(by_shuffle(x), "a", "left").join(by_shuffle(y), "b", "left").where("not coalesce(a_root = b_root, false)")
            drawn = drawn.union(apart.select("a", "b")).distinct()
        elif open_.isEmpty():
            break
        more = join.verified(drawn, rows, sketches)
        if not more.isEmpty():
            found = joined(found, more)

    ids = rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id"))
    placed = ids.join(by_shuffle(found), ids["cls"] == found["node"], "left").select("cls", "id", F.coalesce("root", "cls").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    labels = placed.select("cls", "component").join(by_shuffle(smallest), "component")
    result = rows.select("id", "key", F.col("n").alias("n_shingles"), "cls").join(by_shuffle(labels), "cls", "left")
    return result.select("id", "key", "n_shingles", F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "cls", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those linked to a row of smaller id.

    Of repeated rows (equal ids and sets) one stays; rows without words all stay.
    """
    found = common.stored(link_documents(docs, id_col, text_col), "linked")
    best = found.where("cls is not null").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "cls", "key")).alias("best")).select("best.id", "best.cls", "best.key")
    wordless = found.where("cls is null").select("id", F.lit(None).cast("long").alias("cls"), "key")
    key, stay_id, copy = common.fresh(docs, "key"), common.fresh(docs, "stay_id"), common.fresh(docs, "copy")
    stay = best.union(wordless).select(F.col("id").alias(stay_id), F.col("key").alias(f"{key}_stay")).distinct()
    keyed = docs.withColumn(key, F.xxhash64(common.text_of(text_col)))
    same = (keyed[key] == stay[f"{key}_stay"]) & keyed[id_col].eqNullSafe(stay[stay_id])
    kept = keyed.join(by_shuffle(stay), same, "left_semi")
    words = F.expr(f"`{text_col}` rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    order = F.row_number().over(Window.partitionBy(id_col, key).orderBy(key))
    return kept.withColumn(copy, order).where((F.col(copy) == 1) | ~F.coalesce(words, F.lit(False))).drop(key, copy)
