"""How the sources of each language differ in their terms.

Each task folds whole documents into stripes in memory: a term's document frequency and
its counts by source. Full stripes are spilled as rows and merged by key in one shuffle.
The merged stripes give the divergences at once: a term's against its language, and of
pairs of sources only what both have a term for. What one source has alone depends on
its count but not on the term, so it is summed over how many terms have which count.

With integers alone: p = 1 + floor(SCALE * (count + 1) / (N + V)) for every kept term and
group, f(p, q) = floor((p - q)^2 / q).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm import common

#: In UTF-8: letters A-Z and everything beyond ASCII.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCALE = 1_000_000_000
#: Terms and sources that a task holds before it spills them; bytes of a text that are looked through at a time.
HELD, PIECE = 600_000, 1 << 20
#: Ranks of the terms of a group.
TOP = 200


def _pieces(text: bytes) -> Iterator[bytes]:
    """``text`` in parts that split no term."""
    at = 0
    while len(text) - at > PIECE:
        cut = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]").search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def stripes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3) -> DataFrame:
    """Merged stripes: lang, term, entries of (source, docs, count), of terms in at least ``min_docs`` documents.

    The term '' (no text has it) stands for the documents themselves, so that a group
    without terms has an entry too.
    """
    rows = docs.select(common.text_of(lang_col).alias("lang"), common.text_of(source_col).alias("source"), common.text_of(text_col).alias("text"))
    kind = pa.list_(pa.struct([("source", pa.string()), ("docs", pa.int64()), ("count", pa.int64())]))

    def spilled(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        langs = defaultdict(list)
        for (lang, source), found in held.items():
            langs[lang].append((source, *found))
        for lang, groups in langs.items():
            ids: dict[bytes, int] = {}
            term = np.array([ids.setdefault(t, len(ids)) for _, in_docs, _ in groups for t in in_docs])
            docs = np.array([n for _, in_docs, _ in groups for n in in_docs.values()])
            count = np.array([counts[t] for _, in_docs, counts in groups for t in in_docs])
            order = np.argsort(term, kind="stable")
            source = pa.array([g[0] for g in groups], pa.string()).take(pa.array(np.repeat(np.arange(len(groups)), [len(g[1]) for g in groups])[order]))
            flat = pa.StructArray.from_arrays([source, pa.array(docs[order], pa.int64()), pa.array(count[order], pa.int64())], fields=list(kind.value_type))
            ends = np.append(0, np.cumsum(np.bincount(term, minlength=len(ids)))).astype(np.int32)
            entries = pa.ListArray.from_arrays(pa.array(ends), flat)
            whole = pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(ids)), pa.array(list(ids), pa.binary()).cast(pa.string()), entries], ["lang", "term", "entries"])
            for at in range(0, len(ids), 50_000):
                yield whole.slice(at, 50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                in_docs, counts = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(in_docs), {b""}
                for piece in _pieces(text.as_buffer().to_pybytes().lower()):
                    terms = TERM.findall(piece)
                    counts.update(terms)
                    seen.update(terms)
                in_docs.update(seen)
                size += len(in_docs) - before
                if size >= HELD:
                    yield from spilled(held)
                    held, size = {}, 0
        yield from spilled(held)

    made = rows.mapInArrow(run, "lang string, term string, entries array<struct<source: string, docs: long, count: long>>")
    flat = made.repartition("lang", "term").select("lang", "term", F.inline("entries"))
    merged = flat.groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("count").alias("count"))
    whole = merged.groupBy("lang", "term").agg(F.sum("docs").alias("n"), F.collect_list(F.struct("source", "docs", "count")).alias("entries"))
    return whole.filter((F.col("n") >= min_docs) | (F.col("term") == "")).select("lang", "term", "entries")


def totals(merged: DataFrame) -> DataFrame:
    """A row per language: n_terms (V) and its sources as (source, total, present): N, and how many kept terms it has."""
    flat = merged.select("lang", "term", F.inline("entries"))
    kept = F.col("term") != ""
    groups = flat.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count_if(kept).alias("present"))
    terms = merged.groupBy("lang").agg(F.count_if(kept).alias("n_terms"))
    return groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total", "present"))).alias("sources")).join(terms, "lang")


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact; ``total`` is N + V."""
    if count.size and int(count.max()) >= (1 << 63) // SCALE - 1:
        count = count.astype(object)
    return (1 + (count + 1) * SCALE // total).astype(np.int64)


def diverge(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); both are at most SCALE + 1, so squares fit 64 bits."""
    return (p - q) ** 2 // q


class Groups:
    """A language's sources in order, with N + V each, looked up in the stored totals when a task first meets it."""

    def __init__(self, path: str):
        files, root = pafs.FileSystem.from_uri(path)
        self.table, self.found = pads.dataset(root, filesystem=files, format="parquet"), {}

    def __getitem__(self, lang: str) -> tuple[dict[str, int], list[str], np.ndarray, int]:
        if lang not in self.found:
            row = self.table.to_table(filter=pads.field("lang") == lang).to_pylist()[0]
            names, n = [s["source"] for s in row["sources"]], row["n_terms"]
            self.found[lang] = ({s: k for k, s in enumerate(names)}, names, np.array([s["total"] for s in row["sources"]], np.int64) + n, n)
        return self.found[lang]


OUT = "kind string, lang string, source string, other string, level long, value long"
ARROW = pa.schema([("kind", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("level", pa.int64()), ("value", pa.int64())])


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 50_000]), ARROW.types)], schema=ARROW)


def parts_of(merged: DataFrame, totals_path: str, top: int) -> DataFrame:
    """What each task's stripes give, as rows of a kind:

    ``term``: source, term, f against the language, the best ``top`` of the task;
    ``both``: source, other source, what terms of both add to the sum beyond what either gives alone;
    ``level``: source, a count, how many terms have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, best, least = Groups(totals_path), defaultdict(list), defaultdict(int)
        both, levels = defaultdict(int), Counter()
        for batch in batches:
            langs, texts, lists = batch.column("lang").dictionary_encode(), batch.column("term"), batch.column("entries")
            flat, row = lists.flatten(), np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
            sources, counts = flat.field("source").dictionary_encode(), flat.field("count").to_numpy(zero_copy_only=False)
            of = np.where(pc.not_equal(texts, "").to_numpy(zero_copy_only=False), langs.indices.to_numpy(zero_copy_only=False), -1)[row]
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                mine = of == k
                if not mine.any():
                    continue
                index, names, sizes, n_terms = groups[lang]
                source = np.array([index.get(s, -1) for s in sources.dictionary.to_pylist()])[sources.indices.to_numpy(zero_copy_only=False)[mine]]
                rows, term = np.unique(row[mine], return_inverse=True)
                count = counts[mine]
                p = share(count, sizes[source])
                # Terms against the language: the sum of N over sources plus V once.
                all_counts = np.zeros(len(rows), np.int64)
                np.add.at(all_counts, term, count)
                q = share(all_counts, np.int64(int((sizes - n_terms).sum()) + n_terms))[term]
                f = diverge(p, q)
                worth = (p > q) & (f >= np.array([least[lang, s] for s in range(len(names))])[source])
                for e in np.flatnonzero(worth):
                    best[lang, int(source[e])].append((-int(f[e]), texts[int(rows[term[e]])].as_py()))
                for key in {(lang, int(s)) for s in np.unique(source[worth])}:
                    if len(best[key]) > 4 * top:
                        best[key] = sorted(best[key])[:top]
                        least[key] = -best[key][-1][0]
                # How many terms have which count.
                pairs, n = np.unique(np.stack([source, count]), axis=1, return_counts=True)
                for s, c, k in zip(*pairs.tolist(), n.tolist()):
                    levels[lang, s, c] += k
                # Terms of two sources, terms with equally many sources at a time.
                none = share(np.zeros(len(sizes), np.int64), sizes)
                width = np.bincount(term)
                starts = np.cumsum(width) - width
                for w in np.unique(width[width > 1]).tolist():
                    step = max(1, 2_000_000 // (w * w))
                    all_of = starts[width == w]
                    for at in range(0, len(all_of), step):
                        cell = all_of[at : at + step, None] + np.arange(w)
                        s, x = source[cell], p[cell]
                        a, b = s[:, :, None], s[:, None, :]
                        x, y = x[:, :, None], x[:, None, :]
                        more = diverge(x, y) - diverge(x, none[b]) - diverge(none[a], y) + diverge(none[a], none[b])
                        key, back = np.unique(a * len(names) + b, return_inverse=True)
                        added = np.zeros(len(key), np.int64)
                        np.add.at(added, back.reshape(-1), more.reshape(-1))
                        for k, v in zip(key.tolist(), added.tolist()):
                            if k // len(names) != k % len(names):
                                both[lang, k // len(names), k % len(names)] += v
            if len(both) + len(levels) > HELD:
                yield from _rows([("both", g, groups[g][1][a], groups[g][1][b], 0, v) for (g, a, b), v in both.items()])
                yield from _rows([("level", g, groups[g][1][s], "", c, n) for (g, s, c), n in levels.items()])
                both, levels = defaultdict(int), Counter()
        yield from _rows([("both", g, groups[g][1][a], groups[g][1][b], 0, v) for (g, a, b), v in both.items()])
        yield from _rows([("level", g, groups[g][1][s], "", c, n) for (g, s, c), n in levels.items()])
        yield from _rows([("term", g, groups[g][1][s], t, 0, -v) for (g, s), found in best.items() for v, t in sorted(found)[:top]])

    return merged.mapInArrow(run, OUT)


def alone(levels: DataFrame, totals_path: str) -> DataFrame:
    """The sums over all pairs of what each source gives alone: lang, source, other, value.

    ``levels``: lang, source, level (a count, 0 too), value (terms that have it), each once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Groups(totals_path)
        for batch in batches:
            held = defaultdict(list)
            for row in batch.to_pylist():
                held[row["lang"], row["source"]].append((row["level"], row["value"]))
            for (lang, source), rows in held.items():
                index, names, sizes, n_terms = groups[lang]
                k, others = index[source], np.arange(len(names)) != index[source]
                ahead, behind = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
                if n_terms:
                    none, counts = share(np.zeros(len(names), np.int64), sizes), np.array(rows, np.int64)
                    for p, n, level in zip(share(counts[:, 0], sizes[k]), counts[:, 1], counts[:, 0]):
                        ahead += n * diverge(p, none)
                        if level:
                            behind += n * (diverge(none, p) - diverge(none, none[k]))
                out = [("both", lang, source, names[j], 0, int(ahead[j])) for j in np.flatnonzero(others)]
                out += [("both", lang, names[j], source, 0, int(behind[j])) for j in np.flatnonzero(others) if behind[j]]
                yield from _rows(out)

    dealt = levels.repartition("lang", "source").sortWithinPartitions("lang", "source")
    return dealt.mapInArrow(run, OUT).select("lang", "source", "other", "value")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = TOP) -> DataFrame:
    """Divergences of each (lang, source) group: lang, source, part, item, value, rank.

    Part ``pair``: each other source of the language, all ranks. Part ``term``: terms that
    the group has more of than its language, the first ``top``. Ranks run from 1 by falling
    value, then by the item's bytes. Null text, lang and source count as ''. Groups without
    terms have pairs too; a language of one source has none; without kept terms values are
    0. Repeated rows are documents of their own; an empty table gives no row; other columns
    don't matter.
    """
    merged = common.stored(stripes(docs, text_col, lang_col, source_col, min_docs), "divergence-stripes")
    path = common.shared_dir(docs.sparkSession, "divergence-totals")
    found = totals(merged)
    found.write.parquet(path)
    found = docs.sparkSession.read.schema(found.schema).parquet(path)
    parts = common.stored(parts_of(merged, path, top), "divergence-parts")
    zero = found.select("lang", "n_terms", F.inline("sources")).select("lang", "source", F.lit(0).cast("long").alias("level"), (F.col("n_terms") - F.col("present")).alias("value"))
    met = parts.filter("kind = 'level'").groupBy("lang", "source", "level").agg(F.sum("value").alias("value"))
    pairs = alone(met.unionByName(zero), path).unionByName(parts.filter("kind = 'both'").select("lang", "source", "other", "value"))
    pairs = pairs.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    terms = parts.filter("kind = 'term'").select("lang", "source", "other", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))

    def ranked(df: DataFrame, part: str) -> DataFrame:
        return df.select("lang", "source", F.lit(part).alias("part"), F.col("other").alias("item"), "value").withColumn("rank", F.row_number().over(order))

    return ranked(pairs, "pair").unionByName(ranked(terms, "term").filter(F.col("rank") <= top))


#: Counts by term, dense over each language's groups and kept terms.
SQL = rf"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (n.n + v.v) AS p
 FROM n JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 1)) // (any_value(total) + any_value(v.v)) AS q FROM p JOIN (SELECT lang, sum(n) AS total FROM n GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pairs AS (SELECT x.lang, x.source, y.source AS item, coalesce(s.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
 LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
 ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
terms AS (SELECT p.lang, p.source, p.term AS item, ((p.p - q.q) * (p.p - q.q)) // q.q AS value FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
 UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {TOP}"""
