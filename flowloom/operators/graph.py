"""Closures, paths and components over edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.lineage import cut
from flowloom.functions.ranks import numbered


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All nodes that can be reached from ``seeds`` (node), themselves included: node, depth.

    Breadth first: each round joins only the newest nodes to the edges and drops those
    seen before, so cycles end and a node is expanded once. Works on ids that occur in
    edges only, too.
    """
    edges = cut(edges.select("src", F.col("dst").alias("node")).distinct())
    seen = newest = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    while True:
        step = newest.select(F.col("node").alias("src"), "depth").join(edges, "src").groupBy("node").agg((F.first("depth") + 1).alias("depth"))
        newest = cut(step.join(seen.select("node"), "node", "left_anti"))
        if newest.isEmpty():
            return seen
        seen = seen.unionByName(newest)


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of a root (node) and what can be reached from it, itself included: root, node. Each pair is expanded once."""
    edges = cut(edges.select("src", F.col("dst").alias("node")).distinct())
    seen = newest = cut(roots.select(F.col("node").alias("root"), "node").distinct())
    while True:
        step = newest.withColumnRenamed("node", "src").join(edges, "src").select("root", "node").distinct()
        newest = cut(step.join(seen, ["root", "node"], "left_anti"))
        if newest.isEmpty():
            return seen
        seen = seen.unionByName(newest)


def reversed_(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def both_ways(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Ancestors, descendants and the seeds themselves: node."""
    return closure(edges, seeds).select("node").union(closure(reversed_(edges), seeds).select("node")).distinct()


def between(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """The edges on some way from a source to a target."""
    ahead = closure(edges, sources).select(F.col("node").alias("src"))
    behind = closure(reversed_(edges), targets).select(F.col("node").alias("dst"))
    return edges.join(ahead, "src", "left_semi").join(behind, "dst", "left_semi")


def paths(edges: DataFrame, roots: DataFrame, carry: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """Every path from ``roots`` (node) in depth-first order, an edge that closes a cycle being a leaf.

    ``edges``: src, dst, ord and whatever ``carry`` reads. Gives root, node, depth, path, sort_key
    (arrays compare as depth-first order does; nodes that are texts within one root), is_cycle, and for each name in ``carry`` a
    value: its first expression on roots, its second one (over the edge and the value
    before) on each step.
    """
    carry = carry or {}
    names = list(carry)
    edges = cut(edges)
    first_key = F.lit(0).cast("long") if dict(roots.dtypes)["node"] == "string" else F.col("node").cast("long")
    start = roots.select(
        F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.array("node").alias("path"), F.array(first_key).alias("sort_key"), F.lit(False).alias("is_cycle"), *[first.alias(n) for n, (first, _) in carry.items()]
    )
    found = level = cut(start)
    while True:
        step = level.where("not is_cycle").withColumnRenamed("node", "src").join(edges, "src")
        level = cut(
            step.select(
                "root",
                F.col("dst").alias("node"),
                (F.col("depth") + 1).alias("depth"),
                F.concat("path", F.array("dst")).alias("path"),
                F.concat("sort_key", F.array(F.col("ord").cast("long"))).alias("sort_key"),
                F.array_contains("path", F.col("dst")).alias("is_cycle"),
                *[then.alias(n) for n, (_, then) in carry.items()],
            )
        )
        if level.isEmpty():
            return found.select("root", "node", "depth", "path", "sort_key", "is_cycle", *names)
        found = found.unionByName(level)


def preorder(found: DataFrame) -> DataFrame:
    """``paths`` with ``pos``, each row's place in its root's depth-first order, from 1.

    Rows are ordered over all roots by ranges, so a root of very many rows is numbered in parts.
    """
    placed = numbered(found, ["root", "sort_key"], "_place")
    first = placed.groupBy(F.col("root").alias("_root")).agg(F.min("_place").alias("_first"))
    return placed.join(first, F.col("root") == F.col("_root")).withColumn("pos", (F.col("_place") - F.col("_first") + 1).cast("int")).drop("_place", "_root", "_first")


def folded(found: DataFrame, inner: Column) -> DataFrame:
    """Trees as texts, from the leaves up: root, text. ``found``: ``paths`` rows; ``inner``: a row's text, with its children's, joined by commas, in column ``children``."""
    depth = found.agg(F.max("depth").alias("d")).first()["d"]
    below = None
    for d in range(-1 if depth is None else depth, -1, -1):
        level = found.where(F.col("depth") == d)
        if below is None:
            level = level.withColumn("children", F.lit(""))
        else:
            level = level.join(below, (F.col("root") == F.col("_root")) & (F.col("sort_key") == F.col("_above")), "left").withColumn("children", F.coalesce("_texts", F.lit(""))).drop("_root", "_above", "_texts")
        texts = level.select("root", "sort_key", inner.alias("text"))
        above = F.slice("sort_key", 1, F.greatest(F.size("sort_key") - 1, F.lit(0)))
        if d:
            gathered = F.array_sort(F.collect_list(F.struct("sort_key", "text")))
            below = cut(texts.groupBy(F.col("root").alias("_root"), above.alias("_above")).agg(F.array_join(F.transform(gathered, lambda c: c["text"]), ",").alias("_texts")))
        else:
            return texts.select("root", "text")
    return found.select("root", F.lit("").alias("text")).limit(0)


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): node, root (the smallest node).

    Each round, neighbours pass on the smallest root they know, and roots pass on theirs
    (pointer jumping), so a chain shrinks by more than half.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        passed = state.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("before"))
        jump = passed.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = cut(passed.join(jump, "root").select("node", F.least("root", "up").alias("root"), "before"))
        state = after.select("node", "root")
        if after.where("root <> before").isEmpty():
            return state


def knots(edges: DataFrame) -> DataFrame:
    """Nodes on cycles of more than one node: node, knot (the smallest of those that it reaches and that reach it).

    Every such cycle has an edge to a smaller node; where there is none, nothing is left
    to do. Else nodes that nothing leads to or that lead nowhere are peeled off, and pairs are
    made only of what stays: the cycles and what lies between them.
    """
    edges = edges.select("src", "dst").where("src <> dst")
    if edges.where("dst < src").isEmpty():  # looked for in one pass, before anything is shuffled
        return edges.sparkSession.createDataFrame([], edges.select(F.col("src").alias("node"), F.col("dst").alias("knot")).schema)
    edges = cut(edges.distinct())
    before, left = -1, edges.count()
    while left != before:
        sources, ends = edges.select(F.col("src").alias("dst")), edges.select(F.col("dst").alias("src"))
        edges = cut(edges.join(sources, "dst", "left_semi").join(ends, "src", "left_semi").select("src", "dst"))
        before, left = left, edges.count()
    ahead = reached(edges, edges.select(F.col("src").alias("node"))).where("root <> node")
    back = ahead.select(F.col("node").alias("root"), F.col("root").alias("node"))
    return cut(ahead.join(back, ["root", "node"]).groupBy(F.col("root").alias("node")).agg(F.least(F.min("node"), F.col("root")).alias("knot")))


def with_knots(calls: DataFrame, src: str, dst: str) -> DataFrame:
    """``calls`` between different ends, with ``within``: if both ends are of one knot. Only there can a way come back to where it was."""
    found = knots(calls.select(F.col(src).alias("src"), F.col(dst).alias("dst")))
    ends = [found.select(F.col("node").alias(end), F.col("knot").alias(name)) for end, name in ((src, "src_knot"), (dst, "dst_knot"))]
    both = calls.where(F.col(src) != F.col(dst)).join(ends[0], src, "left").join(ends[1], dst, "left")
    return both.withColumn("within", F.coalesce(F.col("src_knot") == F.col("dst_knot"), F.lit(False))).drop("src_knot", "dst_knot")


def handed_down(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The labels of all nodes that lead to a node, its own too: node, labels (an array, sorted). ``seeds``: node, label.

    Each round hands on only the labels that are new to a node, as one array, so cycles
    end and a label crosses an edge once.
    """
    edges = cut(edges.select("src", F.col("dst").alias("node")).distinct())
    state = fresh = cut(seeds.groupBy("node").agg(F.array_sort(F.collect_set("label")).alias("labels")))
    while True:
        step = fresh.select(F.col("node").alias("src"), "labels").join(edges, "src")
        got = step.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("labels"))).alias("got"))
        known = F.coalesce("labels", F.array().cast(state.schema["labels"].dataType))
        both = cut(state.join(got, "node", "full").withColumn("fresh", F.array_except(F.coalesce("got", F.array().cast(state.schema["labels"].dataType)), known)).select("node", known.alias("labels"), "fresh"))
        state = both.select("node", F.array_sort(F.concat("labels", "fresh")).alias("labels"))
        fresh = both.where("size(fresh) > 0").select("node", F.col("fresh").alias("labels"))
        if fresh.isEmpty():
            return state


def guard(job: Column, step: Column) -> Column:
    """The condition of an edge: both guards, or the one there is."""
    return F.when(job.isNotNull() & step.isNotNull(), F.concat(F.lit("("), job, F.lit(") && ("), step, F.lit(")"))).otherwise(F.coalesce(job, step))
