"""Ordered and prefix joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def longest_prefix(paths: DataFrame, prefixes: DataFrame, path: str = "path", prefix: str = "prefix") -> DataFrame:
    """Each distinct path with the longest prefix that equals it or is a parent folder of it, null if none.

    Every path is unfolded into its parent folders, so the join is by equality.
    """
    parts, p = F.split(F.col(path), "/"), F.col(path)
    sizes = F.sequence(F.lit(1), F.size(parts))
    parents = F.transform(sizes, lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    keyed = paths.select(p, F.explode(parents).alias("parent")).distinct()
    hit = keyed.join(prefixes.select(F.col(prefix).alias("hit")).distinct(), F.col("parent") == F.col("hit"), "left")
    return hit.groupBy(path).agg(F.max_by("hit", F.length("hit")).alias(prefix))


def asof_backward(rows: DataFrame, anchors: DataFrame, key: str, at: str, row_id: str, anchor_id: str, rank: Column, bucket: Column) -> DataFrame:
    """Each row with the nearest anchor of its key at or before it; at one place the highest ``rank`` wins.

    Time is cut into buckets (an expression over ``at``), so a key of very many rows is
    sorted in parts; what was last in the buckets before is carried over.
    """
    a = anchors.select(key, at, rank.alias("rank"), F.lit(0).alias("kind"), F.struct(F.col(anchor_id).alias("id"), F.col(at).alias("at")).alias("anchor"), F.col(anchor_id).cast("long").alias("tie"), F.lit(None).cast("long").alias("row"))
    r = rows.select(key, at, F.lit(0).alias("rank"), F.lit(1).alias("kind"), F.lit(None).cast(a.schema["anchor"].dataType).alias("anchor"), F.lit(None).cast("long").alias("tie"), F.col(row_id).cast("long").alias("row"))
    both = a.unionByName(r).withColumn("bucket", bucket)
    order = [at, "kind", "rank", "tie"]
    inside = Window.partitionBy(key, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = both.where("kind = 0").groupBy(key, "bucket").agg(F.max_by("anchor", F.struct(*order)).alias("end"))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    marks = both.select(key, "bucket").distinct().join(ends, [key, "bucket"], "left").withColumn("carried", F.last("end", ignorenulls=True).over(before))
    near = both.withColumn("near", F.last("anchor", ignorenulls=True).over(inside)).where("kind = 1")
    found = near.join(marks.select(key, "bucket", "carried"), [key, "bucket"], "left")
    best = F.coalesce("near", "carried")
    return found.select(F.col("row").alias(row_id), key, at, best["id"].alias(anchor_id), best["at"].alias("anchor_at"))


def _carried_over(both: DataFrame, rows: DataFrame, ends: DataFrame, key: str, order, take) -> DataFrame:
    """``rows`` with ``carried``: what ``take`` makes of the buckets' ``end`` that stand before theirs in ``order``. ``both``: all rows with key and bucket."""
    same = lambda df: F.col(key).eqNullSafe(df["_key"]) & F.col("bucket").eqNullSafe(df["_bucket"])
    there = ends.select(F.col(key).alias("_key"), F.col("bucket").alias("_bucket"), "end")
    marks = both.select(key, "bucket").distinct().join(there, same(there), "left").select(key, "bucket", "end")
    marks = marks.withColumn("carried", take("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).select(F.col(key).alias("_key"), F.col("bucket").alias("_bucket"), "carried")
    return rows.join(marks, same(marks), "left").drop("_key", "_bucket")


def asof_forward(rows: DataFrame, nodes: DataFrame, key: str, at: str, row_id: str, node_id: str, bucket: Column) -> DataFrame:
    """Each row with the nearest node of its key strictly after it.

    Places are cut into buckets (an expression over ``at``, not falling), so a key of very many rows
    is sorted in parts; the first node of the buckets behind is carried back.
    """
    n = nodes.select(key, at, F.lit(0).alias("kind"), F.struct(F.col(at).alias("at"), F.col(node_id).alias("id")).alias("node"), F.lit(None).cast("long").alias("row"))
    r = rows.select(key, at, F.lit(1).alias("kind"), F.lit(None).cast(n.schema["node"].dataType).alias("node"), F.col(row_id).cast("long").alias("row"))
    both = n.unionByName(r).withColumn("bucket", bucket)
    # In descending order, rows of a place come before its nodes, so only later nodes are seen.
    inside = Window.partitionBy(key, "bucket").orderBy(F.desc(at), F.desc("kind"), F.desc("node")).rowsBetween(Window.unboundedPreceding, 0)
    ends = n.withColumn("bucket", bucket).groupBy(key, "bucket").agg(F.min("node").alias("end"))
    near = both.withColumn("near", F.last("node", ignorenulls=True).over(inside)).where("kind = 1")
    found = _carried_over(both, near, ends, key, Window.partitionBy(key).orderBy(F.desc("bucket")), lambda c: F.last(c, ignorenulls=True))
    return found.select(F.col("row").alias(row_id), key, at, F.coalesce("near", "carried")["id"].alias(node_id))


def outside_ranges(points: DataFrame, ranges: DataFrame, key: str, at: str, low: str, high: str, size: int) -> DataFrame:
    """Points in none of the half-open ranges [low, high) of their key.

    Ranges and points are swept together: a point lies inside if the greatest end of the
    ranges that begin at or before it is beyond it. Places are cut into buckets of ``size``, so a
    key of very many rows is swept in parts; how far the ranges of the buckets before reach is carried over.
    """
    bucket = F.floor(F.col("_at") / size)
    r = ranges.select(key, F.col(low).alias("_at"), F.lit(0).alias("_kind"), F.col(high).alias("_end"))
    p = points.withColumn("_at", F.col(at)).withColumn("_kind", F.lit(1)).withColumn("_end", F.lit(None).cast(r.schema["_end"].dataType))
    both = p.unionByName(r, allowMissingColumns=True).withColumn("bucket", bucket)
    inside = Window.partitionBy(key, "bucket").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    ends = r.withColumn("bucket", bucket).groupBy(key, "bucket").agg(F.max("_end").alias("end"))
    swept = both.withColumn("_reach", F.max("_end").over(inside)).where("_kind = 1")
    found = _carried_over(both, swept, ends, key, Window.partitionBy(key).orderBy("bucket"), F.max)
    return found.where(F.coalesce(F.greatest("_reach", "carried") <= F.col("_at"), F.lit(True))).select(*points.columns)
