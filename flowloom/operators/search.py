"""Search over nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scored(nodes: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """Nodes (id, label, text; of the ``kind``, if one is given) in which every word of the query occurs, with a score.

    Each word gives 256 less the byte offset of its first place, at least 1; a label that
    equals the query gives 1000 more.
    """
    words = query.lower().split()
    if kind is not None:
        nodes = nodes.where(F.col("kind") == kind)
    low = nodes.select("id", "label", F.lower("text").alias("low"))
    if not words:
        return low.select("id", "label", F.lit(0).cast("long").alias("score")).limit(0)
    places = {w: F.instr(F.col("low"), w) for w in words}
    hit = [places[w] > 0 for w in words]
    points = [F.greatest(F.lit(1), 256 - F.octet_length(F.substring(F.col("low"), F.lit(1), places[w] - 1))) for w in words]
    whole = sum(points[1:], points[0]) + F.when(F.lower("label") == query.lower(), 1000).otherwise(0)
    every = hit[0]
    for h in hit[1:]:
        every = every & h
    return low.where(every).select("id", "label", whole.cast("long").alias("score"))


def top(found: DataFrame, limit: int = 200) -> DataFrame:
    """The best ``limit`` (at least one) by score, then id, with the number of all."""
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy(F.desc("score"), "id").limit(max(1, limit)).crossJoin(F.broadcast(total))
