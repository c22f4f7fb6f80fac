"""Incremental refresh: only what changed is parsed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stale_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files of ``now`` that are new or whose mtime differs from the cached one."""
    same = now.join(before, ["file", "mtime"], "left_semi").select("file")
    return now.select("file").join(same, "file", "left_anti")


def has_deleted(before: DataFrame, now: DataFrame) -> bool:
    """If some cached file is gone: the cached files are no subset of those of ``now``."""
    return not before.select("file").join(now.select("file"), "file", "left_anti").isEmpty()


def merge(cached: DataFrame, before: DataFrame, now: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cached rows of unchanged files and freshly parsed rows of stale ones, with their origin; rows of deleted files go."""
    stale = stale_files(before, now)
    kept = cached.join(now.select("file"), "file", "left_semi").join(stale, "file", "left_anti")
    return kept.withColumn("origin", F.lit("cached")).unionByName(parse(stale).withColumn("origin", F.lit("parsed")))


def watch(files: DataFrame, parse: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """A streaming file source kept parsed: each micro-batch's files are parsed and appended to ``target``."""

    def store(batch: DataFrame, number: int) -> None:
        parse(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(target)

    return files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
