"""Stored estates: the tables of one, and parsed files that are kept up to date.

Both only ever add: data goes to a new folder, and then one row, which is one file and so
appears at once or not at all, tells that it is there. Whoever reads an older state goes
on reading it.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.lineage import cut
from flowloom.sources import estate as reader
from flowloom.sources.estate import Estate

VERSION = 3
TABLES = ("workflows", "triggers", "jobs", "actions", "steps", "annotations", "edges", "diagnostics")
META = "number int, version int, folder string, root string, revision string"
DOCS = "path string, kind string, content string, doc string, problem string"
FILES = "path string, kind string, mtime timestamp, batch string"


def save(estate: Estate, path: str) -> None:
    """Write all tables into a new folder under ``path`` and make it the current one."""
    folder = uuid.uuid4().hex
    for name in TABLES:
        table: DataFrame = getattr(estate, name)
        table.write.parquet(f"{path}/{folder}/{name}")
    _mark(estate.workflows.sparkSession, path, VERSION, folder)


def load(spark: SparkSession, path: str) -> Estate | None:
    """The stored estate; None if there is none, or the last one is broken or of another version."""
    last = _last(spark, path)
    try:
        return Estate(*[spark.read.parquet(f"{path}/{last['folder']}/{name}") for name in TABLES]) if last is not None else None
    except (PySparkException, Py4JJavaError):
        return None


def _mark(spark: SparkSession, path: str, version: int, folder: str = "", root: str = "", revision: str | None = None) -> None:
    last = _last(spark, path, any_version=True)
    row = (0 if last is None else last["number"] + 1, version, folder, root, revision)
    spark.createDataFrame([row], META).coalesce(1).write.mode("append").json(f"{path}/meta")


def _last(spark: SparkSession, path: str, any_version: bool = False):
    """What the last finished write says; None if there is none or it has another version."""
    try:
        rows = spark.read.schema(META).json(f"{path}/meta").orderBy(F.desc("number"), F.desc("folder")).limit(1).collect()
    except (PySparkException, Py4JJavaError):
        return None
    return rows[0] if rows and (any_version or rows[0]["version"] == VERSION) else None


def status(spark: SparkSession, root: str, path: str, revision: str | None = None, changed: DataFrame | None = None, exclude: tuple[str, ...] = ()) -> tuple[DataFrame, bool, DataFrame]:
    """(stale files, whether stored ones are gone, all files with what is stored of them).

    Stale are files that are new or have another time than when they were stored. With
    revisions on both sides that differ, also ``changed`` (path), the files that changed between
    them, all if it isn't given; with a revision on one side only, all. Another root or
    version of the store makes all stale.
    """
    now = reader.scan(spark, root, exclude).select("path", "kind", "mtime")
    last = _last(spark, path)
    if last is None or last["root"] != root:
        return now.select("path"), last is not None, now.withColumn("batch", F.lit(None).cast("string"))
    before = spark.read.schema(FILES).parquet(f"{path}/{last['folder']}/files").select("path", F.col("mtime").alias("stored"), "batch")
    both = now.join(before, "path", "left")
    whole = (last["revision"] is None) != (revision is None) or (revision != last["revision"] and changed is None)
    old = F.lit(True) if whole else F.col("batch").isNull() | (F.col("stored") != F.col("mtime"))
    files = both.select("path", "kind", "mtime", "batch", old.alias("old"))
    if not whole and revision != last["revision"]:
        files = files.join(changed.select("path").distinct().withColumn("said", F.lit(True)), "path", "left").withColumn("old", F.col("old") | F.col("said").isNotNull())
    files = cut(files.select("path", "kind", "mtime", F.when(~F.col("old"), F.col("batch")).alias("batch")))
    gone = not before.join(now.select("path"), "path", "left_anti").isEmpty()
    return files.where("batch is null").select("path"), gone, files


def refresh(spark: SparkSession, root: str, path: str, revision: str | None = None, changed: DataFrame | None = None, exclude: tuple[str, ...] = (), prefix: str = reader.PREFIX) -> Estate:
    """The estate under ``root``, of which only stale files (``status``) are parsed; they are stored under ``path`` as a batch.

    The parsed files of one state may lie in batches of many. Nothing is written if
    nothing changed.
    """
    stale, gone, files = status(spark, root, path, revision, changed, exclude)
    last = _last(spark, path)
    if last is None or gone or revision != last["revision"] or not stale.isEmpty():
        batch, folder = uuid.uuid4().hex, uuid.uuid4().hex
        fresh = reader.parsed(reader.scan(spark, root, exclude).join(stale, "path", "left_semi"))
        fresh.write.parquet(f"{path}/docs/batch={batch}")
        files.withColumn("batch", F.coalesce("batch", F.lit(batch))).write.parquet(f"{path}/{folder}/files")
        _mark(spark, path, VERSION, folder, root, revision)
    return reader.built(docs(spark, path), prefix)


def docs(spark: SparkSession, path: str) -> DataFrame:
    """The parsed files of the current state, as ``estate.built`` takes them."""
    last = _last(spark, path)
    files = spark.read.schema(FILES).parquet(f"{path}/{last['folder']}/files").select("path", "batch")
    every = spark.read.schema(f"{DOCS}, batch string").option("basePath", f"{path}/docs").parquet(f"{path}/docs")
    return every.join(files, ["path", "batch"], "left_semi").drop("batch")
