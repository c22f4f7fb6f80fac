"""Repeated step sequences: windows, their buckets, the maximal ones and their rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.lineage import cut

AHEAD = 8  # steps of the runs that are counted at once
CHUNK = 4_096  # steps of a container that are looked over together
SENT_BYTES = 16 << 20  # of rows that are sent to all tasks


def first_meaningful_line(text: Column, least: int = 1) -> Column:
    """The first trimmed line of ``least`` characters that is no shebang and no preamble (``set -e``, ``set -eu``, ``set -euo pipefail``)."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.try_element_at(F.filter(lines, lambda s: (F.length(s) >= least) & ~s.startswith("#!") & ~s.rlike(r"^set\s+-[eu]+(?:o\s+pipefail)?$")), F.lit(1))


def few(rows: DataFrame) -> DataFrame:
    """A stored side of a join, sent to all tasks if it is small, whatever the planner takes it for."""
    size = rows.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(rows) if size <= SENT_BYTES else rows


def looking_ahead(steps: DataFrame, names: DataFrame, ahead: int) -> DataFrame:
    """Each step with a name, with the names behind it: container, start, k0 (its own) to k<ahead - 1>, left (the name before), run.

    0 is no name; run: how many of k0, k1, ... have one. Long containers are dealt in
    chunks; steps near an edge are in both.
    """
    named = steps.select("container", F.col("ord").cast("int").alias("start"), "sig").join(names, "sig", "left").select("container", "start", F.coalesce("name", F.lit(0)).alias("k0"))
    chunk = F.explode(F.expr(f"sequence((start - {ahead - 1}) div {CHUNK}, (start + 1) div {CHUNK})")).alias("chunk")
    here = Window.partitionBy("container", "chunk").orderBy("start")
    behind = [F.coalesce(F.lead("k0", j).over(here), F.lit(0)).alias(f"k{j}") for j in range(1, ahead)]
    seen = named.select("*", chunk).select("*", F.coalesce(F.lag("k0").over(here), F.lit(0)).alias("left"), *behind).where(f"start div {CHUNK} = chunk and k0 <> 0").drop("chunk")
    return seen.withColumn("run", F.coalesce(*[F.when(F.col(f"k{j}") == 0, j) for j in range(1, ahead)], F.lit(ahead)))


def runs(steps: DataFrame, names: DataFrame, least: int, ahead: int) -> DataFrame:
    """All runs of ``least`` to ``ahead`` named steps: container, start, length, their names (then 0), left and right (the names beside it; 0 at full length)."""
    each = looking_ahead(steps, names, ahead).where(F.col("run") >= least).select("*", F.explode(F.expr(f"sequence({least}, run)")).alias("length"))
    length = F.col("length")
    own = [F.when(length > j, F.col(f"k{j}")).otherwise(0).alias(f"k{j}") for j in range(ahead)]
    right = F.coalesce(*[F.when(length == j, F.col(f"k{j}")) for j in range(1, ahead)], F.lit(0)).alias("right")
    return each.select("container", "start", "length", *own, F.when(length < ahead, F.col("left")).otherwise(0).alias("left"), right)


def grown(steps: DataFrame, min_length: int, min_occurrences: int, ahead: int = AHEAD) -> tuple[DataFrame, DataFrame]:
    """Sequences of steps that occur often: (sequences, sites).

    ``steps``: container, ord (without gaps), sig (null: nothing goes across). Steps that occur
    often get names. Runs of up to ``ahead`` names are counted at once, together with the
    names beside them: a sequence is kept if it stands somewhere between two names (or ends)
    of which neither makes it a longer frequent one. Only if some runs of ``ahead``
    steps are frequent, longer ones grow from their places level by level, as both parts of n
    steps of a frequent sequence of n + 1 are frequent. No arrays and no n^2 windows arise.

    sequences: id (the first place, a struct of container and start), length, occurrences,
    kept (it has an occurrence that lies in no longer frequent sequence); sites: id, length, container, start.
    Fewer than two occurrences or no steps asked for give nothing.
    """
    if min_length < 1 or min_occurrences < 2:
        steps, min_length = steps.limit(0), 1
    keys, least = [f"k{j}" for j in range(ahead)], min(min_length, ahead)
    often = steps.where("sig is not null").groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_occurrences)
    names = few(cut(often.select("sig", (F.monotonically_increasing_id() + 1).alias("name"))))
    beside = cut(runs(steps, names, least, ahead).groupBy("length", *keys, "left", "right").agg(F.count(F.lit(1)).alias("n"), F.min("container").alias("container")))
    frequent = cut(beside.groupBy("length", *keys).agg(F.sum("n").alias("occurrences"), F.min("container").alias("container")).where(F.col("occurrences") >= min_occurrences))
    # First places: only the first containers are read again.
    near = steps.join(few(frequent.select("container").distinct()), "container", "left_semi")
    first = runs(near, names, least, ahead).join(few(frequent.select("length", *keys, "container")), ["length", *keys, "container"]).groupBy("length", *keys).agg(F.min("start").alias("start"))
    named = frequent.join(first, ["length", *keys]).withColumn("id", F.struct("container", "start")).drop("container", "start")

    def covered(rows: DataFrame, grown_keys: list[Column], flag: str) -> DataFrame:
        longer = frequent.select((F.col("length") - 1).alias("length"), *[F.col(f"k{j}").alias(f"e{j}") for j in range(ahead)], F.lit(True).alias(flag))
        return rows.select("*", *[key.alias(f"e{j}") for j, key in enumerate(grown_keys)]).join(longer, ["length", *[f"e{j}" for j in range(ahead)]], "left").drop(*[f"e{j}" for j in range(ahead)])

    asked = F.col("length").between(min_length, ahead - 1)
    flagged = covered(beside.where(asked), [F.when(F.col("length") == j, F.col("right")).otherwise(F.col(f"k{j}")) for j in range(ahead)], "on")
    flagged = covered(flagged, [F.col("left"), *[F.col(f"k{j}") for j in range(ahead - 1)]], "back")
    kept = flagged.groupBy("length", *keys).agg(F.bool_or(F.col("on").isNull() & F.col("back").isNull()).alias("kept"))
    named = cut(named.where(asked).join(kept, ["length", *keys]))
    sequences = named.select("id", F.col("length").cast("int").alias("length"), "occurrences", "kept")
    sites = runs(steps, names, least, ahead).join(few(named.select("length", *keys, "id")), ["length", *keys]).select("id", F.col("length").cast("int").alias("length"), "container", "start")
    full = frequent.where(F.col("length") == ahead)
    if full.isEmpty():
        return sequences, sites
    more, at = longer_ones(runs(steps, names, ahead, ahead).join(few(full.select(*keys, "occurrences")), keys), keys, ahead, min_length, min_occurrences)
    return sequences.unionByName(more), sites.unionByName(at)


def longer_ones(full: DataFrame, keys: list[str], length: int, min_length: int, min_occurrences: int) -> tuple[DataFrame, DataFrame]:
    """Sequences of ``length`` steps and more, level by level, from the places of those of ``length`` (container, start, keys, occurrences).

    Each level joins the frequent places of the level before to the places behind them; a
    sequence is the pair of its parts' names, and its own name is its first place, one number
    in the order of containers and steps.
    """
    places = cut(full.select("container", "start", *keys, "occurrences").repartitionByRange("container", "start").sortWithinPartitions("container", "start").withColumn("place", F.monotonically_increasing_id()))
    behind = places.select("container", (F.col("start") - 1).alias("start"), F.col("place").alias("next"))
    ids = places.groupBy(*keys).agg(F.min("place").alias("id"))
    below = cut(places.join(behind, ["container", "start"], "left").join(ids, keys).select("place", "next", "id", "occurrences"))
    found = at = None
    while True:
        right = below.select(F.col("place").alias("next"), F.col("id").alias("right"))
        occ = below.select("place", "next", F.col("id").alias("left")).join(right, "next")
        named = occ.groupBy("left", "right").agg(F.count(F.lit(1)).alias("occurrences"), F.min("place").alias("id")).where(F.col("occurrences") >= min_occurrences)
        level = cut(occ.join(named, ["left", "right"]).select("place", "next", "id", "occurrences"))
        if length >= min_length:
            # Of the level before are kept: sequences with a place that is in none of this level's.
            cover = level.select("place").unionByName(level.select(F.col("next").alias("place"))).withColumn("covered", F.lit(True)).distinct()
            mine = below.join(cover, "place", "left").groupBy("id").agg(F.first("occurrences").alias("occurrences"), F.bool_or(F.col("covered").isNull()).alias("kept")).withColumn("length", F.lit(length))
            here = below.select("id", "place").withColumn("length", F.lit(length))
            found, at = (mine, here) if found is None else (found.unionByName(mine), at.unionByName(here))
            if level.isEmpty():
                break
        below, length = level, length + 1
    names = places.select(F.col("place").alias("id"), F.struct("container", "start").alias("name"))
    sequences = found.join(names, "id").select(F.col("name").alias("id"), "length", "occurrences", "kept")
    sites = at.join(names, "id").join(places.select("place", "container", "start"), "place").select(F.col("name").alias("id"), "length", "container", "start")
    return sequences, sites


def spelled(sequences: DataFrame, steps: DataFrame) -> DataFrame:
    """With ``sigs``, the steps of each sequence, read at its first place."""
    at = sequences.select("id", "length", F.col("id.container").alias("container"), F.explode(F.expr("sequence(id.start, id.start + length - 1)")).alias("ord"))
    near = steps.join(few(sequences.select(F.col("id.container").alias("container")).distinct()), "container", "left_semi")
    read = at.join(near.select("container", F.col("ord").cast("int").alias("ord"), "sig"), ["container", "ord"]).groupBy("id", "length").agg(F.array_sort(F.collect_list(F.struct("ord", "sig"))).alias("s"))
    return sequences.join(read.select("id", "length", F.col("s.sig").alias("sigs")), ["id", "length"])


def windows(steps: DataFrame, min_length: int) -> DataFrame:
    """All runs of at least ``min_length`` steps of a container that hold no step without signature.

    ``steps``: container, ord, sig. Gives container, start, length, sigs. A container's steps
    are gathered in one row, as its windows are sub-lists of it.
    """
    if min_length < 1:
        return steps.sparkSession.createDataFrame([], f"container {steps.schema['container'].dataType.simpleString()}, start int, length int, sigs array<string>")
    wall = F.sum(F.when(F.col("sig").isNull(), 1).otherwise(0)).over(Window.partitionBy("container").orderBy("ord"))
    runs = steps.withColumn("run", wall).where("sig is not null").groupBy("container", "run").agg(F.array_sort(F.collect_list(F.struct("ord", "sig"))).alias("steps"))
    runs = runs.where(F.size("steps") >= min_length).select("container", F.element_at("steps", 1)["ord"].alias("first"), F.col("steps.sig").alias("sigs"))
    starts = runs.select("*", F.explode(F.expr(f"sequence(0, size(sigs) - {min_length})")).alias("s"))
    each = starts.select("*", F.explode(F.expr(f"sequence({min_length}, size(sigs) - s)")).alias("length"))
    return each.select("container", (F.col("first") + F.col("s")).cast("int").alias("start"), "length", F.slice("sigs", F.col("s") + 1, F.col("length")).alias("sigs"))


def buckets(found: DataFrame, min_occurrences: int) -> DataFrame:
    """How often each sequence occurs, at least ``min_occurrences`` times, with its first place."""
    out = found.groupBy("sigs").agg(F.count(F.lit(1)).alias("occurrences"), F.min(F.struct("container", "start")).alias("first"))
    return out.where(F.col("occurrences") >= max(2, min_occurrences)).select("sigs", F.size("sigs").alias("length"), "occurrences", F.col("first.container").alias("container"), F.col("first.start").alias("start"))


def maximal(found: DataFrame, frequent: DataFrame) -> DataFrame:
    """The frequent sequences with an occurrence that lies in no longer frequent one.

    An occurrence lies in one exactly if it does after one more step to the left or right,
    as parts of frequent sequences are frequent; so two joins by equality decide.
    """
    often = found.join(frequent.select("sigs"), "sigs", "left_semi").select("container", "start", "length", "sigs")
    longer = often.select("container", (F.col("length") - 1).alias("length"), "start")
    right = longer.withColumn("covered", F.lit(True))
    left = longer.select("container", "length", (F.col("start") + 1).alias("start")).withColumn("covered", F.lit(True))
    cover = right.unionByName(left).distinct()
    free = often.join(cover, ["container", "start", "length"], "left_anti").select("sigs").distinct()
    return frequent.join(free, "sigs", "left_semi")


def ranked(best: DataFrame) -> DataFrame:
    """With the score of taking a sequence out: length times the occurrences that go."""
    return best.withColumn("score", F.col("length") * (F.col("occurrences") - 1)).orderBy(F.desc("score"), F.desc("length"), F.desc("occurrences"), "container", "start")
