"""Secret propagation along call chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.lineage import cut
from flowloom.operators import graph


def handed(want: Column, exact: Column, mode: Column, given: Column) -> Column:
    """What a call does for a secret that its callee wants: a struct of fate (on, dropped, given), want and exact.

    ``inherit`` keeps the name; a map must have it (as declared at the callee, in any case
    for a followed source) and hands on the name that it names, or gives it if its value
    is no single secret.
    """
    value = F.try_element_at(F.filter(F.map_entries(given), lambda e: F.when(exact, e["key"] == want).otherwise(F.lower(e["key"]) == F.lower(want))), F.lit(1))["value"]
    source = F.nullif(F.regexp_extract(value, r"^\s*\$\{\{\s*secrets\.([A-Za-z0-9_]+)\s*\}\}\s*$", 1), F.lit(""))
    state = lambda fate, name, as_is: F.struct(F.lit(fate).alias("fate"), name.alias("want"), as_is.alias("exact"))
    return (
        F.when(mode == "inherit", state("on", want, exact))
        .when((mode != "explicit") | value.isNull(), state("dropped", F.lit(None).cast("string"), F.lit(None).cast("boolean")))
        .when(source.isNull() | (F.upper(source) == "GITHUB_TOKEN"), state("given", want, exact))
        .otherwise(state("on", source, F.lit(False)))
    )


def lost(calls: DataFrame, entries: DataFrame, required: DataFrame) -> DataFrame:
    """Required secrets that some chain from an entry drops: entry, callee, secret, depth, dropped_at, kind.

    ``calls``: src, dst, ord, mode, map; ``required``: node, secret. Followed from the callees back to
    the entries: a level keeps each state once (the callee's secret, the caller, the name now
    wanted or where it was dropped and, on cycles, the nodes of the cycle passed), so chains
    that meet don't multiply. A chain passes a node once.
    """
    node = calls.schema["src"].dataType
    calls = cut(graph.with_knots(calls.select("src", "dst", "mode", "map"), "src", "dst"))
    level = required.select("node", F.col("node").alias("callee"), "secret", F.col("secret").alias("want"), F.lit(True).alias("exact"), F.lit(None).cast(node).alias("dropped_at"), F.array("node").alias("around"))
    found, depth = None, 0
    while True:
        depth += 1
        step = level.withColumnRenamed("node", "dst").join(calls, "dst").where(~(F.col("within") & F.array_contains("around", F.col("src"))))
        dropped = F.col("dropped_at").isNotNull()
        step = step.withColumn("now", F.when(~dropped, handed(F.col("want"), F.col("exact"), F.col("mode"), F.col("map")))).where(dropped | (F.col("now.fate") != "given"))
        around = F.when(F.col("within"), F.array_sort(F.concat("around", F.array("src")))).otherwise(F.array("src"))
        step = step.select(F.col("src").alias("node"), "callee", "secret", "now.want", "now.exact", F.when(F.col("now.fate") == "dropped", F.col("src")).otherwise(F.col("dropped_at")).alias("dropped_at"), around.alias("around"))
        level = cut(step.distinct())
        ended = level.where("dropped_at is not null").select(F.col("node").alias("entry"), "callee", "secret", F.lit(depth).alias("depth"), "dropped_at")
        found = ended if found is None else found.unionByName(ended)
        if level.isEmpty():
            break
    kind = F.when(F.col("depth") == 1, "MissingSecretPropagation").otherwise("SecretsInheritChainBreak")
    return found.join(entries.select(F.col("node").alias("entry")).distinct(), "entry", "left_semi").distinct().withColumn("kind", kind)


def shadowed_environments(jobs: DataFrame, reached: DataFrame) -> DataFrame:
    """Jobs with an environment in callees that some entry reaches."""
    return jobs.where("environment is not null").join(reached.where("depth > 0").select("node"), "node", "left_semi")
