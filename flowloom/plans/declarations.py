"""Queries over trigger declarations: seeds, activity and ref filters, summaries.

A row of ``events`` is a declaration: the user is the workflow, the event type its
trigger; ``error`` stands for the call-only trigger. Types and ref filters follow from the
event's value and its property k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import triggers
from flowloom.plans.registry import Registry, read

on = Registry()

DEFAULTS_SQL = "CASE WHEN event = 'signup' THEN array('t0', 't1') END"
PATTERNS = {0: ["main"], 1: ["release/**", "!release/old"], 2: ["**"]}


def decl(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return events.select(
        F.col("user_id").alias("wf_id"),
        F.col("event_id").alias("trig_ord"),
        F.col("event_type").alias("event"),
        F.expr("CASE WHEN value <= 100 THEN NULL WHEN k % 10 = 0 THEN array() ELSE array(concat('t', k % 4), concat('u', k % 3)) END").alias("types"),
        F.expr("CASE WHEN k % 5 < 2 THEN 'none' WHEN k % 5 < 4 THEN 'include' ELSE 'exclude' END").alias("ref_kind"),
        F.expr("k % 3").alias("pattern"),
        (F.col("event_type") != "error").alias("is_entry"),
    )


#: The same relation for the SQL counterparts.
WITH = """WITH raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
decl AS (
  SELECT user_id AS wf_id, event_id AS trig_ord, event_type AS event,
         CASE WHEN value <= 100 THEN NULL WHEN k % 10 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['t' || (k % 4), 'u' || (k % 3)] END AS types,
         CASE WHEN k % 5 < 2 THEN 'none' WHEN k % 5 < 4 THEN 'include' ELSE 'exclude' END AS ref_kind, k % 3 AS pattern,
         event_type <> 'error' AS is_entry, CASE WHEN event_type = 'signup' THEN ['t0', 't1'] END AS defaults
  FROM raw)
"""


@on.query(WITH + """SELECT event, count(DISTINCT CASE WHEN is_entry THEN wf_id END) AS entry_workflows, count(*) AS declarations,
 count(types) AS typed, count(CASE WHEN ref_kind <> 'none' THEN 1 END) AS filtered,
 list_sort(list_distinct(list(CAST(wf_id AS VARCHAR)) FILTER (WHERE is_entry)))[1:3] AS examples FROM decl GROUP BY event""")
def triggers_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.summary(decl(spark, sf_dir))


@on.query(WITH + "SELECT wf_id, trig_ord, event FROM decl WHERE event = 'purchase' AND is_entry")
def trace_seed_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decl(spark, sf_dir).where((F.col("event") == "purchase") & F.col("is_entry")).select("wf_id", "trig_ord", "event")


@on.query(WITH + """SELECT wf_id, trig_ord FROM decl WHERE is_entry AND
 CASE WHEN coalesce(types, defaults) IS NULL THEN true ELSE list_has_any(coalesce(types, defaults), ['t1', 't2']) END""")
def trace_seed_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decl(spark, sf_dir).where(F.col("is_entry") & triggers.accepts_activity(F.col("types"), F.expr(DEFAULTS_SQL), ["t1", "t2"])).select("wf_id", "trig_ord")


@on.query(WITH + """SELECT wf_id, trig_ord FROM decl WHERE is_entry AND event = 'click'
 AND CASE ref_kind WHEN 'include' THEN pattern IN (1, 2) WHEN 'exclude' THEN pattern NOT IN (1, 2) ELSE true END""")
def trace_seed_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = decl(spark, sf_dir).where("is_entry and event = 'click'")
    patterns = F.get(F.array(*[F.array(*map(F.lit, PATTERNS[k])) for k in sorted(PATTERNS)]), F.col("pattern").cast("int"))
    none = F.struct(F.lit("none").alias("kind"), patterns.alias("patterns"))
    filters = seeds.select("wf_id", "trig_ord", "event", F.struct(F.col("ref_kind").alias("kind"), patterns.alias("patterns")).alias("branches"), none.alias("tags"), none.alias("paths"))
    return filters.where(triggers.accepts_refs(["release/v1"], [], [])).select("wf_id", "trig_ord")


@on.query(WITH + """SELECT wf_id, trig_ord, event, CASE WHEN types IS NOT NULL THEN array_to_string(types, ', ')
 WHEN defaults IS NOT NULL THEN 'default: ' || array_to_string(defaults, ', ') ELSE 'all' END AS shown FROM decl WHERE is_entry""")
def trace_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decl(spark, sf_dir).where("is_entry").select("wf_id", "trig_ord", "event", triggers.shown_types(F.col("types"), F.expr(DEFAULTS_SQL)).alias("shown"))


@on.query(WITH + """SELECT wf_id, trig_ord, event FROM (SELECT *, row_number() OVER (PARTITION BY wf_id ORDER BY trig_ord) AS n
 FROM decl WHERE is_entry AND ref_kind = 'include') WHERE n = 1""")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.first_match(decl(spark, sf_dir), F.expr("is_entry and ref_kind = 'include'")).select("wf_id", "trig_ord", "event")


@on.query(WITH + "SELECT wf_id FROM decl GROUP BY wf_id HAVING bool_or(NOT is_entry) AND NOT bool_or(is_entry)")
def having_bool_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.only_called(decl(spark, sf_dir))


@on.query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type <> 'error')")
def semi_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = decl(spark, sf_dir).where("is_entry").select(F.col("wf_id").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name").join(entry, "c_custkey", "left_semi")


@on.query("SELECT DISTINCT user_id AS wf_id, event_type AS event FROM events WHERE event_type IN ('error', 'refund')")
def filter_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decl(spark, sf_dir).where(F.col("event").isin("error", "refund")).select("wf_id", "event").distinct()
