"""Queries for wiring, repeated sequences, near-duplicates, findings, search and the browsable graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.functions import text
from flowloom.functions.ranks import numbered
from flowloom.operators import browse, dedup, extract, findings, graph, search
from flowloom.plans.graphs import FOUND, HEAP, found_at, heap, risky
from flowloom.plans.registry import Registry, read

on = Registry()

# Wiring. A line of a conversation stands for a line of a run step.
LINES = """lines AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN '  gh workflow run ' || split_part(l, ' ', 1) || ';' ELSE '# gh workflow run x' END AS line
 FROM (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS l FROM conversations))"""


@on.query(f"""WITH {LINES}, t AS (SELECT DISTINCT conv_id, turn, rtrim(split_part(trim(line), ' ', 4), ';,') AS target FROM lines WHERE starts_with(trim(line), 'gh workflow run ')),
noted AS (SELECT DISTINCT conv_id, split_part(text, ' ', 2) AS base FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, target FROM t WHERE target <> '' AND NOT regexp_matches(target, '^[$"'']') AND NOT EXISTS
 (SELECT 1 FROM noted n WHERE n.conv_id = t.conv_id AND n.base = target)""")
def wiring_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispatches in run lines that no annotation of their step names."""
    talk = read(spark, sf_dir, "conversations")
    raw = talk.select("conv_id", "turn", "role", F.explode(F.split("text", "\n")).alias("l"))
    line = F.when(F.col("role") == "user", F.concat(F.lit("  gh workflow run "), F.substring_index("l", " ", 1), F.lit(";"))).otherwise("# gh workflow run x")
    parts = F.split(F.trim(line), r"\s+")
    run = (parts[0] == "gh") & (F.get(parts, F.lit(1)) == "workflow") & (F.get(parts, F.lit(2)) == "run")
    found = raw.where(run).select("conv_id", "turn", F.regexp_replace(F.coalesce(F.get(parts, F.lit(3)), F.lit("")), "[;,]+$", "").alias("target")).distinct()
    noted = talk.where("role = 'assistant'").select("conv_id", F.expr("split_part(text, ' ', 2)").alias("target"))
    return found.where("target <> ''").where(~F.col("target").rlike("^[$\"']")).join(noted, ["conv_id", "target"], "left_anti").select("conv_id", "turn", "target")


@on.query("""WITH a AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('error', 'view'))
SELECT event_id, CASE WHEN k % 5 = 0 THEN 'empty' WHEN k % 5 = 1 THEN 'not relative' WHEN k % 5 = 2 THEN 'bad segment' ELSE 'not YAML' END AS reason FROM a WHERE k % 5 < 4""")
def wiring_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations whose target can't be one, with the first reason."""
    k = F.get_json_object("props", "$.k").cast("long") % 5
    target = F.when(k == 0, "").when(k == 1, "/a.yml").when(k == 2, ".github/workflows/../x.yml").when(k == 3, ".github/workflows/x.txt").otherwise(".github/workflows/x.yml")
    notes = read(spark, sf_dir, "events").where(F.col("event_type").isin("error", "view")).select("event_id", target.alias("t"))
    t = F.col("t")
    odd = F.exists(F.split(t, "/"), lambda s: s.isin("", ".", ".."))
    reason = F.when(t == "", "empty").when(t.startswith("/"), "not relative").when(odd, "bad segment").when(~t.rlike(r"\.ya?ml$"), "not YAML").when(text.classify_target(t) != "workflow", "not a workflow")
    return notes.select("event_id", reason.alias("reason")).where("reason is not null")


@on.query("""SELECT DISTINCT o_clerk AS upstream FROM (SELECT 'name ' || (o_custkey * 3) AS o_clerk FROM orders) WHERE o_clerk NOT IN
 (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'name ' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END FROM customer)""")
def wiring_workflow_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upstream names that no workflow goes by."""
    named = read(spark, sf_dir, "customer").select(F.coalesce(F.expr("CASE WHEN c_custkey % 2 = 0 THEN concat('name ', c_custkey) END"), F.col("c_custkey").cast("string")).alias("upstream"))
    wanted = read(spark, sf_dir, "orders").select(F.expr("concat('name ', o_custkey * 3)").alias("upstream")).distinct()
    return wanted.join(named, "upstream", "left_anti")


DANGLING = """dangling AS (SELECT CASE WHEN l_linenumber = 1 THEN 'call' WHEN l_linenumber < 5 THEN 'step' ELSE 'composite-step' END AS kind, l_orderkey, l_linenumber, l_partkey, l_suppkey
 FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5))"""


@on.query(f"WITH {DANGLING} SELECT * FROM dangling")
def wiring_local_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") == 1, "call").when(F.col("l_linenumber") < 5, "step").otherwise("composite-step")
    known = read(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    return read(spark, sf_dir, "lineitem").join(known, "l_partkey", "left_anti").select(kind.alias("kind"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@on.query(f"WITH {DANGLING} SELECT kind, count(*) AS n FROM dangling GROUP BY kind")
def wiring_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiring_local_uses(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# Repeated sequences: an order's line items in order; a large quantity is a step without signature.
SEQ = """seq AS (SELECT l_orderkey AS container, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS ord,
 CASE WHEN l_quantity <= 45 THEN l_returnflag || l_linestatus END AS sig FROM lineitem),
runs AS (SELECT *, sum(CASE WHEN sig IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY container ORDER BY ord) AS run FROM seq),
win AS (SELECT a.container, a.ord AS start, b.ord - a.ord + 1 AS length, (SELECT list(c.sig ORDER BY c.ord) FROM seq c WHERE c.container = a.container AND c.ord BETWEEN a.ord AND b.ord) AS sigs
 FROM runs a JOIN runs b ON a.container = b.container AND a.run = b.run AND b.ord > a.ord WHERE a.sig IS NOT NULL AND b.sig IS NOT NULL)"""
BUCKETS = f"{SEQ}, bk AS (SELECT sigs, CAST(len(sigs) AS INTEGER) AS length, count(*) AS occurrences, min(container * 1000 + start) AS first FROM win GROUP BY sigs HAVING count(*) >= 3)"
MAXIMAL = f"""{BUCKETS}, often AS (SELECT win.* FROM win JOIN bk USING (sigs)), best AS (SELECT * FROM bk WHERE sigs IN (SELECT o.sigs FROM often o WHERE NOT EXISTS
 (SELECT 1 FROM often x WHERE x.container = o.container AND x.length = o.length + 1 AND x.start IN (o.start, o.start - 1))))"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    sig = F.when(F.col("l_quantity") <= 45, F.concat("l_returnflag", "l_linestatus"))
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("container"), (F.row_number().over(order) - 1).alias("ord"), sig.alias("sig"))


def frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = steps(spark, sf_dir)
    return extract.spelled(extract.grown(found, 2, 3)[0], found).select("sigs", "length", "occurrences", F.col("id.container").alias("container"), F.col("id.start").alias("start"), "kept")


@on.query(f"WITH {SEQ} SELECT container, ord, sig FROM seq")
def extract_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir)


@on.query(f"WITH {SEQ} SELECT container, start, length, sigs FROM win")
def extract_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.windows(steps(spark, sf_dir), 2)


@on.query(f"WITH {BUCKETS} SELECT sigs, length, occurrences, first // 1000 AS container, CAST(first % 1000 AS INTEGER) AS start FROM bk")
def extract_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent(spark, sf_dir).drop("kept")


@on.query(f"WITH {MAXIMAL} SELECT sigs, length, occurrences FROM best")
def extract_maximal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent(spark, sf_dir).where("kept").select("sigs", "length", "occurrences")


@on.query(f"WITH {MAXIMAL} SELECT sigs, length, occurrences, first // 1000 AS container, CAST(first % 1000 AS INTEGER) AS start, length * (occurrences - 1) AS score FROM best")
def extract_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.ranked(frequent(spark, sf_dir).where("kept").drop("kept"))


# Near-duplicates: a document's language, source, distinct lines and distinct words.
FEAT = """f AS (SELECT doc_id AS doc, [lang] AS t, [source] AS j, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda l: l), lambda l: l <> '')) AS u,
 list_distinct(list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) AS r FROM documents)"""
SIM = """CAST(CAST(0.15 AS FLOAT) * CAST(CASE WHEN a.t = b.t THEN 1 ELSE 0 END AS FLOAT) + CAST(0.10 AS FLOAT) * CAST(CASE WHEN a.j = b.j THEN 1 ELSE 0 END AS FLOAT)
 + CAST(0.40 AS FLOAT) * CAST(CASE WHEN len(a.u) + len(b.u) = 0 THEN 1 ELSE len(list_intersect(a.u, b.u)) / (len(a.u) + len(b.u) - len(list_intersect(a.u, b.u))) END AS FLOAT)
 + CAST(0.35 AS FLOAT) * CAST(CASE WHEN len(a.r) + len(b.r) = 0 THEN 1 ELSE len(list_intersect(a.r, b.r)) / (len(a.r) + len(b.r) - len(list_intersect(a.r, b.r))) END AS FLOAT) AS FLOAT)"""
# No pair reaches 0.8 without sharing half its lines, so pairs are formed over shared lines (exact).
PAIRS = f"""{FEAT}, lines AS (SELECT doc, unnest(u) AS line FROM f), cand AS (SELECT DISTINCT x.doc AS a, y.doc AS b FROM lines x JOIN lines y ON x.line = y.line AND x.doc < y.doc
 UNION SELECT x.doc, y.doc FROM f x JOIN f y ON x.doc < y.doc AND len(x.u) = 0 AND len(y.u) = 0),
pairs AS (SELECT * FROM (SELECT a.doc AS a, b.doc AS b, {SIM} AS similarity FROM cand JOIN f a ON a.doc = cand.a JOIN f b ON b.doc = cand.b) WHERE similarity >= CAST(0.8 AS FLOAT))"""
CLUSTERS = f"""{PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a AS node, a AS other FROM e UNION SELECT node, b FROM reach JOIN e ON a = other),
members AS (SELECT node AS doc, min(other) AS representative FROM reach GROUP BY node)"""


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lambda tokens: F.filter(tokens, lambda x: x.isNotNull() & (x != ""))
    kinds = {"trigger": F.array("lang"), "job": F.array("source"), "use": F.split("text", "\n"), "run": F.split("text", r"[ \t\n\x0B\f\r]+")}
    return dedup.hashed_rows(read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "doc"), {kind: kept(tokens) for kind, tokens in kinds.items()})


@on.query(f"WITH {FEAT} SELECT doc, len(t) AS triggers, len(j) AS jobs, len(u) AS uses, len(r) AS runs FROM f")
def dedup_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets(spark, sf_dir).select("doc", *[F.size(k).cast("long").alias(f"{k}s") for k, _ in dedup.WEIGHTS])


@on.query(f"WITH {PAIRS} SELECT a, b, similarity FROM pairs")
def similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.similar_pairs(sets(spark, sf_dir))


@on.query(f"WITH RECURSIVE {CLUSTERS} SELECT representative, m.doc, {SIM} AS similarity FROM members m JOIN f a ON a.doc = representative JOIN f b ON b.doc = m.doc")
def dedup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.similar_clusters(sets(spark, sf_dir))


@on.query(f"""WITH RECURSIVE {CLUSTERS}, s AS (SELECT representative, count(*) AS size FROM members GROUP BY 1)
SELECT representative, count(*) FILTER (WHERE n = size) AS common, count(*) FILTER (WHERE n < size) AS divergent FROM
 (SELECT representative, line, count(*) AS n FROM members JOIN lines USING (doc) GROUP BY 1, 2) JOIN s USING (representative) GROUP BY 1""")
def dedup_common_divergent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.uses_by_cluster(*dedup.clustered(sets(spark, sf_dir)))
    return found.groupBy("representative").agg(F.count_if("common").alias("common"), F.count_if(~F.col("common")).alias("divergent"))


@on.query(f"WITH RECURSIVE {CLUSTERS} SELECT representative, count(DISTINCT t) > 1 AS differ FROM members JOIN f USING (doc) GROUP BY 1")
def dedup_triggers_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, known = dedup.clustered(sets(spark, sf_dir))
    return members.select("representative", "rep").distinct().join(known.select(F.col("doc").alias("rep"), "trigger"), "rep").groupBy("representative").agg((F.countDistinct("trigger") > 1).alias("differ"))


# Findings: an order is a finding; its customer is the node it is attached to.
SEV = """sev AS (SELECT o_orderkey AS id, o_custkey AS node, CASE WHEN o_custkey % 4 = 0 THEN CASE o_custkey % 5 WHEN 0 THEN 'odd' ELSE CAST(o_custkey % 11 AS VARCHAR) || '.5' END END AS score,
 CASE WHEN o_orderstatus <> 'O' THEN CAST(o_totalprice AS DOUBLE) / 5000 END AS rank, CASE WHEN o_orderpriority = '2-HIGH' THEN 'High' WHEN o_orderpriority = '5-LOW' THEN 'odd' END AS name,
 CASE o_orderkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'note' WHEN 2 THEN 'none' END AS level, CASE o_custkey % 3 WHEN 0 THEN 'Zizmor' WHEN 1 THEN 'ACTIONLINT' ELSE 'Other' END AS tool FROM orders),
f AS (SELECT *, CASE WHEN TRY_CAST(score AS DOUBLE) >= 7 THEN 'high' WHEN TRY_CAST(score AS DOUBLE) >= 4 THEN 'medium' WHEN TRY_CAST(score AS DOUBLE) > 0 THEN 'low' WHEN TRY_CAST(score AS DOUBLE) IS NOT NULL THEN 'info'
 WHEN rank >= 80 THEN 'high' WHEN rank >= 50 THEN 'medium' WHEN rank > 0 THEN 'low' WHEN rank IS NOT NULL THEN 'info' WHEN name = 'High' THEN 'high'
 ELSE CASE coalesce(level, 'warning') WHEN 'error' THEN 'high' WHEN 'warning' THEN 'medium' WHEN 'note' THEN 'low' ELSE 'info' END END AS severity,
 CASE WHEN lower(tool) IN ('zizmor', 'actionlint') THEN lower(tool) ELSE tool END AS source FROM sev),
r AS (SELECT *, CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS rk FROM f),
p AS (SELECT *, CASE WHEN id % 7 = 0 THEN least(rk, 1) WHEN id % 3 = 0 THEN greatest(rk, 3) ELSE rk END AS priority FROM r)"""


def raised(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    score = F.expr("CASE WHEN o_custkey % 4 = 0 THEN CASE o_custkey % 5 WHEN 0 THEN 'odd' ELSE concat(o_custkey % 11, '.5') END END")
    rank = F.expr("CASE WHEN o_orderstatus <> 'O' THEN o_totalprice / 5000 END")
    name = F.expr("CASE WHEN o_orderpriority = '2-HIGH' THEN 'High' WHEN o_orderpriority = '5-LOW' THEN 'odd' END")
    level = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'note' WHEN 2 THEN 'none' END")
    tool = F.expr("CASE o_custkey % 3 WHEN 0 THEN 'Zizmor' WHEN 1 THEN 'ACTIONLINT' ELSE 'Other' END")
    severity = findings.recovered([score], rank, [name], [level])
    out = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("node"), severity.alias("severity"), findings.source_of(tool).alias("source"))
    ranked = out.withColumn("rk", findings.rank_of(F.col("severity")))
    return ranked.withColumn("priority", findings.priority(F.col("rk"), F.col("id") % 7 == 0, F.col("id") % 3 == 0))


@on.query(f"WITH {SEV} SELECT id, severity FROM f")
def severity_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raised(spark, sf_dir).select("id", "severity")


@on.query(f"WITH {SEV} SELECT id, source FROM f")
def finding_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raised(spark, sf_dir).select("id", "source")


@on.query(f"""WITH {SEV} SELECT id, source || ':rule/' || (id % 9) || ':' || CASE id % 3 WHEN 0 THEN 'a/b/' || node ELSE 'c/' || node END || ':' || coalesce(CASE WHEN id % 5 > 0 THEN CAST(id % 100 AS VARCHAR) END, '?') || ':?' AS finding FROM f""")
def finding_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("CASE id % 3 WHEN 0 THEN concat('file://a\\\\b\\\\', node) ELSE concat('c/', node) END")
    line = F.expr("CASE WHEN id % 5 > 0 THEN id % 100 END")
    rule = F.expr("concat('rule/', id % 9)")
    return raised(spark, sf_dir).select("id", findings.finding_id(F.col("source"), rule, path, line, F.lit(None)).alias("finding"))


TALLY = "SELECT node, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in findings.SEVERITIES) + " FROM f GROUP BY node"


@on.query(f"WITH {SEV} {TALLY}")
def severity_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raised(spark, sf_dir).groupBy("node").agg(*findings.tally(F.col("severity")))


@on.query(f"""WITH {SEV} SELECT node, concat_ws(' ', {", ".join(f"CASE WHEN {s} > 0 THEN '{s[0].upper()}:' || {s} END" for s in reversed(findings.SEVERITIES))}) AS badge FROM ({TALLY})""")
def severity_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity_tally(spark, sf_dir).select("node", findings.badge().alias("badge"))


@on.query(f"WITH {SEV} SELECT id, rk AS found, priority FROM p")
def priority_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raised(spark, sf_dir).select("id", F.col("rk").alias("found"), "priority")


@on.query(f"WITH {SEV} SELECT node, list_sort(list_distinct(list(source))) AS sources FROM f GROUP BY node")
def finding_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raised(spark, sf_dir).groupBy("node").agg(F.array_sort(F.collect_set("source")).alias("sources"))


@on.query(f"WITH {SEV} SELECT id, node, priority, row_number() OVER (PARTITION BY node ORDER BY priority DESC, id) AS pos FROM p")
def findings_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of each node, the most pressing first."""
    pos = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("priority"), "id")).cast("long")
    return raised(spark, sf_dir).select("id", "node", "priority", pos.alias("pos"))


@on.query(f"WITH {SEV} SELECT node, CASE WHEN max(priority) >= 3 THEN 'red' WHEN max(priority) = 2 THEN 'amber' ELSE 'grey' END AS colour FROM p GROUP BY node")
def graph_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raised(spark, sf_dir).groupBy("node").agg(findings.colour(F.max("priority")).alias("colour"))


@on.query("""SELECT event_id, pos, k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS first FROM (SELECT event_id, props, unnest([0, 1]) AS pos,
 unnest([CAST(json_extract_string(props, '$.k') AS BIGINT), CAST(json_extract_string(props, '$.k') AS BIGINT) + 1]) AS k FROM events)""")
def sarif_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's results, unnested in order, with its first location."""
    doc = F.expr("""concat('{"runs":[{"results":[', props, ',{"k":', cast(get_json_object(props, '$.k') as bigint) + 1, '}]}]}')""")
    parsed = F.from_json(doc, "runs array<struct<results: array<struct<k: bigint>>>>")
    runs = read(spark, sf_dir, "events").select("event_id", F.explode(parsed["runs"]).alias("run"))
    return runs.select("event_id", F.posexplode("run.results").alias("pos", "r"), F.element_at("run.results", 1)["k"].alias("first")).select("event_id", "pos", F.col("r.k").alias("k"), "first")



@on.query(f"""WITH RECURSIVE {HEAP}, s AS (SELECT DISTINCT l_orderkey AS node FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45),
up AS (SELECT node AS origin, node FROM s UNION SELECT origin, src FROM up JOIN heap ON dst = node)
SELECT origin AS node, count(*) - 1 AS callers_above, max(CASE WHEN node < 10 THEN node END) AS entry FROM up GROUP BY origin""")
def enrich_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each finding's node what lies above it, in one pass over all findings."""
    start = found_at(spark, sf_dir)
    above = graph.reached(graph.reversed_(heap(spark, sf_dir)), start)
    return above.groupBy(F.col("root").alias("node")).agg((F.count(F.lit(1)) - 1).alias("callers_above"), F.max(F.when(F.col("node") < 10, F.col("node"))).alias("entry"))


@on.query(f"""WITH {SEV} SELECT node, bool_or(priority >= 3) AS risky, bool_or(source = 'zizmor') AS audited, bool_and(rk = 0) AS quiet FROM p GROUP BY node""")
def node_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raised(spark, sf_dir).groupBy("node").agg(F.bool_or(F.col("priority") >= 3).alias("risky"), F.bool_or(F.col("source") == "zizmor").alias("audited"), F.bool_and(F.col("rk") == 0).alias("quiet"))


@on.query("SELECT user_id AS node, list_sort(list_distinct(list(event_type))) AS events FROM events WHERE event_type <> 'error' GROUP BY user_id")
def reachable_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct events by which a node is reached."""
    return read(spark, sf_dir, "events").where("event_type <> 'error'").groupBy(F.col("user_id").alias("node")).agg(F.array_sort(F.collect_set("event_type")).alias("events"))


@on.query(f"WITH {SEV} SELECT id FROM p WHERE severity IN ('high', 'medium') AND source IN ('zizmor', 'Other')")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets: one of the values of each, and all facets."""
    return raised(spark, sf_dir).where(F.col("severity").isin("high", "medium") & F.col("source").isin("zizmor", "Other")).select("id")


@on.query(f"WITH {SEV} SELECT id, coalesce(severity = 'high', false) OR coalesce(source = 'zizmor', false) AS visible FROM p")
def visibility_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible if any active filter has the node; a null filter is inactive."""
    return raised(spark, sf_dir).select("id", ((F.col("severity") == "high") | (F.col("source") == "zizmor")).alias("visible"))


@on.query("""SELECT o_orderkey AS node, o_orderpriority AS label, 'steps: ' || count(l_orderkey) || ', actions: ' || count(DISTINCT l_partkey) AS summary
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def node_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("node")).agg(F.count(F.lit(1)).alias("steps"), F.countDistinct("l_partkey").alias("actions"))
    nodes = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("label"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    return nodes.join(counts, "node", "left").select("node", "label", F.concat(F.lit("steps: "), count("steps"), F.lit(", actions: "), count("actions")).alias("summary"))


CORPUS = "corpus AS (SELECT page_id AS id, split_part(url, '/', 3) AS label, lower(split_part(url, '/', 3) || chr(10) || url || chr(10) || html) AS low FROM pages)"
SCORED = f"""{CORPUS}, scored AS (SELECT id, label, greatest(1, 256 - strlen(low[:instr(low, 'éau') - 1])) + greatest(1, 256 - strlen(low[:instr(low, 'en') - 1]))
 + CASE WHEN lower(label) = 'en éau' THEN 1000 ELSE 0 END AS score FROM corpus WHERE contains(low, 'en') AND contains(low, 'éau'))"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("split_part(url, '/', 3)")
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), label.alias("label"), F.concat_ws("\n", label, "url", "html").alias("text"))


@on.query(f"WITH {SCORED} SELECT id, label, score FROM scored")
def search_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scored(corpus(spark, sf_dir), "En éau")


@on.query(f"WITH {SCORED} SELECT id, label, score, (SELECT count(*) FROM scored) AS total FROM scored ORDER BY score DESC, id LIMIT 20")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(search.scored(corpus(spark, sf_dir), "En éau"), 20)


# The graph of an event: workflows reached from its entries.
SCOPE = f"{HEAP}, f AS (SELECT o_orderkey AS node FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT dst FROM f JOIN heap ON src = node)"


def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(heap(spark, sf_dir), risky(spark, sf_dir)).select("node")


@on.query("SELECT o_orderkey AS node FROM orders WHERE o_orderpriority = '1-URGENT'")
def graph_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risky(spark, sf_dir)


@on.query(f"WITH RECURSIVE {SCOPE} SELECT 'wf_' || node AS id, CASE WHEN node IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') THEN 'entry' ELSE 'called' END AS kind FROM f")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = risky(spark, sf_dir).withColumn("entry", F.lit(True))
    return scope(spark, sf_dir).join(entry, "node", "left").select(F.concat(F.lit("wf_"), "node").alias("id"), F.when(F.col("entry"), "entry").otherwise("called").alias("kind"))


@on.query(f"WITH RECURSIVE {SCOPE} SELECT DISTINCT 'wf_' || src AS a, 'wf_' || dst AS b FROM heap WHERE src IN (SELECT node FROM f)")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = scope(spark, sf_dir).withColumnRenamed("node", "src")
    return heap(spark, sf_dir).join(inside, "src", "left_semi").select(F.concat(F.lit("wf_"), "src").alias("a"), F.concat(F.lit("wf_"), "dst").alias("b")).distinct()


@on.query(f"""WITH RECURSIVE {SCOPE}, n AS (SELECT 'wf_' || node AS id FROM f), e AS (SELECT DISTINCT 'wf_' || src AS a, 'wf_' || dst AS b FROM heap WHERE src IN (SELECT node FROM f)),
lines AS (SELECT 0 AS part, '' AS key, 'flowchart LR' AS line UNION ALL SELECT 1, id, '  ' || id || '["' || id || '"]' FROM n UNION ALL SELECT 2, a || ' ' || b, '  ' || a || ' --> ' || b FROM e)
SELECT row_number() OVER (ORDER BY part, key) - 1 AS pos, line FROM lines""")
def graph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagram's lines with their place: header, nodes and edges by their ids as text."""
    head = spark.range(1).select(F.lit(0).alias("part"), F.lit("").alias("key"), F.lit("flowchart LR").alias("line"))
    node = graph_nodes(spark, sf_dir).select(F.lit(1).alias("part"), F.col("id").alias("key"), F.concat(F.lit("  "), "id", F.lit('["'), text.escape_label(F.col("id")), F.lit('"]')).alias("line"))
    edge = graph_edges(spark, sf_dir).select(F.lit(2).alias("part"), F.concat_ws(" ", "a", "b").alias("key"), F.concat(F.lit("  "), "a", F.lit(" --> "), "b").alias("line"))
    return numbered(head.unionByName(node).unionByName(edge), ["part", "key"], "pos").select("pos", "line")


@on.query(f"""WITH RECURSIVE {HEAP}, down AS (SELECT o_orderkey AS entry, o_orderkey AS node FROM orders WHERE o_orderkey < 10 UNION SELECT entry, dst FROM down JOIN heap ON src = node)
SELECT node, list_sort(list(entry)) AS entries, list_sort(list_distinct(list(o_orderpriority))) AS events FROM down JOIN orders ON o_orderkey = entry WHERE node IN ({FOUND}) GROUP BY node""")
def enrich_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that reach each finding's node, handed down as sets, and their events."""
    calls, orders = heap(spark, sf_dir).select("src", "dst"), read(spark, sf_dir, "orders").where("o_orderkey < 10")
    reaching = graph.handed_down(calls, orders.select(F.col("o_orderkey").alias("node"), F.col("o_orderkey").alias("label"))).join(found_at(spark, sf_dir), "node", "left_semi")
    events = reaching.select("node", F.explode("labels").alias("o_orderkey")).join(orders.select("o_orderkey", "o_orderpriority"), "o_orderkey").groupBy("node").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("events"))
    return reaching.join(events, "node").select("node", F.col("labels").alias("entries"), "events")


@on.query("SELECT 'wf:' || o_orderkey AS id, 'workflow' AS kind FROM orders UNION ALL SELECT 'la:' || p_partkey, 'local-action' FROM part UNION ALL SELECT 'ea:' || s_suppkey, 'external-action' FROM supplier")
def browse_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes, reachable or not, with an id by kind."""
    parts = (("wf:", "workflow", "orders", "o_orderkey"), ("la:", "local-action", "part", "p_partkey"), ("ea:", "external-action", "supplier", "s_suppkey"))
    found = [read(spark, sf_dir, table).select(F.concat(F.lit(prefix), key).alias("id"), F.lit(kind).alias("kind")) for prefix, kind, table, key in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


@on.query(f"""WITH {HEAP} SELECT 'wf:' || src AS a, 'wf:' || dst AS b, 'calls-workflow' AS kind FROM heap UNION ALL
SELECT 'wf:' || l_orderkey, 'la:' || l_partkey, 'uses-local-action' FROM lineitem SEMI JOIN part ON l_partkey = p_partkey SEMI JOIN orders ON l_orderkey = o_orderkey UNION ALL
SELECT 'wf:' || l_orderkey, 'ea:' || l_suppkey, 'uses-external-action' FROM lineitem SEMI JOIN supplier ON l_suppkey = s_suppkey SEMI JOIN orders ON l_orderkey = o_orderkey""")
def browse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges between known nodes; several between two nodes stay several."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    # Orders are hashed, so that a task need not sort its share of the much larger line items.
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    line = line.join(orders.hint("shuffle_hash"), "l_orderkey", "left_semi")
    out = heap(spark, sf_dir).select(F.concat(F.lit("wf:"), "src").alias("a"), F.concat(F.lit("wf:"), "dst").alias("b"), F.lit("calls-workflow").alias("kind"))
    for prefix, table, key, kind in (("la:", "part", "p_partkey", "uses-local-action"), ("ea:", "supplier", "s_suppkey", "uses-external-action")):
        known = line.join(read(spark, sf_dir, table).select(key), key, "left_semi")
        out = out.unionByName(known.select(F.concat(F.lit("wf:"), "l_orderkey").alias("a"), F.concat(F.lit(prefix), key).alias("b"), F.lit(kind).alias("kind")))
    return out


@on.query(f"""WITH RECURSIVE {HEAP}, down AS (SELECT o_orderkey AS node FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT dst FROM down JOIN heap ON src = node),
up AS (SELECT o_orderkey AS node FROM orders WHERE o_orderkey IN ({FOUND}) UNION SELECT src FROM up JOIN heap ON dst = node)
SELECT src AS source, dst AS target, src IN (SELECT node FROM down) AND dst IN (SELECT node FROM up) AS on_dangerous_path FROM heap""")
def browse_dangerous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges on a way from a risky entry to a node with findings."""
    links = heap(spark, sf_dir).select(F.col("src").alias("source"), F.col("dst").alias("target"))
    known = found_at(spark, sf_dir).join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node")), "node", "left_semi")
    return browse.dangerous(links, risky(spark, sf_dir), known)
