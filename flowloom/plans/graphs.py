"""Queries over call graphs: edges, closures, paths, orphans, permissions, secrets.

Orders are workflows in heap numbering: order n (from 10 on) is called by order (n - 10) div 5
unless its status is P, so orders 0 to 9 are entries. Line items are steps: their part is
a local action, their supplier an external one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.operators import graph, permissions, secrets
from flowloom.plans.registry import Registry, read

on = Registry()


def heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").where("o_orderkey >= 10 and o_orderstatus <> 'P'")
    return orders.select(F.expr("(o_orderkey - 10) div 5").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_orderkey").alias("ord"), "o_orderstatus", "o_orderpriority", "o_custkey")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where("o_orderkey < 10").select(F.col("o_orderkey").alias("node"))


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_linenumber", "l_suppkey")


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as a graph with cycles: part p calls part (7 p + 3) mod N and part p div 2."""
    part = read(spark, sf_dir, "part")
    n = part.agg((F.max("p_partkey") + 1).alias("n"))
    called = F.array((F.col("p_partkey") * 7 + 3) % F.col("n"), F.expr("p_partkey div 2"))
    return part.crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("src"), F.explode(called).alias("dst"))


HEAP = "heap AS (SELECT (o_orderkey - 10) // 5 AS src, o_orderkey AS dst, o_orderstatus, o_orderpriority, o_custkey FROM orders WHERE o_orderkey >= 10 AND o_orderstatus <> 'P')"
CYCLES = "cycles AS (SELECT p_partkey AS src, unnest([(p_partkey * 7 + 3) % (SELECT max(p_partkey) + 1 FROM part), p_partkey // 2]) AS dst FROM part)"
SEEDS = "SELECT o_orderkey AS node FROM orders WHERE o_totalprice > 400000"
RISKY = "SELECT o_orderkey AS node FROM orders WHERE o_orderpriority = '1-URGENT'"
FOUND = "SELECT DISTINCT l_orderkey AS node FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45"


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("node"))


def risky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("node"))


def found_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_orderkey").alias("node")).distinct()


@on.query(f"""WITH {HEAP}, e AS (SELECT src, dst, 'call' AS kind, 0 AS tier, dst AS tie FROM heap UNION ALL
 SELECT l_orderkey, l_partkey, 'uses', 1, l_linenumber * 1000000 + l_suppkey FROM lineitem)
SELECT src, dst, kind, row_number() OVER (PARTITION BY src ORDER BY tier, tie, dst) AS edge_ord FROM e""")
def edges_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges in their fixed order: a workflow's calls, then its steps."""
    call = heap(spark, sf_dir).select("src", "dst", F.lit("call").alias("kind"), F.lit(0).alias("tier"), F.col("dst").alias("tie"))
    step = uses(spark, sf_dir).select("src", "dst", F.lit("uses").alias("kind"), F.lit(1).alias("tier"), (F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).alias("tie"))
    order = Window.partitionBy("src").orderBy("tier", "tie", "dst")
    return call.unionByName(step).select("src", "dst", "kind", F.row_number().over(order).cast("long").alias("edge_ord"))


@on.query(f"""WITH {HEAP} SELECT 'JobCall' AS kind, dst AS target, src AS caller, 0 AS step FROM heap UNION ALL
SELECT 'Step', l_partkey, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who calls each target directly."""
    call = heap(spark, sf_dir).select(F.lit("JobCall").alias("kind"), F.col("dst").alias("target"), F.col("src").alias("caller"), F.lit(0).alias("step"))
    final = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("src"))
    step = uses(spark, sf_dir).join(final, "src", "left_semi").select(F.lit("Step").alias("kind"), F.col("dst").alias("target"), F.col("src").alias("caller"), F.col("l_linenumber").alias("step"))
    return call.unionByName(step)


@on.query(f"""WITH RECURSIVE {HEAP}, r AS (SELECT o_orderkey AS node, 0 AS depth FROM orders WHERE o_orderkey < 10 UNION SELECT dst, depth + 1 FROM r JOIN heap ON src = node)
SELECT node, depth FROM r""")
def forward_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(heap(spark, sf_dir), entries(spark, sf_dir))


@on.query(f"WITH RECURSIVE {HEAP}, r AS ({SEEDS} UNION SELECT src FROM r JOIN heap ON dst = node) SELECT node FROM r")
def reverse_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(graph.reversed_(heap(spark, sf_dir)), seeds(spark, sf_dir)).select("node")


@on.query(f"""WITH RECURSIVE {HEAP}, r AS ({SEEDS} UNION SELECT src FROM r JOIN heap ON dst = node)
SELECT node FROM r WHERE node < 10 AND node NOT IN ({SEEDS})""")
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that a change of the seeds can reach, without the seeds."""
    changed = seeds(spark, sf_dir)
    reached = graph.closure(graph.reversed_(heap(spark, sf_dir)), changed).select("node")
    return reached.join(entries(spark, sf_dir), "node", "left_semi").join(changed, "node", "left_anti").orderBy("node")


@on.query(f"""WITH RECURSIVE {CYCLES}, s AS (SELECT p_partkey AS node FROM part WHERE p_size = 50),
f AS (SELECT node FROM s UNION SELECT dst FROM f JOIN cycles ON src = node), b AS (SELECT node FROM s UNION SELECT src FROM b JOIN cycles ON dst = node)
SELECT node FROM f UNION SELECT node FROM b""")
def bidirectional_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = read(spark, sf_dir, "part").where("p_size = 50").select(F.col("p_partkey").alias("node"))
    return graph.both_ways(cycles(spark, sf_dir), chosen)


@on.query(f"WITH RECURSIVE {HEAP}, r AS ({RISKY} UNION SELECT dst FROM r JOIN heap ON src = node) SELECT node FROM r")
def event_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes that an event's entries run."""
    return graph.closure(heap(spark, sf_dir), risky(spark, sf_dir)).select("node")


@on.query(f"""WITH RECURSIVE {HEAP}, f AS ({RISKY} UNION SELECT dst FROM f JOIN heap ON src = node),
b AS ({FOUND} UNION SELECT src FROM b JOIN heap ON dst = node)
SELECT src, dst FROM heap WHERE src IN (SELECT node FROM f) AND dst IN (SELECT node FROM b)""")
def closure_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges on a way from a risky entry to a finding."""
    return graph.between(heap(spark, sf_dir).select("src", "dst"), risky(spark, sf_dir), found_at(spark, sf_dir)).select("src", "dst")


# A component's smallest node reaches all of it: labels from each node that no smaller neighbour has, the least that arrives counts.
@on.query(f"""WITH RECURSIVE {CYCLES}, e AS (SELECT src AS a, dst AS b FROM cycles UNION SELECT dst, src FROM cycles),
low AS (SELECT a FROM e GROUP BY a HAVING min(b) >= a),
r AS (SELECT a AS node, a AS root FROM low UNION SELECT b, root FROM r JOIN e ON a = node) SELECT node, min(root) AS root FROM r GROUP BY node""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(cycles(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b")))


# Traces: calls in heap order, and from orders of low priority a call back to their caller.
STEPS = """steps AS (SELECT src, dst, dst AS ord, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END AS job_if, CASE WHEN o_orderstatus = 'F' THEN 'final' END AS step_if FROM heap
 UNION ALL SELECT dst, src, -1, NULL, NULL FROM heap WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'F')"""
TRACE = f"""WITH RECURSIVE {HEAP}, {STEPS}, t AS (
 SELECT o_orderkey AS root, o_orderkey AS node, 0 AS depth, [o_orderkey] AS path, [o_orderkey] AS sort_key, false AS is_cycle, CAST(NULL AS VARCHAR) AS guard FROM orders WHERE o_orderkey < 10
 UNION ALL SELECT root, dst, depth + 1, list_append(path, dst), list_append(sort_key, ord), list_contains(path, dst),
  CASE WHEN job_if IS NOT NULL AND step_if IS NOT NULL THEN '(' || job_if || ') && (' || step_if || ')' ELSE coalesce(job_if, step_if) END
 FROM t JOIN steps ON src = node WHERE NOT is_cycle)"""


def traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    down = heap(spark, sf_dir)
    guard = graph.guard(F.expr("CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END"), F.expr("CASE WHEN o_orderstatus = 'F' THEN 'final' END"))
    back = down.where("o_orderpriority = '5-LOW' and o_orderstatus = 'F'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(-1).cast("long").alias("ord"), F.lit(None).cast("string").alias("edge_guard"))
    steps = down.select("src", "dst", "ord", guard.alias("edge_guard")).unionByName(back)
    return graph.paths(steps, entries(spark, sf_dir), {"guard": (F.lit(None).cast("string"), F.col("edge_guard"))})


@on.query(TRACE + " SELECT root, node, depth, array_to_string(path, '>') AS path, is_cycle, guard FROM t")
def trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path from each entry; cycles end in a leaf."""
    return traced(spark, sf_dir).select("root", "node", "depth", F.array_join("path", ">").alias("path"), "is_cycle", "guard")


@on.query(TRACE + """ SELECT root, row_number() OVER (PARTITION BY root ORDER BY sort_key) AS pos, repeat('  ', depth) || node AS dep,
 CASE WHEN depth = 0 THEN 'entry' WHEN is_cycle THEN 'cycle' ELSE 'workflow' END AS kind, coalesce(guard, CASE WHEN depth = 0 THEN 'entry, types: all' ELSE '' END) AS note FROM t""")
def trace_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace of each entry as rows in depth-first order."""
    kind = F.when(F.col("depth") == 0, "entry").when(F.col("is_cycle"), "cycle").otherwise("workflow")
    note = F.coalesce("guard", F.when(F.col("depth") == 0, "entry, types: all").otherwise(""))
    return graph.preorder(traced(spark, sf_dir)).select("root", F.col("pos").cast("long").alias("pos"), F.expr("concat(repeat('  ', depth), node)").alias("dep"), kind.alias("kind"), note.alias("note"))


REACHED = f"{HEAP}, f AS ({RISKY} UNION SELECT dst FROM f JOIN heap ON src = node)"


@on.query(f"WITH RECURSIVE {REACHED} SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderkey NOT IN (SELECT node FROM f)")
def orphans_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflows that are only callable and that no entry reaches."""
    reached = graph.closure(heap(spark, sf_dir), risky(spark, sf_dir)).select(F.col("node").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").where("o_orderpriority <> '1-URGENT'").select("o_orderkey").join(reached, "o_orderkey", "left_anti")


@on.query(f"""WITH RECURSIVE {REACHED} SELECT p_partkey FROM part WHERE p_partkey NOT IN
 (SELECT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT node FROM f) AND l_quantity > 40)""")
def orphans_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached = graph.closure(heap(spark, sf_dir), risky(spark, sf_dir)).select(F.col("node").alias("l_orderkey"))
    used = read(spark, sf_dir, "lineitem").where("l_quantity > 40").join(reached, "l_orderkey", "left_semi").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@on.query("""WITH d AS (SELECT DISTINCT l_orderkey AS callee, l_linenumber AS name FROM lineitem),
u AS (SELECT DISTINCT l_orderkey AS callee, CAST(l_quantity AS BIGINT) % 7 AS name FROM lineitem), dyn AS (SELECT DISTINCT l_orderkey AS callee FROM lineitem WHERE l_discount >= 0.1)
SELECT callee, name FROM d WHERE callee NOT IN (SELECT callee FROM dyn) AND NOT EXISTS (SELECT 1 FROM u WHERE u.callee = d.callee AND u.name = d.name)""")
def orphans_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared inputs that no expression names; a dynamic reference anywhere clears the callee."""
    line = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "callee")
    declared = line.select("callee", F.col("l_linenumber").alias("name")).distinct()
    used = line.select("callee", F.expr("cast(l_quantity as bigint) % 7").alias("name"))
    return declared.join(line.where("l_discount >= 0.1"), "callee", "left_anti").join(used, ["callee", "name"], "left_anti")


@on.query(f"""WITH {HEAP}, d AS (SELECT DISTINCT l_orderkey AS callee, l_linenumber AS name FROM lineitem)
SELECT callee, name FROM d WHERE callee IN (SELECT dst FROM heap) AND NOT EXISTS (SELECT 1 FROM heap JOIN lineitem ON l_orderkey = src
 WHERE dst = callee AND (CAST(l_quantity AS BIGINT) % 7 = name OR l_tax >= 0.08))""")
def orphans_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of callees with a local call site that no call site reads; a dynamic read counts for all."""
    line = read(spark, sf_dir, "lineitem")
    declared = line.select(F.col("l_orderkey").alias("callee"), F.col("l_linenumber").alias("name")).distinct()
    sites = heap(spark, sf_dir).select("src", F.col("dst").alias("callee"))
    calling = line.select(F.col("l_orderkey").alias("src"), F.expr("cast(l_quantity as bigint) % 7").alias("name"), (F.col("l_tax") >= 0.08).alias("dynamic")).distinct()
    reads = sites.join(calling, "src")
    called = declared.join(sites.select("callee").distinct(), "callee", "left_semi")
    return called.join(reads.where("dynamic").select("callee"), "callee", "left_anti").join(reads.select("callee", "name"), ["callee", "name"], "left_anti")


# Permissions: the workflow layer by priority, the job layer by status.
PERM = """perm AS (SELECT o_orderkey AS node,
 CASE o_orderpriority WHEN '1-URGENT' THEN list_transform(range(17), lambda i: 2) WHEN '2-HIGH' THEN list_transform(range(17), lambda i: 1)
  WHEN '3-MEDIUM' THEN list_transform(range(17), lambda i: 0) WHEN '4-NOT SPECIFIED' THEN list_transform(range(17), lambda i: CASE i WHEN 4 THEN 1 WHEN 8 THEN CASE o_custkey % 2 WHEN 0 THEN 2 ELSE 0 END ELSE 0 END) END AS wf,
 CASE o_orderstatus WHEN 'F' THEN list_transform(range(17), lambda i: CASE i WHEN 4 THEN 2 WHEN 10 THEN CASE o_custkey % 3 WHEN 0 THEN 1 ELSE 0 END ELSE 0 END) WHEN 'P' THEN list_transform(range(17), lambda i: 2) END AS job FROM orders)"""


def perm(spark: SparkSession, sf_dir: str, among: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Both layers of each order, or of those that join ``among`` by node; the layers are made after the join, so orders are shuffled as they are."""
    coarse = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'write-all' WHEN '2-HIGH' THEN 'read-all' WHEN '3-MEDIUM' THEN 'odd' END")
    wf = F.expr("CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN map('contents', 'read', 'issues', CASE o_custkey % 2 WHEN 0 THEN 'write' ELSE 'none' END) END")
    job = F.expr("CASE WHEN o_orderstatus = 'F' THEN map('contents', 'write', 'packages', CASE o_custkey % 3 WHEN 0 THEN 'read' ELSE 'none' END) END")
    job_coarse = F.expr("CASE WHEN o_orderstatus = 'P' THEN 'write-all' END")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), "o_orderpriority", "o_orderstatus", "o_custkey")
    orders = orders if among is None else orders.join(among, "node", how)
    kept = [] if among is None or how == "left_semi" else [c for c in among.columns if c != "node"]
    # Columns of their own, so that a map is built once a row and not for each scope.
    said = orders.select("node", *kept, coarse.alias("wf_word"), wf.alias("wf_map"), job_coarse.alias("job_word"), job.alias("job_map"))
    return said.select("node", *kept, permissions.normalised(F.col("wf_word"), F.col("wf_map")).alias("wf"), permissions.normalised(F.col("job_word"), F.col("job_map")).alias("job"))


@on.query(f"WITH {PERM} SELECT node, wf, job FROM perm")
def permissions_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perm(spark, sf_dir)


@on.query(f"WITH {PERM} SELECT node, coalesce(job, wf) AS cap FROM perm")
def permissions_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perm(spark, sf_dir).select("node", permissions.effective(F.col("job"), F.col("wf")).alias("cap"))


# Entries: orders whose customer has an event other than a call.
ENTRY = "node IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type <> 'error'))"
BROAD = f"SELECT 'OverlyBroad' AS kind, node, 'workflow' AS scope FROM perm WHERE list_min(wf) = 2 AND {ENTRY} UNION ALL SELECT 'OverlyBroad', node, 'job' FROM perm WHERE list_min(job) = 2 AND {ENTRY}"


def entry_perm(spark: SparkSession, sf_dir: str) -> DataFrame:
    started = read(spark, sf_dir, "events").where("event_type <> 'error'").select(F.col("user_id").alias("o_custkey"))
    entry = read(spark, sf_dir, "orders").join(started, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("node"))
    return perm(spark, sf_dir, entry, "left_semi")


@on.query(f"WITH {PERM} {BROAD}")
def permissions_overly_broad(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = entry_perm(spark, sf_dir).select("node", F.explode(F.array(F.struct(F.lit("workflow").alias("scope"), F.col("wf").alias("p")), F.struct(F.lit("job").alias("scope"), F.col("job").alias("p")))).alias("l"))
    return each.where("array_min(l.p) = 2").select(F.lit("OverlyBroad").alias("kind"), "node", "l.scope")


@on.query(f"WITH {PERM} SELECT 'ImplicitDefault' AS kind, node, 'workflow' AS scope FROM perm WHERE wf IS NULL AND job IS NULL AND {ENTRY}")
def permissions_implicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entry_perm(spark, sf_dir).where("wf is null and job is null").select(F.lit("ImplicitDefault").alias("kind"), "node", F.lit("workflow").alias("scope"))


ESCALATION = f"""{HEAP}, {PERM}, t AS (SELECT node AS root, node, 0 AS depth, coalesce(job, wf) AS cap, false AS violated FROM perm WHERE node < 10 AND coalesce(job, wf) IS NOT NULL
 UNION ALL SELECT root, p.node, depth + 1,
  list_transform(range(1, 18), lambda i: least(cap[i], coalesce(p.wf[i], 2), coalesce(p.job[i], 2))),
  coalesce(len(list_filter(range(1, 18), lambda i: coalesce(p.job, p.wf)[i] > cap[i])) > 0 AND coalesce(p.job, p.wf) IS NOT NULL, false)
 FROM t JOIN heap ON src = t.node JOIN perm p ON p.node = dst)"""


def escalated(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = perm(spark, sf_dir, heap(spark, sf_dir).select("src", F.col("dst").alias("node"), "ord")).withColumnRenamed("node", "dst")
    start = perm(spark, sf_dir).where("node < 10").select("node", permissions.effective(F.col("job"), F.col("wf")).alias("cap"))
    return permissions.escalations(calls, start)


@on.query(f"WITH RECURSIVE {ESCALATION} SELECT root, node, min(depth) AS chain FROM t WHERE violated GROUP BY root, node")
def permissions_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return escalated(spark, sf_dir)


ALL = f"""WITH RECURSIVE {ESCALATION}, a AS (SELECT kind, node, scope, 'high' AS severity FROM ({BROAD}) UNION ALL
 SELECT 'ImplicitDefault', node, 'workflow', 'medium' FROM perm WHERE wf IS NULL AND job IS NULL AND {ENTRY} UNION ALL
 SELECT DISTINCT 'Escalation', node, 'chain', 'high' FROM t WHERE violated)"""


@on.query(ALL + " SELECT kind, node, scope, severity FROM a")
def permissions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All permission findings, the severe ones first."""
    high = permissions_overly_broad(spark, sf_dir).union(escalated(spark, sf_dir).select(F.lit("Escalation"), "node", F.lit("chain"))).withColumn("severity", F.lit("high"))
    return high.union(permissions_implicit(spark, sf_dir).withColumn("severity", F.lit("medium"))).orderBy("severity", "node", "kind", "scope")


@on.query(ALL + " SELECT severity, count(*) AS n FROM a GROUP BY severity")
def permissions_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permissions_all(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


# Secrets: how the caller passes secrets on follows from the callee's customer number.
LOST = f"""{HEAP}, h AS (SELECT src, dst, o_custkey % 8 AS m, o_orderstatus FROM heap), up AS (
 SELECT dst AS leaf, dst AS node, 'X' AS want, true AS exact, 0 AS depth, CAST(NULL AS BIGINT) AS dropped, false AS done FROM h WHERE o_orderstatus = 'F'
 UNION ALL SELECT leaf, src, CASE WHEN done THEN want WHEN m = 1 AND upper(want) = 'X' AND (NOT exact OR want = 'X') THEN 'y' WHEN m = 5 AND upper(want) = 'Y' AND NOT exact THEN 'X' ELSE want END,
  CASE WHEN NOT done AND m IN (1, 5) THEN false ELSE exact END, depth + 1,
  CASE WHEN done THEN dropped WHEN m IN (2, 3, 6, 7) OR (m = 1 AND upper(want) <> 'X') OR (m = 5 AND (exact OR upper(want) <> 'Y')) THEN src END,
  done OR m IN (2, 3, 6, 7) OR (m = 1 AND upper(want) <> 'X') OR (m = 5 AND (exact OR upper(want) <> 'Y'))
 FROM up JOIN h ON dst = node),
lost AS (SELECT node AS entry, leaf AS callee, 'X' AS secret, depth, dropped AS dropped_at FROM up WHERE node < 10 AND dropped IS NOT NULL)"""


def lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.expr("CASE o_custkey % 4 WHEN 0 THEN 'inherit' WHEN 1 THEN 'explicit' WHEN 2 THEN 'empty' ELSE 'none' END")
    names = F.expr("CASE o_custkey % 8 WHEN 1 THEN map('X', '${{ secrets.y }}') WHEN 5 THEN map('Y', '${{ secrets.X }}') END")
    h = heap(spark, sf_dir)
    calls = h.select("src", "dst", "ord", mode.alias("mode"), names.alias("map"))
    required = h.where("o_orderstatus = 'F'").select(F.col("dst").alias("node"), F.lit("X").alias("secret"))
    return secrets.lost(calls, entries(spark, sf_dir), required)


@on.query(f"WITH RECURSIVE {LOST} SELECT entry, callee, secret, dropped_at FROM lost WHERE depth = 1")
def secrets_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lost(spark, sf_dir).where("kind = 'MissingSecretPropagation'").select("entry", "callee", "secret", "dropped_at")


@on.query(f"WITH RECURSIVE {LOST} SELECT entry, callee, secret, depth, dropped_at FROM lost WHERE depth > 1")
def secrets_chain_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lost(spark, sf_dir).where("kind = 'SecretsInheritChainBreak'").select("entry", "callee", "secret", "depth", "dropped_at")


@on.query(f"""WITH RECURSIVE {HEAP}, r AS (SELECT o_orderkey AS node FROM orders WHERE o_orderkey < 10 UNION SELECT dst FROM r JOIN heap ON src = node)
SELECT l_orderkey AS node, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O' AND l_orderkey >= 10 AND l_orderkey IN (SELECT node FROM r)""")
def secrets_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with an environment in callees that an entry reaches."""
    jobs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), "l_linenumber", "l_partkey", "l_suppkey", F.expr("CASE WHEN l_linestatus = 'O' THEN 'production' END").alias("environment"))
    return secrets.shadowed_environments(jobs, graph.closure(heap(spark, sf_dir), entries(spark, sf_dir))).drop("environment")
