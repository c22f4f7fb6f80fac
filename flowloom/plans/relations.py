"""Queries on scans, joins, set operations and ordered joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import text
from flowloom.operators import joins
from flowloom.plans.registry import Registry, read

on = Registry()


@on.query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT'")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", "o_orderstatus")


@on.query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
 ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1""")
def scan_first_per_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each container, the first in order: a least struct, which partial sums keep small."""
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("first")
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(first).select("l_orderkey", "first.*")


@on.query("SELECT l_orderkey AS a, l_partkey AS b FROM lineitem UNION ALL SELECT o_orderkey, o_custkey FROM orders")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"))
    return line.unionByName(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b")))


@on.query("SELECT l_orderkey AS a, l_partkey AS b FROM lineitem UNION SELECT o_orderkey, o_custkey FROM orders")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_all(spark, sf_dir).distinct()


@on.query("SELECT l_partkey AS k FROM lineitem INTERSECT SELECT o_custkey FROM orders")
def intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")).intersect(read(spark, sf_dir, "orders").select("o_custkey"))


@on.query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(read(spark, sf_dir, "orders").select("o_custkey"))


@on.query("""SELECT l_partkey AS node, min(CAST(l_orderkey AS BIGINT) * 100 + l_linenumber) AS first_ord FROM lineitem GROUP BY l_partkey""")
def scope_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a scope in order, each where it comes first."""
    place = (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord")
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"), place).groupBy("node").agg(F.min("ord").alias("first_ord"))


@on.query("SELECT l_orderkey, l_linenumber, l_suppkey, p_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey")
def join_inner_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select("l_orderkey", "l_linenumber", "l_suppkey", "p_partkey", "p_name")


@on.query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ANTI JOIN (SELECT * FROM part WHERE p_size > 5) p ON l_partkey = p_partkey")
def join_left_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of a local target that doesn't exist."""
    known = read(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(known, "l_partkey", "left_anti")


NAMED = "CASE WHEN p_size % 2 = 0 THEN p_name END"


@on.query(f"""WITH n AS (SELECT p_partkey, coalesce({NAMED}, CAST(p_partkey AS VARCHAR)) AS name FROM part)
SELECT a.name AS upstream, count(*) AS targets, min(b.p_partkey) AS first_target FROM (SELECT DISTINCT name FROM n) a JOIN n b ON a.name = b.name GROUP BY 1""")
def join_coalesce_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to all targets that go by them: the given name, else the id."""
    n = read(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.expr(NAMED), F.col("p_partkey").cast("string")).alias("name"))
    wanted = n.select(F.col("name").alias("upstream")).distinct()
    return wanted.join(n, F.col("upstream") == F.col("name")).groupBy("upstream").agg(F.count(F.lit(1)).alias("targets"), F.min("p_partkey").alias("first_target"))


@on.query("""SELECT CASE WHEN p_partkey IS NULL THEN 'dangling' ELSE 'resolved' END AS state, count(*) AS uses, count(DISTINCT l_partkey) AS targets
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 5) p ON l_partkey = p_partkey GROUP BY 1""")
def join_left_outer_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, known = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part").where("p_size > 5")
    state = F.when(F.col("p_partkey").isNull(), "dangling").otherwise("resolved")
    both = line.join(known, line["l_partkey"] == known["p_partkey"], "left")
    return both.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("l_partkey").alias("targets"))


@on.query("""WITH rules AS (SELECT p_brand AS rule, arg_max(p_type, p_partkey) AS level FROM part GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, level FROM lineitem LEFT JOIN rules ON rule = 'Brand#' || (l_partkey % 30)""")
def join_left_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with what their rule says; of rules with one id the last counts."""
    rules = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("rule")).agg(F.max_by("p_type", "p_partkey").alias("level"))
    line = read(spark, sf_dir, "lineitem").withColumn("rule", F.concat(F.lit("Brand#"), F.col("l_partkey") % 30))
    return line.join(rules, "rule", "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "level")


@on.query("SELECT o_orderkey, count(*) AS findings FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY o_orderkey")
def join_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings per node that exists; the others are dropped."""
    found = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("findings"))
    node = read(spark, sf_dir, "orders").select("o_orderkey")
    return node.join(found, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "findings")


@on.query("""SELECT o_custkey AS callee, o_orderkey AS name FROM orders WHERE NOT EXISTS
 (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey % 10 = o_custkey % 10)""")
def anti_declared_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared names that nothing refers to, by callee and name."""
    declared = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("callee"), F.col("o_orderkey").alias("name"), (F.col("o_custkey") % 10).alias("g"))
    used = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), (F.col("l_suppkey") % 10).alias("g")).distinct()
    return declared.join(used, ["name", "g"], "left_anti").select("callee", "name")


# Paths: page addresses without their scheme.
PATH = "regexp_replace(url, '^[a-z]+://', '')"


@on.query(f"""WITH p AS (SELECT DISTINCT {PATH} AS path FROM pages),
a AS (SELECT DISTINCT unnest([string_split(path, '/')[1], array_to_string(string_split(path, '/')[1:2], '/')]) AS prefix FROM p WHERE length(path) % 3 = 0)
SELECT path, arg_max(prefix, length(prefix)) AS prefix FROM p LEFT JOIN a ON path = prefix OR starts_with(path, prefix || '/') GROUP BY path""")
def longest_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = read(spark, sf_dir, "pages").select(F.expr(PATH).alias("path")).distinct()
    ids = paths.where("length(path) % 3 = 0").select(F.explode(F.array(F.substring_index("path", "/", 1), F.substring_index("path", "/", 2))).alias("prefix"))
    return joins.longest_prefix(paths, ids)


@on.query("""WITH u AS (SELECT user_id, ts, event_id, event_type, CASE event_type WHEN 'error' THEN 1 ELSE 0 END AS kind,
 CASE event_type WHEN 'purchase' THEN 1 ELSE 0 END AS rank FROM events WHERE event_type IN ('error', 'signup', 'purchase'))
SELECT event_id, user_id, anchor_id, exact FROM (SELECT *, last_value(CASE WHEN kind = 0 THEN event_id END IGNORE NULLS) OVER w AS anchor_id,
 coalesce(last_value(CASE WHEN kind = 0 THEN ts END IGNORE NULLS) OVER w = ts, false) AS exact
 FROM u WINDOW w AS (PARTITION BY user_id ORDER BY ts, kind, rank, event_id ROWS UNBOUNDED PRECEDING)) WHERE kind = 1""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings attached to the nearest node before them, or exactly to the one they are on."""
    events = read(spark, sf_dir, "events")
    anchors = events.where(F.col("event_type").isin("signup", "purchase")).withColumnRenamed("event_id", "anchor_id")
    rank = F.when(F.col("event_type") == "purchase", 1).otherwise(0)
    found = joins.asof_backward(events.where("event_type = 'error'"), anchors, "user_id", "ts", "event_id", "anchor_id", rank, F.date_trunc("day", "ts"))
    return found.select("event_id", "user_id", "anchor_id", F.coalesce(F.col("anchor_at") == F.col("ts"), F.lit(False)).alias("exact"))


@on.query("""SELECT c.event_id, c.user_id, (SELECT n.event_id FROM events n WHERE n.user_id = c.user_id AND n.event_type = 'click' AND n.ts > c.ts
 ORDER BY n.ts, n.event_id LIMIT 1) AS node_id FROM events c WHERE c.event_type = 'signup'""")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments attached to the next node below them."""
    events = read(spark, sf_dir, "events")
    nodes = events.where("event_type = 'click'").withColumnRenamed("event_id", "node_id")
    found = joins.asof_forward(events.where("event_type = 'signup'"), nodes, "user_id", "ts", "event_id", "node_id", F.date_trunc("day", "ts"))
    return found.select("event_id", "user_id", "node_id")


@on.query("""WITH r AS (SELECT l_suppkey AS k, l_partkey AS lo, l_partkey + l_linenumber * 2 AS hi FROM lineitem WHERE l_quantity > 40)
SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity <= 40 AND NOT EXISTS
 (SELECT 1 FROM r WHERE k = l_suppkey AND lo <= l_partkey AND l_partkey < hi)""")
def range_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment lines that lie in no multi-line text."""
    line = read(spark, sf_dir, "lineitem")
    ranges = line.where("l_quantity > 40").select("l_suppkey", F.col("l_partkey").alias("lo"), (F.col("l_partkey") + F.col("l_linenumber") * 2).alias("hi"))
    points = line.where("l_quantity <= 40").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    return joins.outside_ranges(points, ranges, "l_suppkey", "l_partkey", "lo", "hi", 1000)


@on.query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[^ ]* (ring|bolt)$') AND NOT regexp_matches(p_name, '^red .*$')")
def filter_glob_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    wanted = text.matches_glob(F.col("p_name"), "* ring") | text.matches_glob(F.col("p_name"), "* bolt")
    return part.where(wanted & ~text.matches_glob(F.col("p_name"), "red **")).select("p_partkey", "p_name")


@on.query(f"SELECT page_id, url FROM pages WHERE regexp_matches({PATH}, '^([^/]*[.])example[.](com|org)/(.+/)?[^/]*$')")
def filter_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr(PATH)
    globs = [text.matches_glob(path, f"*.example.{end}/**/*") for end in ("com", "org")]
    return read(spark, sf_dir, "pages").where(globs[0] | globs[1]).select("page_id", "url")


@on.query(f"""SELECT page_id FROM pages WHERE regexp_matches({PATH}, '^.*/en/.*$') AND NOT regexp_matches({PATH}, '^m[.].*$')
 OR regexp_matches({PATH}, '^.*[.]html$')""")
def filter_seq_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = ["!**", "**/en/**", "!m.**", "**.html"]
    return read(spark, sf_dir, "pages").where(text.matches_in_turn(F.expr(PATH), patterns)).select("page_id")


TARGET = "concat('./.github/workflows/', p_brand, CASE p_size % 4 WHEN 0 THEN '.yml' WHEN 1 THEN '.yaml' WHEN 2 THEN '/x.yml' ELSE '' END)"


@on.query(f"""SELECT p_partkey, CASE WHEN p_size % 4 < 3 THEN 'workflow' ELSE 'action' END AS kind, {TARGET} AS target FROM part""")
def classify_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", text.classify_target(F.expr(TARGET)).alias("kind"), F.expr(TARGET).alias("target"))


@on.query(f"SELECT page_id, list_contains(string_split({PATH}, '/'), 'en') AS fixture FROM pages")
def array_contains_seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.has_segment(F.expr(PATH), "en").alias("fixture"))


@on.query("SELECT page_id, list_last(string_split(url, '/')) AS base FROM pages")
def basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.basename(F.col("url")).alias("base"))


@on.query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'ghcr.io/' ELSE '' END || replace(p_name, ' ', '-') ||
 CASE WHEN p_size % 2 = 0 THEN ':' || p_size ELSE '' END AS shown FROM part""")
def docker_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, tag = F.expr("CASE WHEN p_size % 3 = 0 THEN 'ghcr.io' END"), F.expr("CASE WHEN p_size % 2 = 0 THEN cast(p_size as string) END")
    return read(spark, sf_dir, "part").select("p_partkey", text.docker_display(host, F.expr("replace(p_name, ' ', '-')"), tag).alias("shown"))


@on.query("""SELECT c_custkey, 'git.example.org' AS host, c_mktsegment AS owner, replace(c_name, '#', '-') AS name FROM customer""")
def parse_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.expr("""CASE c_nationkey % 3 WHEN 0 THEN concat('git@Git.Example.org:', c_mktsegment, '/', replace(c_name, '#', '-'), '.git')
        WHEN 1 THEN concat('https://user:word@git.example.org/', c_mktsegment, '/', replace(c_name, '#', '-'))
        ELSE concat('ssh://git@GIT.example.org:22/', c_mktsegment, '/', replace(c_name, '#', '-'), '.git/') END""")
    host, owner, name = text.parse_remote(url)
    return read(spark, sf_dir, "customer").select("c_custkey", host.alias("host"), owner.alias("owner"), name.alias("name"))


@on.query("""SELECT page_id, replace(replace(replace(replace(replace(html, '"', '#quot;'), '<', '#lt;'), '>', '#gt;'), ']', '&#93;'), chr(10), '<br/>') AS label,
 regexp_replace(url, '[^A-Za-z0-9]', '_', 'g') AS node FROM pages""")
def escape_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.escape_label(F.col("html")).alias("label"), text.node_id(F.col("url")).alias("node"))


@on.query("""SELECT p_partkey, CASE WHEN starts_with(p_name, 'red ') THEN substr(p_name, 5) ELSE p_name END AS rule FROM part""")
def rule_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.expr("CASE WHEN startswith(p_name, 'red ') THEN substr(p_name, 5) ELSE p_name END").alias("rule"))


WORK = "replace(replace(html, '<p>', '${{ inputs.'), '</p>', ' }}')"


@on.query(f"""WITH e AS (SELECT page_id, array_to_string(regexp_extract_all({WORK}, '(?s)\\$\\{{\\{{(.*?)\\}}\\}}', 1), chr(10)) AS t FROM pages)
SELECT page_id, list_sort(list_distinct(regexp_extract_all(t, 'inputs[.]([A-Za-z0-9_-]+)', 1))) AS names FROM e""")
def regex_extract_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.input_names(F.expr(WORK)).alias("names"))


@on.query("""SELECT s.l_orderkey, s.texts FROM (SELECT l_orderkey, list_sort(list_distinct(flatten(list([l_returnflag, l_linestatus, CAST(l_partkey AS VARCHAR)])))) AS texts
 FROM lineitem GROUP BY l_orderkey) s""")
def collect_exprs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct texts of all scanned fields of a node."""
    fields = F.explode(F.array("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"))).alias("text")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", fields).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("text")).alias("texts"))


@on.query("""WITH s AS (SELECT s_suppkey, s_nationkey % 5 AS owner, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey % 7 AS VARCHAR) END AS sub FROM supplier)
SELECT DISTINCT owner, coalesce(sub, '') AS subpath, l_linenumber AS ref FROM lineitem JOIN s ON l_suppkey = s_suppkey""")
def distinct_externals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("owner"), F.expr("CASE WHEN s_suppkey % 2 = 0 THEN cast(s_suppkey % 7 as string) END").alias("sub"))
    used = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_linenumber").alias("ref")).distinct()
    return used.join(ref, "s_suppkey").select("owner", F.coalesce("sub", F.lit("")).alias("subpath"), "ref").distinct().orderBy("owner", "subpath", "ref")


@on.query("""SELECT 'workflows' AS what, count(*) AS n FROM orders UNION ALL SELECT 'actions', count(*) FROM part
UNION ALL SELECT 'external', count(*) FROM supplier UNION ALL SELECT 'diagnostics', count(*) FROM events WHERE event_type = 'error'""")
def build_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"workflows": read(spark, sf_dir, "orders"), "actions": read(spark, sf_dir, "part"), "external": read(spark, sf_dir, "supplier"), "diagnostics": read(spark, sf_dir, "events").where("event_type = 'error'")}
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n") for what, df in parts.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@on.query("""SELECT CASE WHEN g.src IS NULL THEN 'cached' ELSE 'parsed' END AS origin, o.o_orderkey, o.o_totalprice FROM orders o
LEFT JOIN (SELECT o_orderkey AS src FROM orders WHERE year(o_orderdate) >= 1997 OR o_orderstatus = 'P') g ON g.src = o.o_orderkey""")
def incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.streaming import refresh

    orders = read(spark, sf_dir, "orders")
    mark = F.expr("CASE WHEN year(o_orderdate) >= 1997 OR o_orderstatus = 'P' THEN 2 ELSE 1 END").alias("mtime")
    now = orders.select(F.col("o_orderkey").alias("file"), mark)
    before = orders.select(F.col("o_orderkey").alias("file"), F.lit(1).alias("mtime"))
    rows = orders.select(F.col("o_orderkey").alias("file"), "o_totalprice")
    merged = refresh.merge(rows, before, now, lambda stale: rows.join(stale, "file", "left_semi"))
    return merged.select("origin", F.col("file").alias("o_orderkey"), "o_totalprice")


@on.query("SELECT conv_id, turn, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM conversations")
def posexplode_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return lines.select("conv_id", "turn", (F.col("p") + 1).alias("line_no"), "line")


@on.query("""SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: NOT starts_with(l, '#!')
 AND NOT regexp_matches(l, '^set\\s+-[eu]+(o\\s+pipefail)?$') AND length(l) > 20)[1] AS line FROM conversations""")
def first_meaningful_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.operators import extract

    line = extract.first_meaningful_line(F.col("text"), least=21)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line"))
