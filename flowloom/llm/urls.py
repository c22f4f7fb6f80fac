"""URL filtering by a temporal list join.

List entries are dated: an entry adds or removes a key (a domain, or a domain with a
path prefix) on a day. They become validity intervals, and every capture is evaluated
against the entries that were active when it was fetched: an as-of join on the keys of
its URL. Of the active entries the most specific key decides; at equal keys an allowing
list wins. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


ALLOW = "allow"
SALTS = 16


def host_of(url):
    """The host of an absolute URL: lower case, without user, port and final dots; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)), r"\.+$", "")


def path_of(url):
    """The path of an absolute URL without query and fragment."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys_of(host: str, path: str):
    """All keys under which lists may hold a URL: its domain and the parents, and its host with each path prefix."""
    return F.expr(f"""if({host} = '', array(), concat(
        transform(sequence(1, size(split({host}, '[.]'))), i -> array_join(slice(split({host}, '[.]'), i, size(split({host}, '[.]'))), '.')),
        transform(filter(sequence(1, size(filter(split({path}, '/'), s -> s <> '')) + 1), j -> j <= size(filter(split({path}, '/'), s -> s <> ''))),
                  j -> concat({host}, '/', array_join(slice(filter(split({path}, '/'), s -> s <> ''), 1, j), '/')))))""")


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals [valid_from, valid_to) of dated entries (list, key, action, day).

    An interval runs from an added entry to the next entry of the same list and key, whatever
    that is, or is open (null). Of entries of one day the removal counts.
    """
    one = entries.groupBy("list", "key", "day").agg(F.min(F.when(F.col("action") == "add", 1).otherwise(0)).alias("added"))
    upcoming = F.lead("day").over(Window.partitionBy("list", "key").orderBy("day"))
    return one.withColumn("valid_to", upcoming).where("added = 1").select("list", "key", F.col("day").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetch_day") -> DataFrame:
    """Per row of ``captures``: id, host, day, n_active (entries active at fetch time), lists (their names, sorted,
    comma-joined), deciding_key (the most specific active key, null if none) and blocked.

    A capture without URL, host or day has no active entries and is not blocked; repeated
    rows keep a row each; other columns are left out. Keys meet their entries once for each
    day; the captures of a key that very many share (their host) are dealt over SALTS
    tasks for each day.
    """
    read = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(day_col).cast("int").alias("day"))
    rows = read.select("id", "day", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("row", F.monotonically_increasing_id())
    keyed = rows.select("row", "id", "day", "host", F.explode_outer(keys_of("host", "path")).alias("key"))
    valid = intervals(entries)
    # Each key and day is looked up once, however many captures share them, and comes back to them over salts.
    asked = keyed.select("key", "day").where("key is not null and day is not null").distinct()
    active = (asked["key"] == valid["key"]) & (valid["valid_from"] <= asked["day"]) & (valid["valid_to"].isNull() | (asked["day"] < valid["valid_to"]))
    held = asked.join(valid.hint("merge"), active).groupBy(asked["key"], "day").agg(F.count(F.lit(1)).alias("n"), F.collect_set("list").alias("held"), F.max((F.col("list") == ALLOW).cast("int")).alias("allow"))
    held = held.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})"))).withColumn("hit", F.col("key"))
    found = keyed.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(held.hint("merge"), ["key", "day", "salt"], "left")
    best = F.max(F.when(F.col("hit").isNotNull(), F.struct(F.length("hit").alias("n"), "allow", F.col("hit").alias("key"))))
    verdict = found.groupBy("row").agg(
        F.first("id").alias(id_col),
        F.first("host").alias("host"),
        F.first("day").alias(day_col),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_active"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("held")))), ",").alias("lists"),
        best.alias("best"),
    )
    return verdict.select(id_col, "host", day_col, "n_active", "lists", F.col("best.key").alias("deciding_key"), F.coalesce(F.col("best.allow") == 0, F.lit(False)).alias("blocked"))


def dated_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day. The given table has none; it follows from the page's number."""
    return pages.select("page_id", "url", (F.col("page_id") * 37 % 365).cast("int").alias("fetch_day"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list that grows with the pages: entries for hosts, parent domains and first path segments, by their first page."""
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    seen = seen.withColumn("top", F.substring_index("path", "/", 2))
    parent = F.substring_index("host", ".", -3)
    hosts = seen.groupBy(F.col("host").alias("key")).agg(F.min("page_id").alias("m"))
    parents = seen.groupBy(parent.alias("key")).agg(F.min("page_id").alias("m"))
    tops = seen.where("length(top) > 1").groupBy(F.concat("host", "top").alias("key")).agg(F.min("page_id").alias("m"))

    def entry(of: DataFrame, when: str, name: str, action: str, day: str) -> DataFrame:
        return of.where(when).select(F.lit(name).alias("list"), "key", F.lit(action).alias("action"), F.expr(f"cast({day} as int)").alias("day"))

    parts = [entry(*(hosts if p[0] == "hosts" else parents if p[0] == "parents" else tops, *p[1:])) for p in ENTRIES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Of which keys, for which first page m, in which list, what happens on which day.
ENTRIES = [
    ("hosts", "m % 3 = 0", "spam", "add", "m * 7 % 200"),
    ("hosts", "m % 3 = 0", "spam", "remove", "m * 7 % 200 + 60"),
    ("hosts", "m % 6 = 0", "spam", "add", "m * 7 % 200 + 120"),
    ("parents", "m % 4 < 2", "adult", "add", "m * 13 % 250"),
    ("parents", "m % 8 = 0", "adult", "remove", "m * 13 % 250 + 90"),
    ("tops", "m % 4 = 1", ALLOW, "add", "m * 5 % 150"),
    ("tops", "m % 5 = 0", "spam", "add", "m * 11 % 300"),
    ("tops", "m % 10 = 0", "spam", "remove", "m * 11 % 300 + 30"),
]


def evaluated_pages(pages: DataFrame) -> DataFrame:
    return filter_captures(dated_captures(pages), derived_entries(pages))


def _entry_sql(of: str, when: str, name: str, action: str, day: str) -> str:
    return f"SELECT '{name}' AS list, key, '{action}' AS action, {day} AS day FROM {of} WHERE {when}"


#: The same rows by SQL.
SQL = f"""WITH urls AS (
  SELECT page_id, (page_id * 37 % 365)::INTEGER AS fetch_day, row_number() OVER () AS rid,
         regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '[.]+$', '') AS host,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
parts AS (
  SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM urls),
seen AS (
  SELECT page_id, host, CASE WHEN path LIKE '/%' THEN '/' || string_split(path, '/')[2] ELSE path END AS top,
         array_to_string(labels[greatest(1, len(labels) - 2):], '.') AS parent
  FROM parts WHERE host <> ''),
hosts AS (SELECT host AS key, min(page_id) AS m FROM seen GROUP BY 1),
parents AS (SELECT parent AS key, min(page_id) AS m FROM seen GROUP BY 1),
tops AS (SELECT host || top AS key, min(page_id) AS m FROM seen WHERE length(top) > 1 GROUP BY 1),
entries AS ({" UNION ALL ".join(_entry_sql(*e) for e in ENTRIES)}),
days AS (SELECT list, key, day, min(CASE WHEN action = 'add' THEN 1 ELSE 0 END) AS added FROM entries GROUP BY ALL),
valid AS (SELECT list, key, added, day AS valid_from, lead(day) OVER (PARTITION BY list, key ORDER BY day) AS valid_to FROM days),
keyed AS (
  SELECT rid, fetch_day, unnest(list_concat(
    list_transform(range(1, len(labels) + 1), lambda i: array_to_string(labels[i:], '.')),
    list_transform(range(1, len(segs) + 1), lambda j: host || '/' || array_to_string(segs[1:j], '/')))) AS key
  FROM parts WHERE host <> ''),
hits AS (
  SELECT rid, list, k.key FROM keyed k JOIN valid v ON k.key = v.key AND v.added = 1
   AND v.valid_from <= k.fetch_day AND (v.valid_to IS NULL OR k.fetch_day < v.valid_to)),
best AS (
  SELECT rid, count(*) AS n_active, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists,
         max({{'n': length(key), 'allow': CASE WHEN list = 'allow' THEN 1 ELSE 0 END, 'key': key}}) AS best
  FROM hits GROUP BY rid)
SELECT page_id, host, fetch_day, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists, best.key AS deciding_key,
       coalesce(best.allow = 0, false) AS blocked
FROM urls LEFT JOIN best USING (rid)"""
