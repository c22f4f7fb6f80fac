"""Filter patterns held in columns: globs as regular expressions, and lists of them in turn.

All of it is column work on each row, so a table of declarations is matched without a
shuffle, whatever patterns it holds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A pattern's parts: a first ? or + (a plain character), stars, a list, an escaped character, quantifiers in a row, any other character.
PARTS = r"(?s)^[?+]|\*\*/|\*\*|\*|\[[^\]]*\]?|\\.?|[?+]+|."
#: Within a list: a range or a character.
ITEMS = r"(?s).-.|."


def _plain(c: Column) -> Column:
    """A character as itself, for a regular expression; letters and digits and what isn't ASCII need no backslash."""
    return F.when(c.rlike(r"^[A-Za-z0-9_]$|[^\x00-\x7F]"), c).otherwise(F.concat(F.lit("\\"), c))


def _items(part: Column) -> Column:
    return F.regexp_extract_all(F.substring(part, F.lit(2), F.length(part) - 2), F.lit(ITEMS), F.lit(0))


def _broken(part: Column) -> Column:
    """A list that isn't closed or is empty, a range from a later to an earlier character, or a backslash at the end."""
    backwards = F.exists(_items(part), lambda i: (F.length(i) == 3) & (F.substring(i, 1, 1) > F.substring(i, 3, 1)))
    return (part == "\\") | (part.startswith("[") & (~part.endswith("]") | (part == "[]") | backwards))


def _quantified(run: Column) -> Column:
    """What ?s and +s in a row say about the character before them. A ? right behind another quantifier says nothing."""
    kind = "struct<none:boolean,many:boolean,fresh:boolean>"
    start = F.struct(F.lit(False).alias("none"), F.lit(False).alias("many"), F.lit(False).alias("fresh")).cast(kind)

    def step(state: Column, c: Column) -> Column:
        lazy = (c == "?") & state["fresh"]
        return F.struct((state["none"] | ((c == "?") & ~lazy)).alias("none"), (state["many"] | (c == "+")).alias("many"), (~lazy).alias("fresh")).cast(kind)

    state = F.aggregate(F.split(run, ""), start, step)
    return F.when(state["none"] & state["many"], "*").when(state["many"], "+").when(state["none"], "?").otherwise("")


def regex(pattern: Column) -> Column:
    """A filter pattern as an anchored regular expression for rlike; null if it is null or malformed.

    ``**/`` spans folders, ``**`` anything, ``*`` all but a slash; ``?`` and ``+`` quantify the
    character or list before them and change nothing behind a star; brackets list
    characters and ranges, nothing else; a backslash escapes.
    """
    parts = F.regexp_extract_all(pattern, F.lit(PARTS), F.lit(0))

    def translated(part: Column, k: Column) -> Column:
        before = F.get(parts, k - 1)
        listed = F.concat(F.lit("["), F.array_join(F.transform(_items(part), lambda i: F.when(F.length(i) == 3, F.concat(_plain(F.substring(i, 1, 1)), F.lit("-"), _plain(F.substring(i, 3, 1)))).otherwise(_plain(i))), ""), F.lit("]"))
        return (
            F.when(part == "**/", "(?:.+/)?").when(part == "**", ".*").when(part == "*", "[^/]*")
            .when(part.startswith("["), listed).when(part.startswith("\\"), _plain(F.substring(part, 2, 1)))
            .when((k > 0) & part.rlike("^[?+]+$"), F.when(before.startswith("*"), "").otherwise(_quantified(part)))
            .otherwise(_plain(part))
        )

    whole = F.concat(F.lit(r"(?d)\A"), F.array_join(F.transform(parts, translated), ""), F.lit(r"\z"))
    return F.when(~F.exists(parts, _broken), whole)


def regexes(patterns: Column) -> Column:
    """A list of patterns as an array of struct(no, regex): whether it begins with ``!``, and the rest's expression."""
    return F.transform(patterns, lambda p: F.struct(p.startswith("!").alias("no"), regex(F.regexp_replace(p, "^!", "")).alias("regex")))


def in_turn(value: Column, compiled: Column) -> Column:
    """If the last of ``regexes`` that matches ``value`` is one without ``!``. A malformed one matches nothing."""
    return F.aggregate(compiled, F.lit(False), lambda state, p: F.when(F.coalesce(F.rlike(value, p["regex"]), F.lit(False)), ~p["no"]).otherwise(state))


def accepted(values: Column, kind: Column, patterns: Column) -> Column:
    """If a filter lets any of ``values`` through; ``kind`` is include, exclude (what the patterns end with is kept out) or none."""
    compiled = regexes(patterns)
    hit = lambda v: F.when(kind == "include", in_turn(v, compiled)).when(kind == "exclude", ~in_turn(v, compiled)).otherwise(True)
    return F.exists(values, hit)


def malformed(patterns: Column) -> Column:
    """The patterns of a list that are malformed."""
    return F.filter(patterns, lambda p: regex(F.regexp_replace(p, "^!", "")).isNull())
