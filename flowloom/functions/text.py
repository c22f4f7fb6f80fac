"""Column functions over names, references, paths and patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORKFLOW_DIR = ".github/workflows/"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def classify_target(path: Column) -> Column:
    """``workflow`` for YAML files under the workflow folder, else ``action``; leading ./ and trailing slashes are ignored."""
    bare = F.regexp_replace(path, r"^(?:\./)+|/+$", "")
    return F.when(bare.startswith(WORKFLOW_DIR) & bare.rlike(r"\.ya?ml\z"), "workflow").otherwise("action")


def has_segment(path: Column, segment: str) -> Column:
    return F.array_contains(F.split(path, "/"), segment)


def glob_to_regex(glob: str) -> str:
    """A glob as an anchored regular expression for rlike.

    ``**/`` spans folders, ``**`` anything, ``*`` all but a slash; ``?`` and ``+`` repeat what
    stands before them; brackets list characters; a backslash escapes. Java would read a
    quantifier behind a star as possessive, so each star is a group. Malformed globs
    raise ValueError.
    """
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out.append("(?:.+/)?")
            k += 3
            continue
        if glob.startswith("**", k):
            out.append("(?:.*)")
            k += 2
            continue
        if c == "*":
            out.append("(?:[^/]*)")
        elif c in "?+" and k:
            out.append(c)
        elif c == "[":
            end = glob.find("]", k + 1)
            if end < 0:
                raise ValueError(f"unclosed [ in {glob!r}")
            if end == k + 1:
                raise ValueError(f"empty list in {glob!r}")
            out.append("[" + re.sub(r"([\[\]\\^&])", r"\\\1", glob[k + 1 : end]) + "]")
            k = end
        elif c == "\\":
            if k + 1 == len(glob):
                raise ValueError(f"nothing to escape in {glob!r}")
            out.append(re.escape(glob[k + 1]))
            k += 1
        else:
            out.append(re.escape(c))
        k += 1
    return r"(?ds)\A" + "".join(out) + r"\z"


def matches_glob(column: Column, glob: str) -> Column:
    return column.rlike(glob_to_regex(glob))


def matches_in_turn(column: Column, patterns: list[str]) -> Column:
    """Patterns in order: each that matches includes, or with a leading ! excludes, what it matches; the last one wins.

    An exclusion in the first place changes nothing.
    """
    state = F.lit(False)
    for k, pattern in enumerate(patterns):
        if pattern.startswith("!"):
            if k:
                state = state & ~matches_glob(column, pattern[1:])
        else:
            state = state | matches_glob(column, pattern)
    return state


def docker_display(host: Column, image: Column, tag: Column) -> Column:
    return F.concat(F.coalesce(F.concat(host, F.lit("/")), F.lit("")), image, F.coalesce(F.concat(F.lit(":"), tag), F.lit("")))


def escape_label(label: Column) -> Column:
    """A label for a diagram: quotes, angle brackets, brackets as character references, line feeds as line breaks."""
    for raw, safe in (('"', "#quot;"), ("<", "#lt;"), (">", "#gt;"), ("]", "&#93;"), ("\n", "<br/>")):
        label = F.replace(label, F.lit(raw), F.lit(safe))
    return label


def node_id(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9]", "_")


def parse_remote(url: Column) -> tuple[Column, Column, Column]:
    """Host (lower case), owner and name of a repository address; user names and passwords are dropped."""
    pattern = r"^(?:[A-Za-z+]+://)?(?:[^@/]*@)?([^/:]+)(?::\d+)?[:/]([^/]+)/(.+?)(?:\.git)?/?$"
    part = lambda k: F.nullif(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.lower(part(1)), part(2), part(3)


def expressions(text: Column) -> Column:
    """What stands inside each ``${{ }}``; an unclosed one is no expression."""
    return F.regexp_extract_all(text, F.lit(r"(?s)\$\{\{(.*?)\}\}"), F.lit(1))


def input_names(text: Column) -> Column:
    """The distinct names after ``inputs.`` inside expressions, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.array_join(expressions(text), "\n"), F.lit(r"inputs\.([A-Za-z0-9_-]+)"), F.lit(1))))


def output_refs(text: Column, owner: str) -> Column:
    """The distinct ``<owner>.<id>.outputs.<name>`` inside expressions, ``owner`` being needs or steps: an array of id and output, sorted."""
    found = F.regexp_extract_all(F.array_join(expressions(text), "\n"), F.lit(rf"({owner}\.[A-Za-z0-9_-]+\.outputs\.[A-Za-z0-9_-]+)"), F.lit(1))
    parts = lambda ref: F.split(ref, r"\.")
    return F.array_sort(F.array_distinct(F.transform(found, lambda ref: F.struct(parts(ref)[1].alias("id"), parts(ref)[3].alias("output")))))


def is_dynamic(text: Column, owner: str) -> Column:
    """If an expression indexes inputs, needs or steps by a computed name (``needs[``)."""
    return F.contains(F.array_join(expressions(text), "\n"), F.lit(f"{owner}["))
