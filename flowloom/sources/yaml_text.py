"""One YAML document as JSON text, with line numbers; the only per-file Python of the estate reader."""

from __future__ import annotations

import json
import re

LINE = "__line__"
#: Values of a document, aliases written out; more is an error of the file, so that aliases of aliases can't fill the memory.
MAX_VALUES = 1_000_000

#: Plain scalars by the core schema of YAML 1.2: pattern and value. All others are texts (``on``, ``yes``, dates).
CORE = (
    (re.compile(r"~|null|Null|NULL|"), lambda s: None),
    (re.compile(r"true|True|TRUE"), lambda s: True),
    (re.compile(r"false|False|FALSE"), lambda s: False),
    (re.compile(r"[-+]?[0-9]+"), int),
    (re.compile(r"0o[0-7]+"), lambda s: int(s[2:], 8)),
    (re.compile(r"0x[0-9a-fA-F]+"), lambda s: int(s[2:], 16)),
    (re.compile(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?"), float),
)
#: Scalars with a tag of the core schema must be of that kind.
KINDS = {"null": type(None), "bool": bool, "int": int, "float": (int, float)}


class Problem(ValueError):
    """What makes a file no document of the core schema."""


def _scalar(text: str):
    found = next((value for pattern, value in CORE if pattern.fullmatch(text)), str)
    try:
        value = found(text)
    except ValueError:  # more digits than Python takes
        return text
    return text if isinstance(value, float) and value in (float("inf"), float("-inf")) else value


def _value_of(node) -> object:
    """A scalar node's value: untagged plain ones by the core schema, quoted ones and those of other tags as texts."""
    kind = node.tag.removeprefix("tag:yaml.org,2002:") if node.tag else "plain" if node.style is None else "str"
    if kind == "plain":
        return _scalar(node.value)
    if kind not in KINDS:
        return node.value
    value = _scalar(node.value)
    if not isinstance(value, KINDS[kind]) or (kind in ("int", "float") and isinstance(value, bool)):
        raise Problem(f"line {node.start_mark.line + 1}: not of kind {kind}")
    return value


def _document(content: str):
    """The root node; scalars keep the tag that is written, or none."""
    import yaml

    class Untagged(yaml.SafeLoader):
        def resolve(self, kind, value, implicit):
            return None if kind is yaml.ScalarNode else super().resolve(kind, value, implicit)

    return Untagged(content).get_single_node()


def _built(root) -> tuple[dict, list[list[int]]]:
    """The document as plain values, each mapping with its line and the lines of its ``types``, and the line ranges of multi-line texts."""
    import yaml

    texts: list[list[int]] = []
    out: list = [None]
    # What is still to be built: a node, where it goes, and the ids of the nodes around it; None ends a node.
    work, around, count = [(root, out, 0)], set(), 0
    while work:
        node, into, key = work.pop()
        if into is None:
            around.discard(id(node))
            continue
        count += 1
        if count > MAX_VALUES:
            raise Problem(f"more than {MAX_VALUES} values")
        if isinstance(node, yaml.ScalarNode):
            if node.end_mark.line > node.start_mark.line and node.tag in (None, "tag:yaml.org,2002:str"):
                block = node.style in ("|", ">")
                texts.append([node.start_mark.line + (2 if block else 1), node.end_mark.line + (1 if block else 2)])
            into[key] = _value_of(node)
            continue
        if id(node) in around:
            raise Problem(f"line {node.start_mark.line + 1}: an alias to what holds it")
        around.add(id(node))
        work.append((node, None, None))
        if isinstance(node, yaml.MappingNode):
            into[key] = made = {LINE: node.start_mark.line + 1}
            children = [(v, made, k.value) for k, v in node.value if isinstance(k, yaml.ScalarNode)]
            made |= {name: None for _, _, name in children}
            for v, _, name in children:
                if name == "types":
                    made["__types_lines__"] = [i.start_mark.line + 1 for i in (v.value if isinstance(v, yaml.SequenceNode) else [v])]
        else:
            into[key] = made = [None] * len(node.value)
            children = [(v, made, k) for k, v in enumerate(node.value)]
        work += reversed(children)
    return out[0], texts


def to_json(content: str, path: str) -> tuple[str | None, str | None]:
    """(JSON, None), or (None, what is wrong with the file). Mappings carry their line; ``on`` and ``jobs`` become
    lists, as their order matters: {event, body} and {id, body}; a job's line is that of its name. The document also gets ``__texts__``: the
    half-open line ranges of its multi-line texts."""
    import yaml

    try:
        root = _document(content)
        if not isinstance(root, yaml.MappingNode):
            return None, "not a mapping"
        out, texts = _built(root)
        triggers = out.get("on")
        if isinstance(triggers, dict):
            out["on"] = [{"event": k, "body": v if isinstance(v, (dict, list)) else None} for k, v in triggers.items() if k not in (LINE, "__types_lines__")]
        elif triggers is not None:
            out["on"] = [{"event": str(e), "body": None} for e in (triggers if isinstance(triggers, list) else [triggers])]
        if isinstance(out.get("jobs"), dict):
            jobs = next(v for k, v in reversed(root.value) if k.value == "jobs")
            names = {k.value: k.start_mark.line + 1 for k, _ in jobs.value if isinstance(k, yaml.ScalarNode)}
            out["jobs"] = [{"id": k, "body": v | {LINE: names[k]}} for k, v in out["jobs"].items() if k in names and isinstance(v, dict)]
        out["__texts__"] = texts
        return json.dumps(out, ensure_ascii=False), None
    except (yaml.YAMLError, Problem) as e:
        return None, " ".join(str(e).split())
    except RecursionError:
        return None, "nested too deeply"
