"""All registered queries of the estate engine, by name."""

from __future__ import annotations

from flowloom.plans import audits, declarations, graphs, relations

REGISTRIES = (declarations.on, relations.on, graphs.on, audits.on)

QUERIES = {name: query for registry in REGISTRIES for name, query in registry.queries.items()}
ORACLE_SQL = {name: sql for registry in REGISTRIES for name, sql in registry.sql.items()}
