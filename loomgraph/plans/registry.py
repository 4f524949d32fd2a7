"""All registered queries of the library's own operators, with their oracles."""

from __future__ import annotations

from loomgraph.plans import cochange, diff, files, graph, maintain, semantic, versions

MODULES: tuple = (cochange, files, graph, semantic, diff, maintain, versions)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
