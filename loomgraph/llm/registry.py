"""Queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from loomgraph.llm import bpe, collocations, exact, language, licenses, ogg, packing, pii, quality, runs, simhash, suffix, warc

MODULES = (ogg, suffix, quality, language, warc, bpe, packing, pii, simhash, exact, collocations, runs, licenses)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
