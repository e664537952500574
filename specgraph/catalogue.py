"""All registered queries over the given tables."""

from __future__ import annotations

from specgraph.plans import extracts, reads, semantic


def queries() -> dict:
    return {**reads.QUERIES, **semantic.QUERIES, **extracts.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**reads.ORACLES, **semantic.ORACLES, **extracts.ORACLES}
