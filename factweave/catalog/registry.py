"""All registered queries and, where SQL can say the same, their check SQL."""

from __future__ import annotations

from factweave.catalog import checks, naming, outcomes, pairing, papers, search

QUERIES: dict = {}
ORACLES: dict = {}
for module in [pairing, checks, outcomes, naming, papers, search]:
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
