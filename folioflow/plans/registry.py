"""Registered queries and the SQL that states the same result."""

from __future__ import annotations

from folioflow.plans import documents, incremental, ledger, packets, people, queues, values, writes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in (queues, documents, ledger, people, values, incremental, packets, writes):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
