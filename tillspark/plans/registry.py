"""All registered queries and the SQL they are checked against."""

from __future__ import annotations

from tillspark.plans import (archive, extraction, insights, maintenance, media, queue,
                             replication, streaming)

_MODULES = (insights, archive, replication, queue, extraction, media, maintenance,
            streaming)


def queries() -> dict:
    return {name: run for module in _MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in module.ORACLE.items()}
