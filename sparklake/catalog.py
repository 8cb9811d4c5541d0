"""All registered queries of the library and their DuckDB oracles."""

from __future__ import annotations

from sparklake.plans import REGISTRIES


def queries() -> dict:
    return {name: q.run for reg in REGISTRIES for name, q in reg.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for reg in REGISTRIES for name, q in reg.items() if q.sql}
