"""The library's own queries by name, and their SQL."""

from __future__ import annotations

from pathloom.catalog import imports, network, records, service, tracks  # noqa: F401  they register their queries
from pathloom.catalog.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
