"""The registered queries: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from granary.plans import changes, columns, companies, grounded, lists, more, responses, segments, signals, synthesis  # noqa: F401
from granary.plans.registry import REGISTRY
from granary.plans import details  # noqa: F401,E402  (reads queries of the others)


def queries() -> dict:
    return {name: query for name, (query, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
