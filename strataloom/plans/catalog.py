"""Every operator of the library as a query on the driver tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from .registry import QUERIES, SQL

for _name in ("scalars", "filters", "joins", "aggregates", "ranking", "sets", "composites", "checks", "inputs", "runs"):
    import_module(f"{__package__}.{_name}")


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
