"""All registered queries and their SQL."""

from patronage.registry import (  # noqa: F401  (importing registers)
    aggregates,
    models,
    rows,
    tables,
    windows,
)
from patronage.registry.core import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
