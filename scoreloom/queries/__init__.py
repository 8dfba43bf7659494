"""All registered queries; importing the modules registers them."""

from scoreloom.queries import aggregates, rows, statistics, tables, modelling  # noqa: F401
from scoreloom.queries.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
