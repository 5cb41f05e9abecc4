"""The engine's queries: QUERIES by name, and SQL for those that SQL can express."""

from . import grid, layers, models, records, reports, trends, validation
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "grid", "layers", "models", "records", "reports", "trends", "validation"]
