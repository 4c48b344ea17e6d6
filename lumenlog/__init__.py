"""A PySpark-native analytics engine for logs: token-aware search and a pipeline query language."""

from lumenlog.errors import QueryError
from lumenlog.plans.engine import Log, Result

__all__ = ["Log", "QueryError", "Result"]
