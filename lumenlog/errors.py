"""Errors that the engine raises for bad queries."""


class QueryError(ValueError):
    """A query, pattern or option that can't be understood."""
