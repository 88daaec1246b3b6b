"""Exceptions raised before a plan reaches Spark."""


class PlinthError(Exception):
    """Base of all engine errors."""


class SchemaError(PlinthError):
    """A declared schema is inconsistent."""


class ParseError(PlinthError):
    """The query text is not in the dialect."""


class PlanError(PlinthError):
    """The query is well formed but cannot be planned on these tables."""


class IngestError(PlinthError):
    """A source or a batch does not satisfy its schema."""
