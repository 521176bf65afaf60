"""Errors of the engine."""


class StrataError(Exception):
    """Any error of the engine."""


class BadSchema(StrataError):
    """A schema, tier list, grain, origin or retention that cannot be used."""


class SchemaDrift(StrataError):
    """The stored columns differ from the declared ones and do not extend them."""


class NoPolicy(StrataError):
    """The table is not known."""


class CompactError(StrataError):
    """A bucket could not be compacted; nothing was changed."""


class AxisError(BadSchema):
    """The bucket axis is missing or ambiguous."""


class UnsupportedType(StrataError):
    """A file has a type outside the read mapping."""


class MissingFile(StrataError):
    """A file that the manifest names is gone: possible data loss."""


class ImmutableHistory(StrataError):
    """Rows cannot be updated or deleted."""


class Denied(StrataError):
    """The session's role or scope does not allow this."""


class QueryError(StrataError):
    """Outside the InfluxQL subset."""


class LineError(StrataError):
    """A line of line protocol that cannot be read."""

    def __init__(self, line_no: int, message: str):
        super().__init__(f"line {line_no}: {message}")
        self.line_no, self.message = line_no, message
