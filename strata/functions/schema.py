"""Declared schemas: ``"name TYPE, name TYPE"`` to a StructType and its bucket axis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from strata.errors import AxisError, BadSchema, SchemaDrift, UnsupportedType

INTEGER, REAL, TEXT, BLOB = "INTEGER", "REAL", "TEXT", "BLOB"

#: fixed values: a declared type belongs to the first class one of whose words it contains
CLASS_WORDS = (
    (INTEGER, ("TIMESTAMP", "DATETIME")),
    (INTEGER, ("INT",)),
    (TEXT, ("CHAR", "CLOB", "TEXT")),
    (BLOB, ("BLOB",)),
    (REAL, ("REAL", "FLOA", "DOUB")),
)
SPARK_TYPES = {INTEGER: T.LongType(), REAL: T.DoubleType(), TEXT: T.StringType(), BLOB: T.BinaryType()}


@dataclass(frozen=True)
class Column:
    name: str
    declared: str

    @property
    def is_timestamp(self) -> bool:
        return any(w in self.declared.upper() for w in CLASS_WORDS[0][1])

    @property
    def storage(self) -> str:
        said = self.declared.upper()
        if not said:
            return BLOB
        for kind, words in CLASS_WORDS:
            if any(w in said for w in words):
                return kind
        raise BadSchema(f"column {self.name}: type {self.declared!r} is not supported")

    @property
    def spark_type(self) -> T.DataType:
        return T.TimestampType() if self.is_timestamp else SPARK_TYPES[self.storage]


def parse_schema(text: str) -> list[Column]:
    """Columns of a declaration; a column without a type is a BLOB."""
    columns = []
    for part in text.split(","):
        name, _, declared = part.strip().partition(" ")
        name = name.strip("\"`'")
        if not name:
            raise BadSchema(f"empty column in {text!r}")
        columns.append(Column(name, declared.strip()))
        columns[-1].storage  # noqa: B018  raises on what is not supported
    if len({c.name.lower() for c in columns}) < len(columns):
        raise BadSchema("a column is declared twice")
    return columns


def axis_of(columns: list[Column], explicit: str | None = None) -> str:
    """The bucket axis: the named column, else the only timestamp, else an INTEGER ``ts``."""
    if explicit is not None:
        for c in columns:
            if c.name == explicit:
                if c.storage != INTEGER:
                    raise AxisError(f"{explicit} is {c.storage}, not INTEGER or a timestamp")
                return c.name
        raise AxisError(f"no column {explicit}")
    stamps = [c.name for c in columns if c.is_timestamp]
    if len(stamps) == 1:
        return stamps[0]
    if stamps:
        raise AxisError(f"several timestamp columns ({', '.join(stamps)}): name the axis")
    if any(c.name == "ts" and c.storage == INTEGER for c in columns):
        return "ts"
    raise AxisError("no timestamp column and no INTEGER column named ts")


def struct_of(columns: list[Column]) -> T.StructType:
    return T.StructType([T.StructField(c.name, c.spark_type, True) for c in columns])


def series_columns(columns: list[Column], axis: str) -> list[str]:
    """Every column but the axis and the measures (REAL)."""
    return [c.name for c in columns if c.name != axis and c.storage != REAL]


def real_columns(columns: list[Column], axis: str) -> list[str]:
    return [c.name for c in columns if c.name != axis and c.storage == REAL]


def check_drift(stored: list[Column], declared: list[Column]) -> None:
    """The declared columns must be the stored ones or begin them."""
    kinds = lambda cs: [(c.name, c.storage, c.is_timestamp) for c in cs]
    if kinds(stored)[: len(declared)] != kinds(declared):
        raise SchemaDrift(f"stored {[c.name for c in stored]}, declared {[c.name for c in declared]}")


def storage_of(data_type: T.DataType) -> str:
    """The class a file's column is read as; nested and unsigned 64-bit types are refused."""
    if isinstance(data_type, T.BooleanType | T.ByteType | T.ShortType | T.IntegerType | T.LongType | T.TimestampType | T.TimestampNTZType | T.DateType):
        return INTEGER
    if isinstance(data_type, T.FloatType | T.DoubleType):
        return REAL
    if isinstance(data_type, T.StringType):
        return TEXT
    if isinstance(data_type, T.BinaryType):
        return BLOB
    raise UnsupportedType(f"{data_type.simpleString()} has no class")


def declare(schema: T.StructType) -> list[Column]:
    """Columns for an existing DataFrame's schema."""
    names = {INTEGER: "INTEGER", REAL: "REAL", TEXT: "TEXT", BLOB: "BLOB"}
    out = []
    for f in schema.fields:
        stamp = isinstance(f.dataType, T.TimestampType | T.TimestampNTZType)
        out.append(Column(f.name, "TIMESTAMP" if stamp else names[storage_of(f.dataType)]))
    return out
