"""Logical types, table declarations and schema lineage."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T


@dataclass(frozen=True)
class SqlType:
    name: str
    precision: int = 0
    scale: int = 0

    def __str__(self) -> str:
        return f"DECIMAL({self.precision}, {self.scale})" if self.name == "DECIMAL" else self.name

    @property
    def signed(self) -> bool:
        return self.name in SIGNED

    @property
    def unsigned(self) -> bool:
        return self.name in UNSIGNED

    @property
    def integer(self) -> bool:
        return self.signed or self.unsigned

    @property
    def floating(self) -> bool:
        return self.name in FLOATS

    @property
    def numeric(self) -> bool:
        return self.integer or self.floating or self.name == "DECIMAL"

    @property
    def text(self) -> bool:
        return self.name in ("STRING", "SYMBOL")

    def spark(self) -> T.DataType:
        return T.DecimalType(self.precision, self.scale) if self.name == "DECIMAL" else _SPARK[self.name]

    def range(self) -> tuple[int, int] | None:
        """Of unsigned types, which Spark holds in wider ones."""
        return (0, 2 ** int(self.name[4:]) - 1) if self.unsigned else None


SIGNED, UNSIGNED, FLOATS = ("INT8", "INT16", "INT32", "INT64"), ("UINT8", "UINT16", "UINT32", "UINT64"), ("FLOAT32", "FLOAT64")
_SPARK = {
    "BOOL": T.BooleanType(), "INT8": T.ByteType(), "INT16": T.ShortType(), "INT32": T.IntegerType(), "INT64": T.LongType(),
    "UINT8": T.ShortType(), "UINT16": T.IntegerType(), "UINT32": T.LongType(), "UINT64": T.DecimalType(20, 0),
    "FLOAT32": T.FloatType(), "FLOAT64": T.DoubleType(), "TIMESTAMP_NS": T.LongType(), "DATE": T.DateType(),
    "SYMBOL": T.StringType(), "STRING": T.StringType(), "BINARY": T.BinaryType(), "UUID": T.BinaryType(),
}
BOOL, INT64, FLOAT64, TIMESTAMP, DATE, STRING, SYMBOL, BINARY, UUID = (SqlType(x) for x in ("BOOL", "INT64", "FLOAT64", "TIMESTAMP_NS", "DATE", "STRING", "SYMBOL", "BINARY", "UUID"))


def decimal(precision: int, scale: int) -> SqlType:
    if not (1 <= precision <= 38 and 0 <= scale <= precision):
        raise ValueError(f"DECIMAL({precision}, {scale}) is out of range")
    return SqlType("DECIMAL", precision, scale)


def common(a: SqlType, b: SqlType) -> SqlType | None:
    """The type both widen to without loss: within signed, within unsigned, between floats; else only equal types."""
    if a == b:
        return a
    for family in (SIGNED, UNSIGNED, FLOATS):
        if a.name in family and b.name in family:
            return max(a, b, key=lambda x: family.index(x.name))
    return None


def of_spark(t: T.DataType) -> SqlType:
    """For tables that were not declared here; microsecond timestamps become TIMESTAMP_NS."""
    if isinstance(t, T.DecimalType):
        return decimal(t.precision, t.scale)
    names = {"boolean": "BOOL", "tinyint": "INT8", "smallint": "INT16", "int": "INT32", "bigint": "INT64", "float": "FLOAT32", "double": "FLOAT64", "date": "DATE", "string": "STRING", "binary": "BINARY", "timestamp": "TIMESTAMP_NS", "timestamp_ntz": "TIMESTAMP_NS"}
    if t.simpleString() not in names:
        raise ValueError(f"{t.simpleString()} has no logical type")
    return SqlType(names[t.simpleString()])


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: SqlType
    nullable: bool = True


@dataclass(frozen=True)
class TableSpec:
    """Columns and roles.  bucket_ns: width of the partitioning time bucket."""

    name: str
    columns: tuple[ColumnSpec, ...]
    event_time: str
    order_key: tuple[str, ...] = ()
    shard_key: tuple[str, ...] = ()
    dedup_key: tuple[str, ...] = ()
    bucket_ns: int = 86_400_000_000_000
    retention_ns: int = 0
    history_ns: int = 0
    lateness_ns: int = 0
    version: int = 1
    ids: tuple[int, ...] = field(default=())

    def __post_init__(self):
        names = [c.name for c in self.columns]
        if len(set(names)) != len(names):
            raise ValueError("column names repeat")
        time = self.column(self.event_time)
        if time.type != TIMESTAMP or time.nullable:
            raise ValueError("EVENT TIME takes a TIMESTAMP_NS column that is NOT NULL")
        for role in (self.order_key, self.shard_key, self.dedup_key):
            if len(set(role)) != len(role):
                raise ValueError("a key repeats a column")
            for c in role:
                self.column(c)
        if self.dedup_key and not set(self.shard_key) <= set(self.dedup_key):
            raise ValueError("DEDUP KEY must hold the SHARD KEY columns")
        if not self.ids:
            object.__setattr__(self, "ids", tuple(range(1, len(names) + 1)))

    def column(self, name: str) -> ColumnSpec:
        for c in self.columns:
            if c.name == name:
                return c
        raise ValueError(f"no column {name}")

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type.spark(), c.nullable, {"tidemark.type": str(c.type)}) for c in self.columns])


class Lineage:
    """Versions of a table: columns are only added, nullable, at the end; names and ids are never given to others."""

    def __init__(self, first: TableSpec):
        self.versions = [first]

    def evolve(self, *added: ColumnSpec) -> TableSpec:
        last = self.versions[-1]
        taken = {c.name for v in self.versions for c in v.columns}
        for c in added:
            if c.name in taken:
                raise ValueError(f"the name {c.name} was used before")
            if not c.nullable:
                raise ValueError("an added column must be nullable")
        top = max(last.ids)
        new = replace(last, columns=last.columns + added, version=last.version + 1, ids=last.ids + tuple(range(top + 1, top + 1 + len(added))))
        self.versions.append(new)
        return new

    def project(self, df, spec: TableSpec | None = None):
        """Rows of any ancestor, with NULL for columns added since."""
        from pyspark.sql import functions as F

        spec = spec or self.versions[-1]
        return df.select(*[(F.col(c.name) if c.name in df.columns else F.lit(None)).cast(c.type.spark()).alias(c.name) for c in spec.columns], *[x for x in df.columns if x.startswith("_")])
