"""Tables of an existing SQLite store as a Spark data source, split by ranges of rowids."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DataType, DoubleType, LongType, StringType, StructField, StructType

KINDS: dict[str, DataType] = {"INT": LongType(), "REAL": DoubleType(), "FLOA": DoubleType(), "DOUB": DoubleType(), "BLOB": BinaryType()}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class SqliteTable(DataSource):
    """format("sqlitetable"): options path, table and partitions; the file is opened for reading only."""

    @classmethod
    def name(cls) -> str:
        return "sqlitetable"

    def schema(self) -> StructType:
        with _open(self.options["path"]) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"there is no table {self.options['table']}")
        kind = lambda declared: next((k for name, k in KINDS.items() if name in declared.upper()), StringType())
        return StructType([StructField(name, kind(declared)) for _, name, declared, *_ in columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.wanted, self.fields = options["path"], options["table"], int(options.get("partitions", "8")), schema.fields

    def partitions(self) -> list[_Rows]:
        with _open(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return []
        step = -(-(high - low + 1) // self.wanted)
        return [_Rows(at, min(high, at + step - 1)) for at in range(low, high + 1, step)]

    def read(self, partition: _Rows | None) -> Iterator[tuple]:
        if partition is None:  # what Spark makes of no partitions
            return
        names = ", ".join(_quoted(f.name) for f in self.fields)
        as_kind = [_cast(f.dataType) for f in self.fields]
        db = _open(self.path)
        try:
            for row in db.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.first, partition.last)):
                yield tuple(None if x is None else cast(x) for cast, x in zip(as_kind, row))
        finally:
            db.close()


def _cast(kind: DataType):
    return {LongType: int, DoubleType: float, BinaryType: lambda x: x.encode() if isinstance(x, str) else bytes(x)}.get(type(kind), lambda x: x.decode() if isinstance(x, bytes) else str(x))


def read_table(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    """A table of a SQLite file that all executors can reach; lifecycle.decode_rows() makes typed memories of its rows."""
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlitetable").option("path", path).option("table", table).option("partitions", partitions).load()


def unpack_vector(blob: Column) -> Column:
    """A blob of little-endian 32-bit floats as an array; null for null, an error for a length that is no multiple of four."""
    digits = F.hex(blob)
    n = F.octet_length(blob)

    def one(i: Column) -> Column:
        """Sign, exponent and fraction from the eight digits of one value, its bytes in reverse."""
        pair = lambda k: F.substr(digits, (i * 8 + (2 * k + 1)).cast("int"), F.lit(2))
        bits = F.conv(F.concat(pair(3), pair(2), pair(1), pair(0)), 16, 10).cast("long")
        sign = F.when(bits >= 2**31, -1.0).otherwise(1.0)
        power = F.shiftright(bits, 23).bitwiseAND(255)
        rest = bits.bitwiseAND(2**23 - 1).cast("double")
        plain = F.when(power == 0, rest * 2.0**-149).otherwise((rest * 2.0**-23 + 1) * F.pow(F.lit(2.0), (power - 127).cast("double")))
        odd = F.when(rest == 0, sign * float("inf")).otherwise(F.lit(float("nan")))
        return F.when(power == 255, odd).otherwise(sign * plain).cast("float")

    whole = F.when(n % 4 == 0, n.cast("long")).otherwise(F.raise_error(F.lit("a vector's blob must hold whole floats")).cast("long"))
    some = F.transform(F.sequence(F.lit(0).cast("long"), (whole / 4).cast("long") - 1), one)
    return F.when(blob.isNotNull(), F.when(n == 0, F.array().cast("array<float>")).otherwise(some))
