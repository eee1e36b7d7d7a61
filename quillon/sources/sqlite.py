"""A Python data source over tables of SQLite files, read in ranges of row ids. Filters that SQLite decides as Spark does are answered there.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite").schema("...").option("path", p).option("table", "runs").load()
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringStartsWith,
)
from pyspark.sql.types import StructType

from quillon import schemas


class RowRange(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        super().__init__((low, high))
        self.low, self.high = low, high


_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def condition(f: Filter, types: dict[str, str]) -> tuple[str, list] | None:
    """A filter as SQL with its values, or None where SQLite may decide otherwise: it compares numbers and texts as Spark does, as long
    as a column has one kind of values, which the type that it is read as stands for."""
    if isinstance(f, Not):
        inner = condition(f.child, types)
        return inner and (f"NOT ({inner[0]})", inner[1])
    name = f.attribute[0] if len(f.attribute) == 1 else None
    if name not in types:
        return None
    fits = lambda v: isinstance(v, str) if types[name] == "string" else isinstance(v, int) and not isinstance(v, bool) if types[name] in ("int", "bigint") else False
    if isinstance(f, (IsNull, IsNotNull)):
        return f"{name} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []
    if isinstance(f, In):
        values = [v for v in f.value if v is not None]
        return (f"{name} IN ({', '.join('?' * len(values))})", values) if values and len(values) == len(f.value) <= 500 and all(map(fits, values)) else None
    if not fits(f.value):
        return None
    if isinstance(f, EqualNullSafe):
        return f"{name} IS ?", [f.value]
    if isinstance(f, StringStartsWith):
        return f"substr({name}, 1, ?) = ?", [len(f.value), f.value]
    return (f"{name} {_COMPARED[type(f)]} ?", [f.value]) if type(f) in _COMPARED else None


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.table = options["path"], options["table"]
        self.parts = int(options.get("partitions", "4"))
        self.columns = [f.name for f in schema.fields]
        if not all(c.replace("_", "").isalnum() for c in [self.table, *self.columns]):
            raise ValueError("names of tables and columns are letters, digits and underscores")
        self.types = {f.name: f.dataType.simpleString() for f in schema.fields}
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the filters that SQLite answers; gives back the others."""
        for f in filters:
            sql = condition(f, self.types)
            if sql is None:
                yield f
            else:
                self.where.append(sql)

    def connect(self) -> object:
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[RowRange]:
        with self.connect() as c:
            low, high = c.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {self.table}").fetchone()
        step = max(1, -(-(high - low + 1) // self.parts))
        return [RowRange(a, min(a + step, high + 1)) for a in range(low, high + 1, step)] or [RowRange(0, 0)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        with self.connect() as c:
            where = " AND ".join(["rowid >= ?", "rowid < ?", *(sql for sql, _ in self.where)])
            values = [partition.low, partition.high, *(v for _, own in self.where for v in own)]
            yield from c.execute(f"SELECT {', '.join(self.columns)} FROM {self.table} WHERE {where}", values)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(dict(self.options), schema)


def table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else filters are never offered to the source
    return spark.read.format("sqlite").schema(schema).option("path", path).option("table", name).load()


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records of a registry: the key columns, and the rest from the JSON of each row."""
    rows = table(spark, path, "runs", "target string, handle string, data string, submitted_at string")
    r = rows.withColumn("_r", F.from_json("data", schemas.RUN_RECORD))
    return schemas.with_defaults(r.select("target", "handle", "submitted_at", *[F.col(f"_r.{c}").alias(c) for c in ("kind", "script", "args", "git_sha", "dirty", "fetch_path", "name", "state", "exit_code", "verdict", "reported")]), "run_record")


def hosts(spark: SparkSession, path: str) -> DataFrame:
    """Host setups, newest probed first."""
    return table(spark, path, "hosts", "alias string, facts string, probed_at string").orderBy(F.col("probed_at").desc(), "alias")


def history(spark: SparkSession, path: str) -> DataFrame:
    rows = table(spark, path, "history", "id long, data string").withColumn("_h", F.from_json("data", schemas.HISTORY_EVENT))
    return rows.select("id", "_h.*")
