"""SQLite files as a partitioned source: tasks read ranges of row ids, SQLite itself projects and filters.

Spark ships the file to every executor (``addFile``), so it needn't lie in a shared folder.  The driver asks SQLite for the
columns' types (a pass over the whole table) and for the bounds of equally large ranges; no row passes the driver.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_ARROW = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "binary": pa.binary()}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def columns_of(con: sqlite3.Connection, table: str) -> list[str]:
    return [r[1] for r in con.execute(f"PRAGMA table_info({quoted(table)})")]


def types_of(con: sqlite3.Connection, table: str, columns: Sequence[str]) -> dict[str, tuple[str, bool]]:
    """Of each column the type that holds all its values, and whether SQLite compares them as Spark does: texts alone, or
    numbers alone."""
    if not columns:
        return {}
    kinds = ("text", "blob", "real", "integer")
    cells = ", ".join(f"coalesce(max(typeof({quoted(c)}) = '{k}'), 0)" for c in columns for k in kinds)
    found = con.execute(f"SELECT {cells} FROM {quoted(table)}").fetchone()
    out = {}
    for i, c in enumerate(columns):
        text, blob, real, integer = found[4 * i : 4 * i + 4]
        kind = "string" if text else "binary" if blob else "double" if real else "bigint" if integer else "string"
        out[c] = (kind, (text or real or integer) and not blob and not (text and (real or integer)))
    return out


class Range(InputPartition):
    """Row ids from ``low`` up to, but without, ``high`` (None: no bound)."""

    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.schema = options, schema
        self.conditions: list[str] = []
        self.values: list = []

    def partitions(self) -> Sequence[InputPartition]:
        rows = int(self.options["rows"])
        with opened(self.options["path"]) as con:
            table = quoted(self.options["table"])
            try:
                n = con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
                bounds = [r[0] for r in con.execute(f"SELECT min(id) FROM (SELECT rowid AS id, ntile(?) OVER (ORDER BY rowid) AS part FROM {table}) GROUP BY part ORDER BY 1", (max(1, -(-n // rows)),))]
            except sqlite3.OperationalError:  # views and tables without row ids are one range
                bounds = []
        edges = [None, *bounds[1:], None]
        return [Range(a, b) for a, b in zip(edges[:-1], edges[1:])]

    def statement(self, part: Range) -> tuple[str, list]:
        columns = ", ".join(f"rowid AS {quoted(c)}" if c == self.options.get("rowid") else quoted(c) for c in self.schema.names) or "1"
        tests, values = list(self.conditions), list(self.values)
        for sign, v in ((">=", part.low), ("<", part.high)):
            if v is not None:
                tests.append(f"rowid {sign} ?")
                values.append(v)
        return f"SELECT {columns} FROM {quoted(self.options['table'])}" + (f" WHERE {' AND '.join(tests)}" if tests else ""), values

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        path = self.options["path"]
        shipped = SparkFiles.get(os.path.basename(path))
        kinds = [f.dataType.simpleString() for f in self.schema.fields]
        fixed = {"string": lambda v: v if isinstance(v, str) else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v), "double": float}
        with opened(shipped if os.path.exists(shipped) else path) as con:
            cursor = con.execute(*self.statement(partition))
            while rows := cursor.fetchmany(10_000):
                columns = [[None if v is None else fixed.get(k, lambda v: v)(v) for v in c] for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds)], names=self.schema.names)


class FilteringReader(SqliteReader):
    """Spark asks for filters only where the setting is on, and refuses readers that take them where it isn't."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons that SQLite makes as Spark does go into the statement; the others are given back."""
        with opened(self.options["path"]) as con:
            plain = {c for c, (_, fine) in types_of(con, self.options["table"], columns_of(con, self.options["table"])).items() if fine}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == self.options.get("rowid"):
                column = "rowid"
            elif name in plain:
                column = quoted(name)
            else:
                yield f
                continue
            if type(f) in _SIGNS and isinstance(f.value, (int, float, str)):
                self.conditions.append(f"{column} {_SIGNS[type(f)]} ?")
                self.values.append(f.value)
            elif isinstance(f, In) and all(isinstance(v, (int, float, str)) for v in f.value):
                self.conditions.append(f"{column} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif isinstance(f, (IsNull, IsNotNull)):
                self.conditions.append(f"{column} IS {'NOT ' * isinstance(f, IsNotNull)}NULL")
            else:
                yield f


class SqliteSource(DataSource):
    """Format ``sqlite``; options ``path``, ``table``, ``columns`` (tab-separated; all by default), ``rowid`` (name for the row id),
    ``rows`` (of a range) and ``filters`` (whether SQLite filters, as the setting of Spark is)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _settings(self) -> dict[str, str]:
        return {"rows": "100000"} | {k: self.options[k] for k in ("path", "table", "columns", "rowid", "rows") if self.options.get(k)}

    def schema(self) -> T.StructType:
        s = self._settings()
        with opened(s["path"]) as con:
            have = columns_of(con, s["table"])
            use = [c for c in s["columns"].split("\t") if c in have] if "columns" in s else have
            kinds = types_of(con, s["table"], use)
        types = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "binary": T.BinaryType()}
        own = [T.StructField(s["rowid"], T.LongType())] if "rowid" in s else []
        return T.StructType([*own, *[T.StructField(c, types[kinds[c][0]]) for c in use]])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return (FilteringReader if self.options.get("filters") == "true" else SqliteReader)(self._settings(), schema)


def read_sqlite(spark: SparkSession, path: str, table: str, columns: Sequence[str] | None = None, rowid: str | None = None, rows: int = 100_000) -> DataFrame:
    """A table of a SQLite file, in ranges of about ``rows`` row ids.

    ``columns`` that the table lacks are left out; ``rowid`` adds the file's row id under that name.  Integers and reals in
    one column are doubles, numbers beside texts are texts, a column without values is one of texts.  Filters reach
    SQLite where ``spark.sql.python.filterPushdown.enabled`` is set.
    """
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    with opened(path) as con:
        if not columns_of(con, table):
            raise FileNotFoundError(f"{path} has no table {table}")
    spark.sparkContext.addFile(path)
    spark.dataSource.register(SqliteSource)
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    source = spark.read.format("sqlite").option("filters", filters).option("path", os.path.abspath(path)).option("table", table).option("rows", rows)
    if columns is not None:
        source = source.option("columns", "\t".join(columns))
    return (source.option("rowid", rowid) if rowid else source).load()
