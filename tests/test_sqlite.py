"""SQLite tables by ranges of row ids."""

import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, StringStartsWith

from plumbline.sources.sqlite import FilteringReader, Range, SqliteSource, read_sqlite


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    """The customers in a file, rows with gaps between their ids."""
    path = str(tmp_path_factory.mktemp("db") / "customers.db")
    table = spark.read.parquet("/root/testdata/sf0.01/customer.parquet").select("c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")
    with sqlite3.connect(path) as con:
        con.execute('CREATE TABLE "cust omer" (c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, "o""dd", bare)')
        con.executemany('INSERT INTO "cust omer" (rowid, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, "o""dd") VALUES (?,?,?,?,?,?,?)', [(3 * r[0] if r[0] < 700 else 10**9 + r[0], *r, [1, 2.5, "x", None][r[0] % 4]) for r in map(tuple, table.collect())])
        con.execute("CREATE TABLE flat (k TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID")
        con.execute("INSERT INTO flat VALUES ('a', 1), ('b', NULL)")
        con.execute("CREATE TABLE none (a, b)")
    return path, table


def test_whole_table_by_ranges(spark, customers):
    path, table = customers
    df = read_sqlite(spark, path, "cust omer", rows=100)
    assert df.rdd.getNumPartitions() == 15 and dict(df.dtypes) == {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "bigint", "c_acctbal": "double", "c_mktsegment": "string", 'o"dd': "string", "bare": "string"}
    assert sorted(map(tuple, df.select(*table.columns).collect())) == sorted(map(tuple, table.collect()))
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) - min(sizes) <= 1
    assert {r[0] for r in df.select(F.col('`o"dd`')).distinct().collect()} == {"1", "2.5", "x", None}


def test_projection_and_row_ids(spark, customers):
    path, table = customers
    df = read_sqlite(spark, path, "cust omer", ["c_name", "absent", "c_acctbal"], "r")
    assert df.columns == ["r", "c_name", "c_acctbal"]
    assert df.where("r = 2997 or r = 30").count() == 1 and df.agg(F.max("r")).first()[0] > 10**9
    assert read_sqlite(spark, path, "flat").orderBy("k").collect() == [("a", 1), ("b", None)]
    assert read_sqlite(spark, path, "none").count() == 0
    with pytest.raises(FileNotFoundError):
        read_sqlite(spark, path, "missing").count()
    with pytest.raises(FileNotFoundError):
        read_sqlite(spark, path + "x", "flat")


def test_filters_reach_the_statement(spark, customers):
    path, table = customers
    source = SqliteSource({"path": path, "table": "cust omer", "columns": "c_name\tc_acctbal", "filters": "true"})
    reader = source.reader(source.schema())
    assert isinstance(reader, FilteringReader)
    back = list(reader.pushFilters([GreaterThan(("c_acctbal",), 100.5), In(("c_nationkey",), (1, 2)), IsNotNull(("c_name",)), EqualTo(('o"dd',), "1"), StringStartsWith(("c_name",), "C")]))
    assert back == [EqualTo(('o"dd',), "1"), StringStartsWith(("c_name",), "C")]  # mixed values and other tests stay with Spark
    sql, values = reader.statement(Range(5, 90))
    assert sql == 'SELECT "c_name", "c_acctbal" FROM "cust omer" WHERE "c_acctbal" > ? AND "c_nationkey" IN (?, ?) AND "c_name" IS NOT NULL AND rowid >= ? AND rowid < ?'
    assert values == [100.5, 1, 2, 5, 90]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        test = "c_acctbal > 100.5 and c_nationkey in (1, 2) and c_name like 'Customer%'"
        got = read_sqlite(spark, path, "cust omer", rows=400).where(test).select(*table.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, table.where(test).collect())) != []
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
