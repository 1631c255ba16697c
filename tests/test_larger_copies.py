"""Queries on copies of the smallest tables with shifted keys, against their SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import TABLES, duck, rows
from plumbline import queries
from plumbline.functions.exprs import weighted_mean

DIR = "/root/testdata/sf0.001"
SHIFTS = {"supplier": {"s_suppkey": 1007}, "lineitem": {"l_suppkey": 1007, "l_orderkey": 100_003}, "customer": {"c_custkey": 10_007}, "orders": {"o_orderkey": 100_003, "o_custkey": 10_007}}


def copied(folder, times=3):
    con = duckdb.connect()
    for t in TABLES:
        shifts = SHIFTS.get(t, {})
        # prices without cents: sums of doubles that end in a half are rounded by the order in which SQL adds them
        whole = ", floor(l_extendedprice)::DOUBLE AS l_extendedprice" if t == "lineitem" else ""
        kept = "* REPLACE (" + ", ".join(f"({k} + i * {v})::BIGINT AS {k}" for k, v in shifts.items()) + whole + ")" if shifts else "*"
        con.execute(f"COPY (SELECT {kept} FROM '{DIR}/{t}.parquet'{f', range({times}) AS r(i)' if shifts else ''}) TO '{folder}/{t}.parquet' (FORMAT parquet)".replace("* REPLACE", "* EXCLUDE (i) REPLACE" if shifts else "*"))
    return str(folder)


@pytest.fixture(scope="module")
def larger(tmp_path_factory):
    return copied(tmp_path_factory.mktemp("copies"))


def same(spark, name, folder):
    df, cur = queries.QUERIES[name](spark, folder), duck(folder).execute(queries.SQL[name])
    names = [c[0] for c in cur.description]
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())


def test_teams_of_one_name_are_told_apart_by_key(spark, larger):
    """Copies of suppliers keep their names; a team's candidates are those of its own key, in at most four even years."""
    from plumbline.queries.clusters import _teams

    found = _teams(lambda n: spark.read.parquet(f"{larger}/{n}.parquet")).agg(F.max("sportmonks_candidate_count")).first()[0]
    assert 0 < found <= 4


def test_weights_have_their_exact_sum(spark):
    """Added one by one, these weights give 0.9999999999999999, and a mean of 0.25 falls above a threshold of 0.25."""
    ws = [0.35, 0.35, 0.15, 0.075, 0.075]
    x = spark.range(1).select(*[F.lit(v).alias(f"p{i}") for i, v in enumerate((0.5, 0.0, 0.5, 0.0, 0.0))])
    got = x.select(weighted_mean([(f"p{i}", w) for i, w in enumerate(ws)]).alias("m")).first()["m"]
    assert got == (0.5 * 0.35 + 0.5 * 0.15) / math.fsum(ws) == 0.25


def test_candidates_of_a_hot_key_are_neither_sorted_nor_sent(spark):
    """Pairs are as many as the product of a key's rows: what passes between tasks and into sorts is a row a left row."""
    from plumbline.operators.matching import best_candidate

    left = spark.range(0, 200, 1, 4).select(F.col("id"), F.lit("k").alias("k"), (F.col("id") * 1.0).alias("b"))
    right = spark.range(300).select(F.col("id").alias("other"), F.lit("k").alias("k"), (F.col("id") % 150 * 1.0).alias("o"))
    out = best_candidate(left, right, "k", "id", "other", F.abs(F.col("b") - F.col("o")), 10.0, ["o"])
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [p for p in plan if "SortAggregate" in p and "_score" in p]  # pairs aren't sorted: those that are have the lowest score
    got = {r["id"]: r for r in out.collect()}
    assert all(got[i]["other"] == i and got[i]["match_score"] == 0 and got[i]["candidate_count"] == 300 for i in range(150))  # ties go to the smaller id
    assert got[159]["match_status"] == "matched" and got[159]["other"] == 149 and got[160]["match_status"] == "low_confidence" and got[160]["o"] is None
