"""The pivot join by classes of time against the join in full."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import duck
from plumbline.operators import matching
from plumbline.operators.nearest_in_time import nearest_in_time
from plumbline.queries import QUERIES, SQL
from tests_rows import same_as_sql

DIR = "/root/testdata/sf0.001"
BASE = {"a": 1.0, "b": 2.0}
MULTIPLIERS = {"A": {"a": 1.5, "b": 0.1}}


def sides(spark):
    """Years, seasons, clubs and roles with nulls; values that only one side has; equal places."""
    rng = np.random.default_rng(4)
    some = lambda v: None if v == 0 else int(v)

    def rows(n, first, most):
        return [(first + j, [None, "A", "B"][int(r)], some(y), None if s == 0 else f"s{s}", None if c == 0 else f"c{c}", *map(float, x)) for j, (r, y, s, c, x) in enumerate(zip(rng.integers(0, 3, n), rng.integers(0, most, n), rng.integers(0, most, n), rng.integers(0, 4, n), rng.integers(0, 12, (n, 2))))]

    q = spark.createDataFrame(rows(150, 0, 6), "q long, role string, qy int, qs string, qc string, q1 double, q2 double")
    i = spark.createDataFrame(rows(400, 1000, 5), "i long, kind string, iy int, iss string, ic string, i1 double, i2 double")
    return q.repartition(3), i.repartition(2)


def found(q, i, window, **more):
    c = F.col
    return nearest_in_time(q, i, "q", "i", ["q1", "q2"], ["i1", "i2"], list(BASE.values()), matching.role_weights(MULTIPLIERS, list(BASE), BASE), "role", (c("qy"), c("qs")), (c("iy"), c("iss")), c("qc"), c("ic"), window, 4, **more)


@pytest.mark.parametrize("window", [0, 1])
def test_equals_the_join_in_full(spark, window):
    q, i = sides(spark)
    pairs = matching.near_in_time(q, i, "qy", "iy", "qs", "iss", window)
    own = F.coalesce(F.col("qc") == F.col("ic"), F.lit(False)) & F.col("qs").eqNullSafe(F.col("iss"))
    distance = matching.weighted_distance([("q1", "i1"), ("q2", "i2")], "role", MULTIPLIERS, list(BASE), BASE)
    want = matching.top_k(pairs.where(~own).withColumn("distance", distance), "q", "distance", "i", 4)
    columns = ["q", "i", "distance", "match_rank"]
    assert sorted(map(tuple, found(q, i, window).select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_leaves_to_the_join_what_it_can_not_hold(spark):
    q, i = sides(spark)
    assert found(q, i, 0, room=100) is None and found(q, i, 0, cells=3) is None
    assert found(q, i.union(i.limit(1).withColumn("i1", F.lit(None).cast("double"))), 0) is None
    assert found(q, i.limit(0), 0).count() == 0


def test_query_makes_no_pairs_in_a_join(spark, monkeypatch):
    monkeypatch.setattr(matching, "near_in_time", lambda *a, **k: pytest.fail("a join of all pairs of a time"))
    same_as_sql(QUERIES["realistic_matches"](spark, DIR), duck(DIR).execute(SQL["realistic_matches"]))
