"""The read queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import serve
from plumbline.queries.registry import query


@query("search_players", "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name ILIKE '%CUSTOMER#%1%' ORDER BY c_acctbal DESC NULLS LAST, c_custkey DESC NULLS LAST LIMIT 20")
def search_players(t):
    return serve.search(t("customer"), ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"], {"c_mktsegment": "BUILDING", "c_nationkey": None}, {"c_name": "CUSTOMER#%1"}, [("c_acctbal", "desc"), ("c_custkey", "desc")], serve.checked(20))


@query("search_either_column", "SELECT p_partkey, p_name, p_type FROM part WHERE (p_name ILIKE '%a%' OR p_type ILIKE '%a%') AND p_size = 5 ORDER BY p_partkey ASC NULLS FIRST LIMIT 50")
def search_either_column(t):
    return serve.search(t("part"), ["p_partkey", "p_name", "p_type"], {"p_size": 5}, {("p_name", "p_type"): "a"}, [("p_partkey", "asc")], serve.clamp(500))


@query("search_worst_first", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice ASC NULLS FIRST, o_orderkey DESC NULLS LAST LIMIT 1")
def search_worst_first(t):
    return serve.search(t("orders"), ["o_orderkey", "o_totalprice"], {"o_orderstatus": "F"}, None, [("o_totalprice", "asc"), ("o_orderkey", "desc")], serve.clamp(0))


@query("player_detail", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC")
def player_detail(t):
    return serve.detail(t("orders"), "o_custkey", 7, [("o_orderdate", "desc")]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("team_detail", "SELECT * FROM supplier WHERE s_suppkey = 3")
def team_detail(t):
    return serve.detail(t("supplier"), "s_suppkey", 3, limit=1)


@query("matches_of_player", "SELECT c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) AS style_distance, 100 - abs(c_acctbal - s_acctbal) / 200 AS match_percentage FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_custkey = 5 ORDER BY match_percentage DESC, style_distance LIMIT 20")
def matches_of_player(t):
    m = t("customer").join(t("supplier"), F.col("c_nationkey") == F.col("s_nationkey")).select("c_custkey", "s_suppkey", F.abs(F.col("c_acctbal") - F.col("s_acctbal")).alias("style_distance"))
    return serve.matches_of(m.withColumn("match_percentage", 100 - F.col("style_distance") / 200), "c_custkey", 5)


@query("clusters_by_role", "SELECT p_brand, p_size, count(*) AS n FROM part WHERE p_brand = 'Brand#11' GROUP BY p_brand, p_size ORDER BY p_brand, p_size")
def clusters_by_role(t):
    return serve.search(t("part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n")), None, {"p_brand": "Brand#11"}, None, [("p_brand", "asc"), ("p_size", "asc")])


@query("first_per_group", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST) AS r FROM customer) WHERE r <= 6")
def first_per_group(t):
    return serve.first_per_group(t("customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", "c_acctbal")


@query("fit_bands", "SELECT c_custkey, CASE WHEN (c_acctbal + 1000) / 110 >= 70 THEN 'strong' WHEN (c_acctbal + 1000) / 110 >= 50 THEN 'medium' WHEN c_acctbal IS NOT NULL THEN 'weak' END AS band FROM customer")
def fit_bands(t):
    return t("customer").select("c_custkey", serve.fit_band((F.col("c_acctbal") + 1000) / 110).alias("band"))


@query("dimension_listing", "SELECT n_name AS dimension, n_nationkey / 10.0::DOUBLE AS global_normalized_weight FROM nation ORDER BY dimension")
def dimension_listing(t):
    return serve.dimensions(t("nation").select(F.col("n_name").alias("dimension"), (F.col("n_nationkey") / 10.0).alias("global_normalized_weight")))


@query("quality_document", "SELECT 'ml_team_player_matching' AS scope, 'tables' AS source, 5::BIGINT AS n_metrics, 25::BIGINT AS first_summary")
def quality_document(t):
    tables = {"ml_experiment_summary": t("nation").agg(F.count(F.lit(1)).alias("n")), "ml_model_quality": t("region").select(F.col("r_name").alias("dimension"))}
    return serve.model_quality(tables).select("scope", "source", F.size("metrics").cast("long").alias("n_metrics"), F.col("summary.n").alias("first_summary"))


@query("row_ids", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS player_row_id FROM customer")
def row_ids(t):
    from plumbline.sources.io import with_row_id

    return with_row_id(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], "player_row_id", 8).select("c_custkey", F.col("player_row_id").cast("long").alias("player_row_id"))


@query("without_empty_columns", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def without_empty_columns(t):
    from plumbline.sources.io import drop_empty

    return drop_empty(t("nation").withColumn("nothing", F.lit(None).cast("double")))


@query("display_columns", "SELECT c_custkey AS player_id, c_name AS full_name, c_acctbal AS attack_score_pct, c_nationkey AS games_played FROM customer")
def display_columns(t):
    from plumbline.functions.names import display_columns as shown

    c = t("customer").select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("full_name"), F.col("c_acctbal").alias("attack_score_pct"), F.col("c_acctbal").alias("attack_score"), F.col("c_nationkey").alias("games_played"), F.col("c_acctbal").alias("goals_per_90_overall"))
    return c.select(*shown(c.columns))


@query("rounded_numbers", "SELECT c_custkey, round_even(c_acctbal * 1.0, 0) + 0.0 AS value FROM customer")
def rounded_numbers(t):
    from plumbline.sources.io import round_numbers

    return round_numbers(t("customer").select("c_custkey", F.col("c_acctbal").alias("value")), 0)


@query("sample_copy", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def sample_copy(t):
    from plumbline.sources.io import sample_tables

    ids = t("customer").where("c_nationkey = 3").select("c_custkey")
    return sample_tables({"orders": t("orders")}, {"orders": "o_custkey"}, ids)["orders"].select("o_orderkey", "o_custkey")


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(
    "lookup_by_either_id",
    f"""
SELECT 'part' AS looked_up, {", ".join(_LINE)} FROM lineitem WHERE l_partkey = (SELECT max(l_partkey) FROM lineitem)
UNION ALL SELECT 'supplier', {", ".join(_LINE)} FROM lineitem WHERE l_suppkey = (SELECT max(l_suppkey) FROM lineitem)
""",
)
def lookup_by_either_id(t):
    """All lines written along a curve over part, supplier and price; those of one part and of one supplier from it."""
    from plumbline.sources.curve import write_curve
    from plumbline.sources.scratch import new_path

    lines = t("lineitem").select(*_LINE)
    path = new_path(lines.sparkSession, "curve")
    write_curve(lines, path, ["l_partkey", "l_suppkey", "l_extendedprice"], ["l_partkey", "l_suppkey"])
    table = lines.sparkSession.read.schema(lines.schema).parquet(path)
    part, supplier = lines.agg(F.max("l_partkey"), F.max("l_suppkey")).first()
    found = [table.where(F.col(c) == v).select(F.lit(k).alias("looked_up"), *_LINE) for c, v, k in (("l_partkey", part, "part"), ("l_suppkey", supplier, "supplier"))]
    return found[0].unionByName(found[1])
