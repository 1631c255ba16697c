"""Tiny hand-made tables with values worked out apart from the engine."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import serve
from plumbline.functions import exprs as x
from plumbline.functions import names
from plumbline.operators import cluster, linalg, matching, profiles, splits, stats
from plumbline.plans import scoring
from plumbline.sources import io


def col(df, name, by="id"):
    return [r[name] for r in df.orderBy(by).collect()]


def near(a, b):
    assert len(a) == len(b)
    for p, q in zip(a, b):
        assert (p is None and q is None) or (p is not None and q is not None and abs(p - q) < 1e-9), (a, b)


@pytest.fixture(scope="module")
def groups(spark):
    data = [(1, "A", 1.0), (2, "A", 2.0), (3, "A", 2.0), (4, "A", 3.0), (5, "A", None), (6, "B", 5.0), (7, "C", 7.0), (8, "C", 7.0), (9, "C", 7.0), (10, None, 4.0), (11, None, 6.0)]
    return spark.createDataFrame(data, "id long, g string, x double")


def test_robust_z(groups):
    out = col(stats.robust_z(groups, {"z": "x"}, ["g"]), "z")
    u = 1.4826 * 0.5
    near(out, [-1 / u, 0.0, 0.0, 1 / u, None, 0.0, 0.0, 0.0, 0.0, -1 / 1.4826, 1 / 1.4826])


def test_robust_z_without_spread(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0), (4, 9.0)], "id long, x double")
    near(col(stats.robust_z(df, {"z": "x"}), "z"), [0.0, 0.0, 0.0, 8 / math.sqrt(12)])


def test_scores_are_bounded_and_rise(spark):
    df = spark.createDataFrame([(i, float(i) ** 2) for i in range(101)], "id long, x double")
    out = col(stats.calibrated_scores(df, {"s": "x"}), "s")
    assert out == sorted(out) and 0 <= out[0] and out[-1] <= 10 and out[50] == 5


def test_z_scores_of_null_keys_are_zero(groups):
    out = col(stats.z_scores(groups, {"z": "x"}, ["g"]), "z")
    s = math.sqrt(0.5)
    near(out, [-1 / s, 0.0, 0.0, 1 / s, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0])


def test_shrink(spark):
    df = spark.createDataFrame([(1, "a", 10.0, 0.0), (2, "a", 20.0, 90.0), (3, "a", 30.0, None), (4, "a", 40.0, -10.0), (5, "b", 1.0, 0.0), (6, None, 3.0, 5.0)], "id long, g string, x double, m double")
    # the median of 0, 90 and 0 is 0, so is b's: k falls back to 1
    out = col(stats.shrink_by_volume(df, {"s": "x"}, "m", ["g"]), "s")
    near(out, [25.0, 90 / 91 * 20 + 1 / 91 * 25, None, 25.0, 1.0, None])


def test_percentile_ranks(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, None), (5, 5.0)], "id long, x double").withColumn("g", F.lit("a"))
    for keys, split in (((), None), (("g",), None), (("g",), True)):
        near(col(stats.percentile_ranks(df, "x", "p", keys, split=split), "p"), [0.25, 0.625, 0.625, None, 1.0])
    near(col(stats.percentile_ranks(df, "x", "p", ["g"], least=5), "p"), [None] * 5)


def test_hierarchy_of_groups(spark):
    rows = [(i, "big" if i < 8 else "small", float(i)) for i in range(15)]
    out = col(stats.hierarchical_percentile(spark.createDataFrame(rows, "id long, g string, x double"), "x", "p", [["g"]], 8), "p")
    near(out[:8], [(i + 1) / 8 * 100 for i in range(8)])
    near(out[8:], [(i + 1) / 15 * 100 for i in range(8, 15)])


def test_first_component(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((40, 3)) @ np.array([[1.0, 0.8, 0.2], [0, 0.5, 0.1], [0, 0, 1.0]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "id long, a double, b double, c double")
    df = df.withColumns({"flat": F.lit(1.0), "none": F.lit(None).cast("double")})
    z = (m - m.mean(0)) / m.std(0)
    v = np.linalg.svd(z)[2][0]
    want = z @ (v if v.sum() >= 0 else -v)
    near(col(linalg.component_scores(df, {"s": [("a", 1.0), ("b", 1.0), ("c", 1.0), ("none", 1.0)]}), "s"), want.tolist())
    near(col(linalg.component_scores(df, {"s": [("a", -0.3)]}), "s"), (-z[:, 0]).tolist())


def test_prune_correlated(spark):
    df = spark.createDataFrame([(float(i), float(2 * i), float(i % 3), 1.0) for i in range(30)], "a double, b double, c double, d double")
    z = cluster.standardised(df, ["a", "b", "c", "d"], "")
    assert linalg.prune_correlated(z, ["a", "b", "c", "d"], {"a": 1.0, "b": 2.0}) == (["b", "c"], {"d": "near_zero_variance", "a": "high_correlation_with_b"})


def test_prune_skips_places(spark):
    """Once a column has gone, as many columns behind a later one aren't compared with it."""
    r = np.random.default_rng(3).standard_normal((60, 3))
    df = spark.createDataFrame([(i, *map(float, (a, 2 * a, b, -b, c))) for i, (a, b, c) in enumerate(r)], "id long, a double, b double, c double, d double, e double")
    z = cluster.standardised(df, ["a", "b", "c", "d", "e"], "")
    # a takes b away; c then starts two places behind itself, at e, so d is never compared with it
    assert linalg.prune_correlated(z, ["a", "b", "c", "d", "e"], {"a": 1.0}) == (["a", "c", "d", "e"], {"b": "high_correlation_with_a"})
    assert linalg.prune_correlated(z, ["c", "d", "a", "e"], {"d": 1.0}) == (["d", "a", "e"], {"c": "high_correlation_with_d"})


def test_kmeans_starts(spark):
    r = np.random.default_rng(5)
    at = np.array([[0.0, 0.0], [8.0, 0.0], [0.0, 8.0], [8.0, 8.0]])
    rows = [(i, *map(float, at[i % 4] + 0.3 * r.standard_normal(2))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    out, facts = cluster.kmeans_scan(df, "id", ["x", "y"], 2, 6)
    assert facts["k"] == 4 and facts["silhouette"] > 0.9
    found = {x["id"]: x["cluster_id"] for x in out.collect()}
    assert len({(i % 4, c) for i, c in found.items()}) == 4


def test_embedding_ranks_and_prunes(spark):
    """Of eight columns, a copy and a constant go; a sentinel and an infinity are missing values."""
    from plumbline.plans import player_style

    r = np.random.default_rng(9).standard_normal((50, 6))
    names = ["goals", "shots", "dribbles", "passes", "xg", "xa"]
    df = spark.createDataFrame([(i, *map(float, v), float(3 * v[0]), 1.0) for i, v in enumerate(r)], "id long, " + ", ".join(f"{n} double" for n in [*names, "twin", "flat"]))
    e = player_style.embed(df, [*names, "twin", "flat"], {"goals": 2.0, "twin": 1.0})
    assert e.gone == {"flat": "near_zero_variance", "twin": "high_correlation_with_goals"} and sorted(e.final) == sorted(names) == sorted(e.kept)
    z = (r - r.mean(0)) / r.std(0)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    want = np.abs(vectors) @ (values / values.sum())
    near([e.loading[n] for n in names], want.tolist())
    share = np.cumsum(np.sort(values)[::-1]) / values.sum()
    assert len(e.dims) == int((share < 0.85).sum()) + 1
    raw = spark.createDataFrame([(1, 90.0, -1.0), (2, 90.0, float("inf")), (3, 90.0, 4.0)], "id long, minutes_played_overall double, goals_per_90_overall double")
    assert col(player_style.cleaned(raw, {"goals"}).select("id", "goals_per_90_overall"), "goals_per_90_overall") == [None, None, 4.0]


def test_profile_with_zero_weights(spark):
    df = spark.createDataFrame([("t", 1.0, 0.0), ("t", 3.0, 0.0), ("u", None, 2.0)], "g string, x double, w double")
    out = {r["g"]: r for r in profiles.weighted_profile(df, ["g"], ["x"], "w").collect()}
    assert (out["t"]["mean__x"], out["t"]["std__x"], out["t"]["p25__x"], out["t"]["feature_coverage"]) == (2.0, 1.0, 1.5, 1.0)
    assert (out["u"]["mean__x"], out["u"]["std__x"], out["u"]["feature_coverage"]) == (None, None, 0.0)


def test_positions_and_seasons(spark):
    df = spark.createDataFrame([(1, "Goalkeeper", "2015/2016"), (2, "FWD", "2015–2016"), (3, " fw ", "Season 2015"), (4, None, ""), (5, "Left Back", "abc"), (6, "mid ", "2015/16")], "id long, p string, s string")
    assert col(df.select("id", x.position_bucket("p").alias("v")), "v") == ["GK", "OTHER", "FWD", "OTHER", "OTHER", "MID"]
    assert col(df.select("id", x.position_bucket("p", fix_fwd=True).alias("v")), "v")[1] == "FWD"
    assert col(df.select("id", x.season_start("s").alias("v")), "v") == [2015, 2015, 2015, None, None, 2015]
    assert col(df.select("id", x.exact_role("p").alias("v")), "v") == ["GK", None, None, None, "DF", None]


def test_name_key(spark):
    df = spark.createDataFrame([(1, "A.F.C. Foo & Bar FC"), (2, "FC Club de"), (3, None)], "id long, s string")
    assert col(df.select("id", x.name_key("s").alias("v")), "v") == ["a f c foo and bar", "", ""]


def test_best_candidate(spark):
    left = spark.createDataFrame([(1, "k", 10.0), (2, "k", 1.0), (3, "", 1.0), (4, "k", None)], "id long, k string, b double")
    right = spark.createDataFrame([(7, "k", 10.0), (6, "k", 10.0), (8, "", 1.0)], "rid long, k string, o double")
    out = matching.best_candidate(left, right, "k", "id", "rid", x.relative_error("b", "o"), 0.25, ["o"]).orderBy("id").collect()
    assert [(r["match_status"], r["rid"], r["candidate_count"]) for r in out] == [("matched", 6, 2), ("low_confidence", None, 2), ("no_name_candidate", None, 0), ("low_confidence", None, 2)]


def test_near_in_time_gives_each_pair_once(spark):
    left = spark.createDataFrame([(1, 2015, "2015"), (2, None, None), (3, 2016, "x")], "p long, py int, ps string")
    right = spark.createDataFrame([(1, 2015, "2015"), (2, 2016, "2016"), (3, None, None), (4, None, "x")], "t long, ty int, ts string")
    for window, want in ((0, [(1, 1), (2, 3), (3, 2), (3, 4)]), (1, [(1, 1), (1, 2), (2, 3), (3, 1), (3, 2), (3, 4)])):
        got = matching.near_in_time(left, right, "py", "ty", "ps", "ts", window).select("p", "t").collect()
        assert sorted((r[0], r[1]) for r in got) == want


def test_all_pairs_in_blocks(spark):
    a, b = spark.range(7).withColumnRenamed("id", "a"), spark.range(9).withColumnRenamed("id", "b")
    assert matching.all_pairs(a, b, broadcast_rows=3, blocks=4).distinct().count() == 63


def test_half_life_and_distance(spark):
    df = spark.createDataFrame([(1, 0.0, 3.0), (2, 3.0, 3.0), (3, None, 3.0)], "id long, d double, h double")
    near(col(df.select("id", x.half_life_percent("d", "h").alias("v")), "v"), [100.0, 50.0, None])


def test_silhouette(spark):
    pts = [(0, 0, 0.0), (1, 0, 1.0), (2, 1, 10.0), (3, 1, 11.0), (4, 2, 30.0)]
    df = spark.createDataFrame(pts, "id long, c int, x double")
    out = col(cluster.silhouette(df, "id", "c", ["x"]), "silhouette")
    near(out, [1 - 1 / 10.5, 1 - 1 / 9.5, 1 - 1 / 9.5, 1 - 1 / 10.5, 0.0])


def test_silhouette_of_every_row(spark):
    r = np.random.default_rng(5)
    xs = r.integers(0, 12, (2600, 3)).astype(float)
    c = r.integers(0, 3, 2600)
    data = [(i, int(k), *map(float, x)) for i, (k, x) in enumerate(zip(c, xs))] + [(9000, None, 1.0, 1.0, 1.0), (9001, 0, None, 1.0, 1.0)]
    df = spark.createDataFrame(data, "id long, c int, x double, y double, z double").withColumn("one", F.lit("a"))
    out = cluster.silhouettes(df, "id", ["c", "one"], ["x", "y", "z"], block=500).orderBy("id").collect()
    assert [x["id"] for x in out] == [x[0] for x in data] and [x["c"] for x in out] == [x[1] for x in data]
    d = np.sqrt(((xs[:, None] - xs[None]) ** 2).sum(2))
    n = np.array([(c == k).sum() + (k == 0) for k in range(3)])  # 9001 counts, without distances
    s = np.stack([d[:, c == k].sum(1) for k in range(3)], 1)
    a, b = s[np.arange(2600), c] / (n[c] - 1), np.where(np.arange(3) == c[:, None], np.inf, s / n).min(1)
    near([x["silhouette_c"] for x in out], [*((b - a) / np.maximum(a, b)).tolist(), None, None])
    assert {x["silhouette_one"] for x in out} == {None} and {x["one"] for x in out} == {"a"}
    assert cluster.silhouette(df, "id", "c", ["x", "y", "z"]).count() == 2602 and cluster.silhouette(df.limit(0), "id", "c", ["x"]).count() == 0


def test_splits(spark):
    df = spark.range(2000).withColumns({"season": F.concat((2010 + F.col("id") % 5).cast("string"), F.lit("/2099")), "player_id": F.col("id") % 700, "league": F.concat(F.lit("l"), F.col("id") % 4)})
    out = splits.time_split(df, "season", "id", year=None)
    assert {r[0] for r in out.where("is_valid").select("season").distinct().collect()} == {"2013/2099", "2014/2099"}
    parts = splits.hard_split(df, "season", "id", "league")
    assert parts.where("part = 'valid'").select("league").distinct().count() == 1
    two = splits.group_split(df, ["player_id"])
    assert two.groupBy("player_id").agg(F.count_distinct("is_valid").alias("n")).where("n > 1").count() == 0
    assert splits.fold_count(3) == 3 and splits.fold_count(1) == 2


def test_targets_without_position(spark):
    df = spark.createDataFrame([(1, 0.5, 900.0), (2, 0.1, 90.0)], "id long, assists_per_90_overall double, minutes_played_overall double")
    out = scoring.targets(df)
    assert {r["position_bucket"] for r in out.collect()} == {"OTHER"}
    near(col(out, "assist_score"), [1.0, -1.0])
    with pytest.raises(ValueError):
        scoring.targets(out)


def test_names():
    assert names.family("shot_accuraccy_percentage_overall") == ("shot_accuracy", "percentage")
    assert names.family("save_percentage_overall")[0] == "save"
    assert names.is_style_feature("goals_per_90_overall", names.ROLE_FAMILIES["FW"])
    assert not names.is_style_feature("goals_total_overall", names.ROLE_FAMILIES["FW"])
    assert not names.is_style_feature("goals_per_90_home", names.ROLE_FAMILIES["FW"])
    assert names.display_columns(["player_id", "attack_score", "attack_score_score_pct", "goals_per_90_overall", "season", "age"]) == ["player_id", "attack_score_score_pct", "season"]
    assert names.clean_feature_name("a__b-c ") == "a_b_c"


def test_serving(spark):
    df = spark.createDataFrame([(1, "Ann_a", None), (2, "annX", 5.0), (3, "Bob", 7.0)], "id long, name string, v double")
    assert [r["id"] for r in serve.search(df, contains={"name": "ANN"}, order=[("v", "desc")]).collect()] == [2, 1]
    assert [r["id"] for r in serve.search(df, order=[("v", "asc")], limit=1).collect()] == [1]
    assert (serve.clamp(0), serve.clamp(99), serve.clamp(None)) == (1, 50, 20)
    for bad in (0, 101):
        with pytest.raises(ValueError):
            serve.checked(bad)
    with pytest.raises(serve.NotFound):
        serve.detail(df, "id", 9, limit=1)
    with pytest.raises(serve.MissingTable):
        serve.required({}, "x")


def test_sources(spark, tmp_path):
    import sqlite3

    con = sqlite3.connect(tmp_path / "x.db")
    con.execute("create table t (a integer, b real, c text)")
    con.executemany("insert into t values (?, ?, ?)", [(1, 2, "x"), (None, 0.5, None)])
    con.commit()
    con.close()
    df = io.read_sqlite(spark, str(tmp_path / "x.db"), "t", rowid="r")
    assert [tuple(r) for r in df.orderBy("r").collect()] == [(1, 1, 2.0, "x"), (2, None, 0.5, None)]
    with pytest.raises(FileNotFoundError):
        io.read_sqlite(spark, str(tmp_path / "x.db"), "u")
    with pytest.raises(ValueError):
        io.pad(df, ["a", "z"], ["z"])
    assert io.pad(df, ["a", "z"]).columns == ["a", "z"]
    io.write_json({"a": 1}, str(tmp_path / "m.json"))
    assert io.read_json(spark, f"file://{tmp_path}/m.json").first()["a"] == 1
    io.write_table(df, f"file://{tmp_path}/out", ["r"], 2)
    assert io.read_table(spark, f"file://{tmp_path}/out", ["b", "absent"]).columns == ["b"]
    assert io.unique_names(["A", "a", "b"]) == ["A", "b"]


def test_quantiles_by_ranges(spark, monkeypatch):
    """Exact quantiles, ranks and scores are the same whether groups fit into tasks or not."""
    r = np.random.default_rng(2)
    rows = [(i, "abc"[i % 3] if i % 11 else None, float(v) if i % 13 else None) for i, v in enumerate(np.round(r.standard_normal(900), 1))]
    df = spark.createDataFrame(rows, "id long, g string, x double")
    for p in (0.0, 0.25, 0.5, 0.9, 1.0):
        one = stats.range_quantiles(df, {"q": (F.col("x"), p)}).first()["q"]
        near([one], [float(np.quantile([v for *_, v in rows if v is not None], p))])
        by = {k["_key_0"]: k["q"] for k in stats.range_quantiles(df, {"q": (F.col("x"), p)}, ["g"]).collect()}
        for g in ("a", "b", "c", None):
            near([by[g]], [float(np.quantile([v for _, h, v in rows if h == g and v is not None], p))])
    small = col(stats.calibrated_scores(df, {"s": "x"}, ["g"]), "s"), col(stats.percentile_ranks(df, "x", "r", ["g"]), "r"), col(stats.shrink_by_volume(df, {"s": "x"}, "id", ["g"]), "s")
    monkeypatch.setattr(stats, "LARGE", 100)
    large = col(stats.calibrated_scores(df, {"s": "x"}, ["g"]), "s"), col(stats.percentile_ranks(df, "x", "r", ["g"]), "r"), col(stats.shrink_by_volume(df, {"s": "x"}, "id", ["g"]), "s")
    for a, b in zip(small, large):
        near(a, b)


def test_positions(spark):
    df = spark.createDataFrame([(1, None, "Striker"), (2, "none", "Goalkeeper"), (3, "MID", None), (4, "FWD", "Defender")], "id long, position_group string, position string")
    assert col(scoring.fill_position_group(df), "position_group") == ["OTHER", "GK", "MID", "OTHER"]
    assert col(scoring.fill_position_group(df.drop("position_group", "position")), "position_group") == ["OTHER"] * 4
    assert col(scoring.of_positions(df, ["gk", "fwd"]), "id") == [1, 2]
    assert col(scoring.of_positions(df, "mid"), "id") == [3]
    assert scoring.of_positions(df.drop("position", "position_group"), "GK").count() == 4
    assert scoring.normalised({"a": 1.0, "b": 3.0}) == {"a": 0.25, "b": 0.75} and scoring.normalised({"a": 0.0}) == {"a": 0.0}


def test_empty_matches(spark):
    from plumbline.plans import matching as plan

    assert plan.empty_matches(spark).columns == serve.MATCH_COLUMNS
    assert plan.empty_matches(spark, ["wide_play"], True).columns == [*serve.MATCH_COLUMNS, "best_fit_dimensions", "weak_fit_dimensions", "dimension_gap_wide_play"]


def test_reads_are_checked(spark):
    t = {"base_scores": spark.createDataFrame([(1, "x")], "player_id long, season string").withColumns({c: F.lit(None).cast("string") for c in serve.SCORE_COLUMNS if c not in ("player_id", "season")})}
    assert serve.READS["player"](t, player_id=1).columns == serve.SCORE_COLUMNS
    with pytest.raises(serve.NotFound):
        serve.READS["player"](t, player_id=2)
    with pytest.raises(ValueError):
        serve.READS["players"](t, 101)
    with pytest.raises(serve.MissingTable):
        serve.READS["team_clusters"](t)
    with pytest.raises(TypeError):
        serve.READS["players"](t, role="FW")


def test_training(spark):
    from plumbline.plans import training

    r = np.random.default_rng(4)
    rows = [(i, f"{2015 + i % 5}/{2016 + i % 5}", ["Goalkeeper", "Defender", "Striker"][i % 3], 90.0 * (1 + i % 30), 1.0 + i % 30, *map(float, r.standard_normal(3))) for i in range(600)]
    df = spark.createDataFrame(rows, "player_row_id long, season string, position string, minutes_played_overall double, appearances_overall double, goals_per_90_overall double, assists_per_90_overall double, conceded_per_90_overall double")
    parts = {"attack_score": [("goals_per_90_overall", 1.0)], "conceded_score": [("conceded_per_90_overall", -1.0)], "rare_score": [("assists_per_90_overall", 1.0)]}
    allowed = {b: ["attack_score", "conceded_score"] for b in ("GK", "DEF", "MID", "FWD", "OTHER")} | {"GK": ["conceded_score", "rare_score"]}
    found, registry = training.train(df, "player_row_id", parts, allowed, least=300, trees=5)
    assert sorted(found) == ["attack_score", "conceded_score", "rating_pred"]
    rows = {x["target"]: x for x in registry.collect()}
    assert rows["base_attack_score"]["feature_cols"] == ["goals_per_90_overall", "position", "position_group", "season"] and rows["base_attack_score"]["n_valid"] == 160
    document = training.registry_document(registry).first()
    assert document["main_target"] == "rating_pred" and set(document["trained_targets"]) == {f"base_{t}" for t in found} and all(m["metrics"]["rmse_valid"] > 0 for m in document["models"])


def test_model_features():
    columns = ["player_id", "goals_per_90_overall", "goals_overall", "passes_total_overall", "annual_salary_eur", "xg_rate_overall", "wide_play", "latent_style_dim_1", "average_rating_overall", "shots_home"]
    assert names.model_features(columns) == ["goals_per_90_overall", "xg_rate_overall", "latent_style_dim_1"]


def test_display_columns():
    columns = ["Player_ID", "attack_score", "attack_score_score_pct", "goals_per_90_overall", "goals_overall", "games_started", "season", "xg", "rating_score_sigmoid"]
    assert names.display_columns(columns) == ["Player_ID", "attack_score_score_pct", "goals_overall", "games_started", "season", "rating_score_sigmoid"]


def test_settings(spark, tmp_path):
    spark.createDataFrame([(f"x{i}", i % 3) for i in range(60)], "role string, cluster_id int").write.parquet(f"file://{tmp_path}/player_cluster_summary")
    spark.createDataFrame([(i, f"n{i}", float(i)) for i in range(60)], "player_id long, full_name string, minutes_played_overall double").write.parquet(f"file://{tmp_path}/player_style_cards")
    own = serve.Settings.of({"folder": f"file://{tmp_path}", "default_limit": "7", "most": "30"})
    assert sorted(own.tables(spark)) == ["player_cluster_summary", "player_style_cards"]
    assert own.read(spark, "player_style_search").count() == 7 and own.read(spark, "player_style_search", 100).count() == 30
    assert own.read(spark, "player_clusters").count() == 60
    with pytest.raises(serve.MissingTable):
        own.read(spark, "team_clusters")
    assert not serve.health(spark, own.tables(spark)).first()["scores_exist"]
