import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconlake.operators import supervised as S
from beaconlake.operators.iforest import (
    Forest, average_path, fit_global, fit_per_ap, grow_trees, pack_trees, path_scores, score_range,
)


@pytest.fixture(scope="module")
def training(spark):
    """Three access points: two with 600 and 15 ordinary rows, one without a profile."""
    rng = np.random.default_rng(7)
    rows, n = [], 0
    for bssid, size in (("a", 600), ("b", 15), ("c", 100)):
        for skew, rssi in zip(rng.normal(0, 1e-5, size), rng.normal(-50, 3, size)):
            rows.append((n, "s", bssid, float(skew), float(rssi), int(rng.integers(0, 4)), 102.4, 1))
            n += 1
    rows.append((n, "s", "a", math.nan, -50.0, 1, 102.4, 1))
    rows.append((n + 1, "s", "a", math.inf, -50.0, 1, 102.4, 1))
    return spark.createDataFrame(
        rows,
        "frame_id long, sensor_id string, bssid string, clock_skew double, rssi double, "
        "seq_jump int, inter_beacon_ms double, valid_skew int",
    )


@pytest.fixture(scope="module")
def forest(spark, training):
    return fit_per_ap(training, spark.createDataFrame([("a",), ("b",)], "bssid string"))


def test_eligibility_and_scaling(forest, training):
    params = forest.params.collect()
    assert [r["model_key"] for r in params] == ["a"]
    usable = training.filter("bssid = 'a' AND clock_skew < 1").toPandas()
    assert params[0]["rows"] == 600
    assert params[0]["means"][1] == pytest.approx(usable["rssi"].mean())
    assert params[0]["scales"][1] == pytest.approx(usable["rssi"].std(ddof=0))
    assert params[0]["scales"][3] == 1.0


def test_tree_shape(forest):
    nodes = forest.nodes().filter("tree_id < 5").toPandas()
    for _, tree in nodes.groupby("tree_id"):
        tree = tree.set_index("node_id").sort_index()
        assert tree.loc[0, "size"] == 256 and tree["depth"].max() <= 8
        inner = tree[tree["feature"] >= 0]
        for _, node in inner.iterrows():
            left, right = tree.loc[int(node["left"])], tree.loc[int(node["right"])]
            assert left["size"] + right["size"] == node["size"]
            assert min(left["size"], right["size"]) >= 1
            assert left["depth"] == right["depth"] == node["depth"] + 1


def test_contamination_and_planted_outliers(spark, forest, training):
    scored = forest.score(training.filter("bssid = 'a' AND clock_skew < 1"))
    below = scored.agg(F.avg((F.col("model_score") < 0).cast("int"))).first()[0]
    assert 0.04 <= below <= 0.06
    lowest = scored.agg(F.min("model_score")).first()[0]
    outlier = spark.createDataFrame([("a", 1.0, -5.0, 3000, 9000.0, 1)],
                                    "bssid string, clock_skew double, rssi double, seq_jump int, "
                                    "inter_beacon_ms double, valid_skew int")
    assert forest.score(outlier).first()["model_score"] <= lowest + 0.02
    assert score_range(forest).first()["score_min"] == pytest.approx(lowest)


def test_only_rows_with_a_model_and_condition_are_scored(forest, training):
    scored = forest.score(training.withColumn("valid_skew", (F.col("frame_id") % 2).cast("int")),
                          F.col("valid_skew") == 1)
    counts = scored.groupBy("bssid").agg(F.count("model_score").alias("n"), F.count("*").alias("all"))
    got = {r["bssid"]: (r["n"], r["all"]) for r in counts.collect()}
    assert got["b"] == (0, 15) and got["c"] == (0, 100)
    assert got["a"] == (training.filter("bssid = 'a' AND frame_id % 2 = 1").count(), 602)


def test_cogroup_path_equals_broadcast_path(forest, training, monkeypatch):
    from beaconlake.operators import iforest

    monkeypatch.setattr(iforest._score_by_cogroup, "__defaults__", (50,))
    key = F.col("valid_skew") == 1
    a = forest.score(training, key).select("frame_id", F.col("model_score").alias("x"))
    b = forest.score(training, key, broadcast_nodes=0).select("frame_id", F.col("model_score").alias("y"))
    joined = a.join(b, "frame_id")
    assert joined.count() == training.count()
    assert joined.filter(~F.col("x").eqNullSafe(F.col("y"))).count() == 0


def test_fit_above_the_broadcast_size_is_the_same(spark, forest, training):
    known = spark.createDataFrame([("a",)], "bssid string")
    again = fit_per_ap(training, known, broadcast_nodes=0)
    pick = ["model_key", "offset", "score_min", "score_max"]
    assert again.params.select(*pick).exceptAll(forest.params.select(*pick)).count() == 0


def test_every_tree_draws_from_all_rows(spark):
    """More rows than all samples together: trees still differ and no tree has a row twice."""
    rows = spark.range(40_000).selectExpr(
        "'s' AS sensor_id", "id AS frame_id", "'a' AS bssid", "id / 4e4 AS clock_skew", "CAST(id % 7 AS DOUBLE) AS rssi"
    )
    fitted = fit_per_ap(rows, spark.createDataFrame([("a",)], "bssid string"), trees=30)
    trees = fitted.trees.collect()
    assert len(trees) == 30 and {t["sample"] for t in trees} == {256}
    assert all(sum(n for n, f in zip(t["size"], t["feature"]) if f < 0) == 256 for t in trees)
    assert len({tuple(t["threshold"]) for t in trees}) == 30


def test_same_forest_whatever_the_partitioning(spark, forest, training):
    again = fit_per_ap(training.repartition(7), spark.createDataFrame([("a",)], "bssid string"))
    pick = ["tree_id", "feature", "size"]
    assert again.trees.select(*pick).exceptAll(forest.trees.select(*pick)).count() == 0


def test_missing_feature_counts_as_zero_and_save_load(spark, forest, training, path):
    zero = training.withColumn("inter_beacon_ms", F.lit(0.0))
    a = forest.score(training.drop("inter_beacon_ms")).select("frame_id", "model_score")
    assert a.exceptAll(forest.score(zero).select("frame_id", "model_score")).count() == 0
    forest.save(path("model"))
    loaded = Forest.load(spark, path("model"))
    assert (loaded.features, loaded.key) == (forest.features, "bssid")
    b = loaded.score(zero).select("frame_id", "model_score")
    assert b.exceptAll(forest.score(zero).select("frame_id", "model_score")).count() == 0


def test_global_forest_fills_bad_values(training):
    fitted = fit_global(training, trees=20)
    row = fitted.params.first()
    assert (row["model_key"], row["rows"]) == ("all", 717)
    assert fitted.features == ["rssi", "seq_jump", "clock_skew"]
    with pytest.raises(ValueError):
        fit_global(training.select("frame_id", "sensor_id"))


def test_paths_by_walking_one_point_at_a_time():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(300, 3))
    trees = grow_trees(points, 10, rng)
    want = []
    for p in points[:40]:
        total = 0.0
        for t in trees:
            at = 0
            while t["feature"][at] >= 0:
                at = t["right"][at] if p[t["feature"][at]] > t["threshold"][at] else t["left"][at]
            total += t["depth"][at] + average_path(t["size"][at])
        want.append(-(2 ** (-(total / 10) / average_path(256))))
    assert path_scores(points[:40], pack_trees(trees), block=16) == pytest.approx(np.array(want))


def test_constant_and_tiny_samples():
    rng = np.random.default_rng(1)
    flat = grow_trees(np.ones((50, 2)), 3, rng)
    assert all(len(t["feature"]) == 1 for t in flat)
    assert np.isfinite(path_scores(np.ones((2, 2)), pack_trees(flat))).all()
    assert len(grow_trees(np.array([[1.0], [2.0]]), 1, rng)[0]["feature"]) == 3


# --- Supervised baseline


@pytest.mark.parametrize(
    "counts, sizes",
    [({0: 80, 1: 20}, {0: 16, 1: 4}), ({0: 7, 1: 4}, {0: 2, 1: 1}), ({0: 13, 1: 8}, {0: 3, 1: 2})],
)
def test_split_sizes(counts, sizes):
    assert S.test_sizes(counts) == sizes


def test_rates_in_text(spark):
    texts = [None, "", " Unknown ", "none", "NaN", "1.0,2.0", "1.0,, 2.0 ,", "11"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(S.rates_in_text(F.col("t"))).collect()]
    assert got == [0, 0, 0, 0, 0, 2, 2, 1]


def test_median_imputation(spark):
    rows = spark.createDataFrame(
        [(1, "1", None, "WEP", "1.0,2.0"), (2, "x", None, "WPA", None), (3, "4", None, "?", "unknown"),
         (4, None, None, None, "1.0"), (5, "10", None, "Open", "")],
        "frame_id int, rssi string, channel int, security string, supported_rates string",
    )
    filled, features = S.impute_medians(rows)
    got = {r["frame_id"]: r for r in filled.collect()}
    assert features == ["rssi", "channel", "rate_count", "security_encoded"]
    assert [got[i]["rssi"] for i in range(1, 6)] == [1.0, 4.0, 4.0, 4.0, 10.0]
    assert [got[i]["channel"] for i in range(1, 6)] == [0.0] * 5
    assert [got[i]["rate_count"] for i in range(1, 6)] == [2.0, 0.0, 0.0, 1.0, 0.0]
    assert [got[i]["security_encoded"] for i in range(1, 6)] == [1.0, 2.0, 0.0, 0.0, 0.0]


def labelled(spark, n=400):
    return spark.range(n).select(
        F.col("id").alias("frame_id"), F.lit("s").alias("sensor_id"),
        (F.col("id") % 4 == 0).cast("int").alias("label"),
        (F.when(F.col("id") % 4 == 0, 4).otherwise(20) + F.col("id") % 3).alias("ie_count"),
        (F.col("id") % 7).alias("rssi"),
    )


def test_split_is_exact_and_repeatable(spark):
    split = S.stratified_split(labelled(spark))
    got = {r["label"]: r["n"] for r in split.filter("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 60, 1: 20}
    again = S.stratified_split(labelled(spark).repartition(5))
    assert split.exceptAll(again).count() == 0


def test_training_and_reuse(spark, path):
    model, features, metrics = S.train_baseline(labelled(spark), path("rf"))
    row = metrics.first()
    assert (row["accuracy"], row["test_rows"], row["train_rows"]) == (1.0, 80, 320)
    assert (row["true_negatives"], row["true_positives"]) == (60, 20)
    assert S.feature_importance(spark, model, features).first()["feature"] == "ie_count"
    reused, names, stored = S.train_baseline(labelled(spark).limit(0), path("rf"))
    assert names == features and stored.first() == row
    assert reused.getNumTrees == 100


def test_preconditions(spark):
    with pytest.raises(ValueError, match="20"):
        S.check_trainable(labelled(spark, 19))
    with pytest.raises(ValueError, match="both"):
        S.check_trainable(labelled(spark).filter("label = 0"))


def test_report_without_predictions_of_a_class(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, prediction int")
    report = {r["class"]: r for r in S.classification_report(rows).collect()}
    assert (report["Simulated Attack"]["precision"], report["Simulated Attack"]["f1"]) == (0.0, 0.0)
    assert report["Benign"]["recall"] == 1.0
    assert report["macro avg"]["recall"] == 0.5
    assert report["weighted avg"]["recall"] == pytest.approx(2 / 3)
