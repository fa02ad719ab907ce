import os
import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskloom.ml import encode, evaluate, models
from riskloom.plans import load_queries
from riskloom.session import stored


@pytest.fixture(scope="module")
def points(spark):
    rows = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("signal"), F.hash("id").cast("double").alias("noise"),
                                   F.when(F.col("id") % 20 >= 15, 1.0).otherwise(0.0).alias("label"))
    return encode.assemble(["noise", "signal"]).transform(rows).cache()


def test_confusion_golden(spark):
    rows = [(1, 1.0)] * 3 + [(0, 0.0)] * 4 + [(0, 1.0)] + [(1, 0.0)] * 2
    r = evaluate.confusion(spark.createDataFrame(rows, "label int, prediction double")).first()
    assert (r.tp, r.tn, r.fp, r.fn) == (3, 4, 1, 2)
    assert (r.precision_1, r.recall_1) == (0.75, 0.6)


def test_thresholds_match_confusion(spark):
    rows = [(i / 10, int(i < 3)) for i in range(10)]
    df = spark.createDataFrame(rows, "score double, label int")
    for r in evaluate.threshold_report(df, "score", "label", [0.2, 0.5, 0.95]).collect():
        one = evaluate.confusion(df.withColumn("prediction", (F.col("score") < r.cut).cast("int"))).first()
        assert (r.tp, r.tn, r.fp, r.fn) == (one.tp, one.tn, one.fp, one.fn)


def test_forest_finds_the_signal(spark, points):
    model = models.train_rf(points, models.ForestConfig(10, 4, seed=1))
    top = evaluate.importances(model, ["noise", "signal"], spark).first()
    assert top.feature == "signal"
    scored = model.transform(points)
    assert evaluate.auc(scored) > 0.99 and evaluate.auc(scored, "areaUnderPR") > 0.95
    assert evaluate.multiclass_metric(scored) > 0.99
    again = models.train_rf(points, models.ForestConfig(10, 4, seed=1)).transform(points)
    assert [r.prediction for r in scored.orderBy("id").collect()] == [r.prediction for r in again.orderBy("id").collect()]


def test_thresholds_move_the_decision(points):
    # A fifth of the labels is flipped, so leaves are impure and the decision depends on the threshold.
    flip = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    noisy = points.withColumn("label", F.when(flip, 1 - F.col("label")).otherwise(F.col("label")))
    even = models.train_rf(noisy, models.ForestConfig(5, 2)).transform(noisy)
    strict = models.train_rf(noisy, models.ForestConfig(5, 2, thresholds=(1.0, 1000.0))).transform(noisy)
    assert even.where("prediction = 1").count() > 0
    assert strict.where("prediction = 1").count() == 0


def test_boosting_and_clusters(spark, points):
    scored = models.train_gbt(points, 3, 2, 0.3, 32).transform(points)
    assert evaluate.multiclass_metric(scored) > 0.95
    costs = [r.cost for r in models.k_scan(encode.assemble(["signal"], "s").transform(points).select("s"), [2, 5, 10], features="s").orderBy("k").collect()]
    assert costs == sorted(costs, reverse=True)
    model = models.cluster(points, 3, 1)
    assert sum(models.cluster_members(model, points, i).count() for i in range(3)) == 400


def test_scalers_buckets_and_selection(spark, points):
    scaled = encode.scale("minmax").fit(points).transform(points)
    assert max(r.scaled_features[1] for r in scaled.collect()) == 1.0
    bucketed = encode.bucketize("signal", [0, 5, 10, float("inf")]).transform(points)
    assert {r.signal_bucket for r in bucketed.collect()} == {0.0, 1.0, 2.0}
    assert encode.quantile_buckets("signal", 4).fit(points).transform(points).select("signal_QD").distinct().count() == 4
    categories = encode.assemble(["signal", "parity"], "f").transform(points.withColumn("parity", F.floor(F.col("id") / 20) % 2).withColumn("parity", F.col("parity").cast("double")))
    assert 0 in encode.select_chi2(categories, "f", "label").selectedFeatures
    hashed = encode.hash_one_hot(["signal"], 64).transform(points.select("signal"))
    assert hashed.first().features.size == 64
    hot = encode.one_hot(["signal"]).fit(points).transform(points)
    assert hot.first().signal_vec.numNonzeros() == 1


def test_training_parts_do_not_grow_with_the_files(spark):
    """Every task sends the histograms of every node, so their number follows the cores; the numbers of a row are stored as one vector."""
    from riskloom.plans.features import train_on_features

    rows = spark.range(0, 6400, 1, 64).selectExpr("id", "int(id % 10 < 3) AS flag", "id % 10 AS a", "if(id % 7 = 0, null, 1 / (1 + id)) AS b", "id % 3 AS kind")
    seen = {}

    def fit(df):
        seen["parts"], seen["rows"], seen["row"] = df.rdd.getNumPartitions(), df.count(), df.first()
        seen["names"] = df.schema["features"].metadata["ml_attr"]["attrs"]
        return models.train_rf(df, models.ForestConfig(5))

    sizes = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1"}
    for name, value in sizes.items():
        spark.conf.set(name, value)
    try:
        _, scored = train_on_features(rows, "id", "flag", ["a", "b"], ["kind"], fit=fit)
        held = scored.select("label", "prediction").collect()
    finally:
        for name in sizes:
            spark.conf.unset(name)
    assert seen["parts"] <= 2 * spark.sparkContext.defaultParallelism
    assert seen["rows"] + len(held) == 6400 and all(r.label == r.prediction for r in held)
    assert [x["name"] for x in seen["names"]["numeric"]] == ["_numbers_a", "_numbers_b"] and seen["names"]["nominal"][0]["name"] == "kind_idx"
    assert "_numbers" in seen["row"] and "a" not in seen["row"]


FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def result(spark, name):
    return load_queries()[0][name](spark, FOLDER)


@pytest.mark.parametrize("name, floor", [("random_forest_scores", 0.8), ("deep_forest_scores", 0.8), ("boosted_tree_scores", 0.8)])
def test_scores_on_the_given_table(spark, name, floor):
    """A tenth of the labels is noise, so no model passes 0.9 by much; one that predicts a constant stays at 0.5."""
    scored = stored(result(spark, name), "scored")
    areas = evaluate.exact_areas(scored, "score").first()
    assert areas.roc > floor and scored.select("score").distinct().count() > 10
    assert scored.where("score NOT BETWEEN 0 AND 1").count() == 0


def test_forests_train_on_every_core(spark):
    from riskloom.plans import model_queries as mq
    from riskloom.plans.registry import Tables

    tables = Tables(spark, FOLDER)
    train, test = mq._held_out(tables, mq._telling(tables))
    assert train.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > tables.events.rdd.getNumPartitions()
    cents = train.select(F.spark_partition_id().alias("part"), "cents").collect()
    assert all(a.part != b.part or a.cents <= b.cents for a, b in zip(cents, cents[1:]))
    assert train.join(test, "txn_id", "left_semi").count() == 0 and train.count() + test.count() == tables.txn.count()


def test_importances_rank_the_planted_feature_first(spark):
    rows = result(spark, "random_forest_importances").collect()
    assert rows[0].feature == "cents" and {r.feature for r in rows} == {"cents", "hour", "place"}
    assert abs(sum(r.importance for r in rows) - 1) < 1e-9 and rows[0].importance > 0.6


def test_day_model_predicts_the_next_day(spark):
    c = result(spark, "forest_trained_by_day").first()
    assert c.tp + c.tn > 1.5 * (c.fp + c.fn)  # some thirty rows a day at the smallest scale


def test_members_of_every_cluster_are_kept(spark, tmp_path, monkeypatch):
    """Each cluster's members are taken, and each row is a member once, also where vec_id repeats or is missing."""
    draw = random.Random(3)
    rows = [(i % 50 if i % 7 else None, i % 3, [draw.gauss(20 * (i % 10), 1), draw.gauss(0, 1)]) for i in range(200)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    taken, plain = [], models.cluster_members
    monkeypatch.setattr(models, "cluster_members", lambda model, df, which: taken.append(which) or plain(model, df, which))
    got = load_queries()[0]["k_means_members"](spark, str(tmp_path)).collect()
    assert taken == list(range(10)) and "k_means_members" in load_queries()[1]
    assert sorted((str(r.vec_id), r.clusters) for r in got) == sorted((str(v), 1) for v, _, _ in rows)
    assert load_queries()[0]["k_means_clusters"](spark, str(tmp_path)).select("cluster").distinct().count() == 10


def test_costs_fall_with_k_and_the_coreset_is_close(spark):
    full = {r.k: r.cost for r in result(spark, "k_means_cost_scan").collect()}
    assert list(full) == sorted(full) and full[30] < full[5]
    core = {r.k: r.cost for r in result(spark, "k_means_coreset_scan").collect()}
    assert core.keys() == full.keys() and all(abs(core[k] / full[k] - 1) < 0.05 for k in full)


def test_a_small_coreset_keeps_costs(spark):
    rows = spark.range(20_000).select("id", F.array(F.pmod("id", F.lit(4)) * 10 + F.randn(1), F.when(F.col("id") < 20, 500.0).otherwise(F.randn(2))).alias("x"))
    rows = stored(rows, "points").select("id", array_to_vector("x").alias("features"))
    sample = models.coreset(rows, "id", size=800)
    assert 400 < sample.count() < 1200
    assert abs(sample.agg(F.sum("weight")).first()[0] / 20_000 - 1) < 0.1
    full = {r.k: r.cost for r in models.k_scan(rows, [2]).collect()}
    core = {r.k: r.cost for r in models.k_scan_coreset(rows, [2], "id", size=800).collect()}
    assert core[2] < 1.05 * full[2]  # the twenty rows far out are a cluster of their own in both


def test_p_values_equal_the_library(spark):
    from pyspark.ml.stat import ChiSquareTest

    rows = stored(spark.range(4000).select((F.rand(1) * 400).cast("int").alias("wide"), (F.rand(2) * 7).cast("int").alias("few"), F.lit(1).alias("one"),
                                           F.when(F.rand(3) < 0.3, 1.0).otherwise(0.0).alias("label")), "cells")
    rows = rows.withColumn("told", F.when(F.rand(4) < 0.1, 1 - F.col("label")).otherwise(F.col("label")).cast("int"))
    got = {r.col: r for r in encode.chi2_wide(rows, ["wide", "few", "told", "one"], "label").collect()}
    vectors = encode.assemble(["wide", "few", "told"]).transform(rows)
    want = ChiSquareTest.test(vectors, "features", "label", flatten=True).orderBy("featureIndex").collect()
    for name, w in zip(["wide", "few", "told"], want):
        assert got[name].dof == w.degreesOfFreedom and abs(got[name].statistic - w.statistic) < 1e-6 * max(1, w.statistic)
        assert abs(got[name].p_value - w.pValue) < 1e-9
    assert (got["one"].dof, got["one"].statistic, got["one"].p_value) == (0, 0.0, 1.0)
    assert encode.select_wide(rows, ["wide", "few", "told"], "label", 1e-6).select("col").collect() == [("told",)]
    assert encode.chi2_wide(rows.where("false"), ["few"], "label").collect() == []


def test_chi_square_of_ten_thousand_categories(spark):
    """Above the library's limit: with as many values as here a uniform column has a p-value away from both ends."""
    rows = spark.range(120_000).select(F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("v"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2))).alias("label"))
    r = encode.chi2_wide(rows, ["v"], "label").first()
    assert r.dof > 19_000 and 0.001 < r.p_value < 0.999 and abs(r.statistic / r.dof - 1) < 0.05


@pytest.mark.parametrize("parts", [2, 60])
def test_exact_areas(spark, parts):
    draw = random.Random(parts)
    rows = [(draw.choice([None, *map(float, range(40))]), draw.randint(0, 1)) for _ in range(500)]
    df = spark.createDataFrame(rows, "s double, label int")
    known = [r for r in rows if r[0] is not None]
    pos, neg = ([s for s, y in known if y == v] for v in (1, 0))
    roc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    pr = last = 0.0
    before = None
    for cut in sorted({s for s, _ in known}, reverse=True):
        tp = sum(p >= cut for p in pos)
        precision = tp / (tp + sum(n >= cut for n in neg))
        pr += (tp / len(pos) - last) * (precision + (precision if before is None else before)) / 2
        last, before = tp / len(pos), precision
    got = evaluate.exact_areas(df, "s", parts=parts).first()
    assert abs(got.roc - roc) < 1e-12 and abs(got.pr - pr) < 1e-12 and (got.positives, got.negatives) == (len(pos), len(neg))
    one = evaluate.exact_areas(df.where("label = 1"), "s").first()
    assert one.roc is None and one.pr == 1.0
    assert evaluate.exact_areas(df.where("false"), "s").first().roc is None


def test_real_quantiles(spark):
    rows = {r.p: r for r in result(spark, "approximate_quantiles").collect()}
    assert all(abs(r.rank - p) <= 0.011 for p, r in rows.items()) and len(rows) == 5
    buckets = result(spark, "quantile_buckets").collect()
    assert len(buckets) == 15 and max(r.n for r in buckets) < 1.3 * min(r.n for r in buckets)
