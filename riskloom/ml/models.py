"""Training: random forests, boosted trees, k-means."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import uniform_draw
from riskloom.operators.labels import day_slice, sample_fraction


@dataclass(frozen=True)
class ForestConfig:
    trees: int = 200
    depth: int = 5
    bins: int = 32
    min_instances: int = 1
    subsample: float = 1.0
    thresholds: tuple[float, ...] | None = None
    impurity: str = "gini"
    seed: int = 0
    memory_mb: int = 256  # for the histograms of a task; the nodes of a pass over the rows fill it


# Settings in use: wide bins and few-sample leaves, deep with small samples, cost-weighted, quick checks.
FOREST_WIDE = ForestConfig(200, 5, 10_000, 10, 1.0, (100.0, 1.0))
FOREST_DEEP = ForestConfig(100, 10, 10_000, 1, 0.2)
FOREST_COST = ForestConfig(200, 5, 10_000, 1, 0.7, (180.0, 1.0))
FOREST_SMALL = ForestConfig(20, 5, 10_000, 1, 0.5)
FOREST_TINY = ForestConfig(5)
FOREST_DEEPEST = ForestConfig(200, 30, 10_000)


def train_rf(df: DataFrame, cfg: ForestConfig = FOREST_TINY, features: str = "features", label: str = "label"):
    """Random forest; a class wins by probability over its threshold."""
    forest = RandomForestClassifier(
        featuresCol=features, labelCol=label, numTrees=cfg.trees, maxDepth=cfg.depth, maxBins=cfg.bins,
        minInstancesPerNode=cfg.min_instances, subsamplingRate=cfg.subsample, impurity=cfg.impurity, seed=cfg.seed,
        maxMemoryInMB=cfg.memory_mb)
    if cfg.thresholds:
        forest = forest.setThresholds(list(cfg.thresholds))
    return forest.fit(df)


def train_gbt(df: DataFrame, iterations: int = 200, depth: int = 3, step: float = 0.001, bins: int = 10_000,
              subsample: float = 1.0, features: str = "features", label: str = "label", seed: int = 0):
    return GBTClassifier(featuresCol=features, labelCol=label, maxIter=iterations, maxDepth=depth, stepSize=step,
                         maxBins=bins, subsamplingRate=subsample, seed=seed).fit(df)


def cluster(df: DataFrame, k: int = 10, seed: int = 1, features: str = "features", iterations: int = 20):
    """K-means model; ``summary.trainingCost`` is its cost and ``clusterCenters()`` its centres."""
    return KMeans(k=k, seed=seed, featuresCol=features, maxIter=iterations).fit(df)


def cluster_members(model, df: DataFrame, which: int) -> DataFrame:
    return model.transform(df).where(F.col("prediction") == which)


def k_scan(df: DataFrame, ks: Iterable[int], id_col: str | None = None, fraction: float = 1.0, seed: int = 1,
           features: str = "features") -> DataFrame:
    """(k, cost) on one persisted sample. The models differ in k, so each is its own fit."""
    sample = df if id_col is None or fraction >= 1.0 else sample_fraction(df, id_col, fraction, seed)
    sample = sample.select(features).persist()
    try:
        costs = [(k, float(cluster(sample, k, seed, features).summary.trainingCost)) for k in ks]
    finally:
        sample.unpersist()
    return df.sparkSession.createDataFrame(costs, "k int, cost double")


def coreset(df: DataFrame, id_col: str, features: str = "features", size: int = 4096, seed: int = 1) -> DataFrame:
    """(features, weight): a weighted sample of about ``size`` rows on which k-means costs are close to those on all rows.

    A row is drawn with probability min(1, size * (1/(2n) + d/(2D))) and weighs the inverse, where d is its squared distance from the mean
    and D their sum, so rows far out are never missed and every centre set keeps its expected cost. Draws are a hash of ``id_col``, so
    reruns agree. Rows with a null vector take no part.
    """
    values = vector_to_array(features)
    rows = df.where(F.col(features).isNotNull()).select(F.col(id_col).alias("_id"), features, values.alias("_v"))
    mean = rows.select(F.posexplode("_v").alias("_i", "_x")).groupBy("_i").agg(F.avg("_x").alias("_m"))
    # One row: the mean has as many numbers as a vector.
    centre = mean.agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("_c")).withColumn("_k", F.lit(0))
    far = F.aggregate(F.zip_with("_v", "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    spread = rows.withColumn("_k", F.lit(0)).join(F.broadcast(centre), "_k").withColumn("_d", far)
    total = spread.agg(F.count(F.lit(1)).alias("_n"), F.sum("_d").alias("_sum")).withColumn("_k", F.lit(0))
    share = F.lit(0.5) / F.col("_n") + F.coalesce(F.try_divide(F.col("_d"), F.col("_sum")), F.try_divide(F.lit(1.0), F.col("_n"))) / 2
    chance = F.least(F.lit(1.0), size * share)
    return spread.join(F.broadcast(total), "_k").withColumn("_p", chance).where(uniform_draw(F.col("_id"), F.lit(seed)) < F.col("_p")).select(
        features, (1 / F.col("_p")).alias("weight"))


def k_scan_coreset(df: DataFrame, ks: Iterable[int], id_col: str, features: str = "features", size: int = 4096, seed: int = 1) -> DataFrame:
    """(k, cost) of every k, fitted on one coreset; the costs of all fitted centres are then measured on all rows in one scan."""
    sample = coreset(df, id_col, features, size, seed).persist()
    try:
        fitted = {k: KMeans(k=k, seed=seed, featuresCol=features, weightCol="weight").fit(sample).clusterCenters() for k in ks}
    finally:
        sample.unpersist()
    # One row with all centres; it has as many numbers as the models have.
    centres = df.sparkSession.createDataFrame([(0, *[[list(map(float, c)) for c in fitted[k]] for k in fitted])],
                                              "_k int, " + ", ".join(f"c{k} array<array<double>>" for k in fitted))

    def cost(k: int) -> Column:
        away = F.transform(f"c{k}", lambda c: F.aggregate(F.zip_with("_v", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
        return F.sum(F.array_min(away)).alias(f"s{k}")

    rows = df.where(F.col(features).isNotNull()).select(F.lit(0).alias("_k"), vector_to_array(features).alias("_v"))
    costs = rows.join(F.broadcast(centres), "_k").agg(*[cost(k) for k in fitted])
    return costs.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"s{k}").alias("cost")) for k in fitted])).alias("r")).select("r.*")


def train_test_by_day(df: DataFrame, ts: str, train_day: str, test_day: str, cfg: ForestConfig = FOREST_TINY,
                      features: str = "features", label: str = "label"):
    """Train on one day and predict another."""
    model = train_rf(day_slice(df, ts, train_day), cfg, features, label)
    return model, model.transform(day_slice(df, ts, test_day))
