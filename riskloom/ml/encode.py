"""Encoding for models: indexing, vectors, buckets, weight of evidence, feature selection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    Bucketizer, FeatureHasher, MinMaxScaler, Normalizer, OneHotEncoder, QuantileDiscretizer, StandardScaler,
    StringIndexer, UnivariateFeatureSelector, VectorAssembler,
)
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import bkdr_hash
from riskloom.operators.graph import number_values
from riskloom.operators.profile import melt
from riskloom.operators.skew import join_unique, null_safe_join


def index_categories(cols: Iterable[str], suffix: str = "_idx", unseen: str = "skip", order: str = "frequencyDesc") -> Pipeline:
    """Index every column by frequency, in one multi-column stage.

    Spark ML keeps the labels on the driver: fit it through ``fit_categories``, or use ``dictionary_index`` for columns with many values.
    """
    cols = list(cols)
    return Pipeline(stages=[StringIndexer(
        inputCols=cols, outputCols=[c + suffix for c in cols], handleInvalid=unseen, stringOrderType=order)])


def check_categories(df: DataFrame, cols: Iterable[str], most: int = 100_000) -> None:
    """Raise if a column has more than ``most`` values (by sketch), before Spark ML gathers them on the driver."""
    cols = list(cols)
    counts = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in cols]).first().asDict()
    if wide := {c: n for c, n in counts.items() if n > most}:
        raise ValueError(f"too many categories to index on the driver, use dictionary_index: {wide}")


def fit_categories(df: DataFrame, cols: Iterable[str], suffix: str = "_idx", unseen: str = "skip", order: str = "frequencyDesc", most: int = 100_000):
    """Fitted ``index_categories``, after ``check_categories``."""
    cols = list(cols)
    check_categories(df, cols, most)
    return index_categories(cols, suffix, unseen, order).fit(df)


def dictionary(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """(value, index) with running numbers, for columns of any size."""
    return number_values(df, col, out or f"{col}_idx")


def dictionary_index(df: DataFrame, col: str, table: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """Rows with the dictionary number of ``col``; values outside the dictionary get null."""
    return join_unique(df, dictionary(df, col, out) if table is None else table, [col])


def one_hot(cols: Iterable[str], suffix: str = "_vec") -> OneHotEncoder:
    """One-hot with one slot for each level; an index outside the fitted levels is an error."""
    cols = list(cols)
    return OneHotEncoder(inputCols=cols, outputCols=[c + suffix for c in cols], dropLast=False, handleInvalid="error")


def assemble(cols: Iterable[str], out: str = "features", invalid: str = "error") -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid=invalid)


def normalize(col: str = "features", out: str = "norm_features") -> Normalizer:
    return Normalizer(inputCol=col, outputCol=out, p=2.0)


def scale(kind: str = "minmax", col: str = "features", out: str = "scaled_features"):
    if kind == "minmax":
        return MinMaxScaler(inputCol=col, outputCol=out)
    return StandardScaler(inputCol=col, outputCol=out, withMean=False, withStd=True)


def bucketize(col: str, edges: Iterable[float], out: str | None = None) -> Bucketizer:
    """Buckets with edge i <= value < edge i+1."""
    return Bucketizer(splits=list(edges), inputCol=col, outputCol=out or f"{col}_bucket", handleInvalid="keep")


def quantile_buckets(col: str, n: int, out: str | None = None, error: float = 0.001) -> QuantileDiscretizer:
    return QuantileDiscretizer(numBuckets=n, inputCol=col, outputCol=out or f"{col}_QD", relativeError=error)


def hash_columns(df: DataFrame, cols: Iterable[str], mask: int | None = None, empty: int = -1, suffix: str = "_hash") -> DataFrame:
    """The numeric hash of each text column as a double."""
    return df.select("*", *[bkdr_hash(F.col(c).cast("string"), mask=mask, empty=empty).cast("double").alias(c + suffix) for c in cols])


def hash_vector(df: DataFrame, cols: Iterable[str], mask: int | None = None, empty: int = -1) -> DataFrame:
    """Hashed columns as one vector of unit length, ``norm_features``. A null text hashes like an empty one."""
    cols = list(cols)
    hashed = hash_columns(df, cols, mask, empty).fillna(float(empty), [c + "_hash" for c in cols])
    vector = assemble([c + "_hash" for c in cols]).transform(hashed)
    return normalize().transform(vector)


def hash_one_hot(cols: Iterable[str], size: int = 1 << 18, out: str = "features") -> FeatureHasher:
    """One-hot of columns with many values without a dictionary."""
    cols = list(cols)
    return FeatureHasher(inputCols=cols, outputCol=out, numFeatures=size, categoricalCols=cols)


# --- weight of evidence -----------------------------------------------------------------------

def woe_table(df: DataFrame, cols: Iterable[str], label: str, zero: float = 1.0, smoothing: float = 0.0) -> DataFrame:
    """(col, value, bad, good, p1, p0, woe): ln of the bad share over the good share.

    One grouping over the long form serves all columns. A zero count is replaced by ``zero``, or every count is
    raised by ``smoothing``; ``zero=0`` without smoothing gives null where the logarithm has no value.
    """
    counts = melt(df, cols, [label]).groupBy("col", "value").agg(
        F.count_if(F.col(label) == 1).alias("bad"), F.count_if(F.col(label) == 0).alias("good"))
    # Every row has one value of every column, so each column's counts add up to the totals: one row per column, no second scan.
    totals = counts.groupBy("col").agg(F.sum("bad").alias("_bad"), F.sum("good").alias("_good"))
    joined = counts.join(F.broadcast(totals), "col")

    def share(part: str, whole: str) -> Column:
        n = F.col(part).cast("double")
        if smoothing:
            n = n + smoothing
        elif zero:
            n = F.when(n == 0, F.lit(float(zero))).otherwise(n)
        return n / F.nullif(F.col(whole), F.lit(0))

    p1, p0 = share("bad", "_bad"), share("good", "_good")
    return joined.select("col", "value", "bad", "good", p1.alias("p1"), p0.alias("p0")).withColumn(
        "woe", F.ln(F.nullif(F.try_divide("p1", "p0"), F.lit(0.0))))


def iv_table(df: DataFrame, cols: Iterable[str], label: str, zero: float = 1.0) -> DataFrame:
    """Information value and number of categories per column."""
    return woe_table(df, cols, label, zero).groupBy("col").agg(
        F.sum((F.col("p1") - F.col("p0")) * F.col("woe")).alias("iv"),
        F.count_if(F.col("value").isNotNull()).alias("category_cnt"))


def apply_woe(df: DataFrame, table: DataFrame, cols: Iterable[str], suffix: str = "_woe") -> DataFrame:
    """Rows with ``<c>_woe``; values the table does not know get null.

    The table holds a category once, so these are plain joins: Spark broadcasts a side by its measured bytes, and adaptive
    execution splits a frequent category otherwise.
    """
    cols = list(cols)
    out = df.withColumns({f"_{c}": F.col(c).cast("string") for c in cols})
    for c in cols:
        one = table.where(F.col("col") == c).select(F.col("value").alias(f"_{c}"), F.col("woe").alias(c + suffix))
        out = null_safe_join(out, one, [f"_{c}"], "left")
    return out.drop(*[f"_{c}" for c in cols])


def chi2_table(df: DataFrame, features: str, label: str) -> DataFrame:
    """(feature, dof, statistic) of the chi-square test of every categorical feature against the label."""
    return ChiSquareTest.test(df, features, label, flatten=True).select(
        F.col("featureIndex").alias("feature"), F.col("degreesOfFreedom").cast("bigint").alias("dof"), "statistic")


def select_chi2(df: DataFrame, features: str, label: str, fpr: float = 0.05, out: str = "selected"):
    """Fitted selector of categorical features by the chi-square test at a false-positive rate."""
    selector = UnivariateFeatureSelector(featuresCol=features, labelCol=label, outputCol=out, selectionMode="fpr")
    return selector.setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(fpr).fit(df)


def _ln_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0, by Stirling's series eight steps further up."""
    y = z + 8
    series = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - 1 / (1680 * y ** 7)
    return series - sum((F.ln(z + i) for i in range(1, 8)), F.ln(z))


def upper_gamma_share(a: Column, x: Column) -> Column:
    """Q(a, x), the upper regularised incomplete gamma function: series below a + 1, continued fraction above.

    The number of terms grows with the square root of ``a``, as the width of the peak does.
    """
    steps = F.sequence(F.lit(1), (F.lit(60) + 12 * F.sqrt(a)).cast("int"))
    front = F.exp(a * F.ln(x) - x - _ln_gamma(a))
    pair = F.struct((1 / a).alias("term"), (1 / a).alias("total"))
    series = F.aggregate(steps, pair, lambda s, k: F.struct(
        (s["term"] * x / (a + k)).alias("term"), (s["total"] + s["term"] * x / (a + k)).alias("total")), lambda s: s["total"])
    tiny = 1e-300

    def lentz(s: Column, k: Column) -> Column:
        an, b = -k * (k - a), x + 1 - a + 2 * k
        d = an * s["d"] + b
        d = 1 / F.when(F.abs(d) < tiny, F.lit(tiny)).otherwise(d)
        c = b + an / s["c"]
        c = F.when(F.abs(c) < tiny, F.lit(tiny)).otherwise(c)
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    b = x + 1 - a
    fraction = F.aggregate(steps, F.struct(F.lit(1 / tiny).alias("c"), (1 / b).alias("d"), (1 / b).alias("h")), lentz, lambda s: s["h"])
    return F.when(x <= 0, F.lit(1.0)).when(x < a + 1, F.greatest(F.lit(0.0), 1 - front * series)).otherwise(F.least(F.lit(1.0), front * fraction))


def chi2_wide(df: DataFrame, cols: Iterable[str], label: str) -> DataFrame:
    """(col, rows, categories, dof, statistic, p_value): Pearson's test of every column against ``label``, for any number of categories.

    Counts stay in long form, one row per (column, value, label), so nothing is gathered; a null value is a category of its own, rows without
    a label are left out. The statistic is n * (sum of o^2 / (row total * column total) - 1), which needs no empty cells. A column or a label with
    one value has no test: its statistic is 0 and its p-value 1.
    """
    known = df.where(F.col(label).isNotNull())
    cells = melt(known, cols, [label]).groupBy("col", "value", label).agg(F.count(F.lit(1)).alias("o"))
    by_value = cells.groupBy("col", "value").agg(
        F.sum("o").alias("r"), F.collect_list(F.struct(F.col(label).alias("y"), "o")).alias("cells"))  # a list holds one entry per label
    by_label = cells.groupBy("col", F.col(label).alias("y")).agg(F.sum("o").alias("c"))
    parts = by_value.select("col", "r", F.explode("cells").alias("cell")).select("col", "r", "cell.y", "cell.o")
    parts = parts.join(by_label, ["col", "y"]).groupBy("col").agg(
        F.sum(F.col("o").cast("double") * F.col("o") / (F.col("r").cast("double") * F.col("c"))).alias("s"))
    sizes = by_value.groupBy("col").agg(F.count(F.lit(1)).alias("categories"), F.sum("r").alias("rows"))
    labels = by_label.groupBy("col").agg(F.count(F.lit(1)).alias("labels"))
    out = parts.join(sizes, "col").join(labels, "col")
    dof = (F.col("categories") - 1) * (F.col("labels") - 1)
    out = out.select("col", "rows", "categories", dof.alias("dof"), F.greatest(F.lit(0.0), F.col("rows") * (F.col("s") - 1)).alias("statistic"))
    p = F.when(F.col("dof") == 0, F.lit(1.0)).otherwise(upper_gamma_share(F.greatest(F.col("dof"), F.lit(1)) / 2.0, F.col("statistic") / 2.0))
    return out.withColumn("statistic", F.when(F.col("dof") == 0, F.lit(0.0)).otherwise(F.col("statistic"))).withColumn("p_value", p)


def select_wide(df: DataFrame, cols: Iterable[str], label: str, fpr: float = 0.05) -> DataFrame:
    """The rows of ``chi2_wide`` whose p-value is below ``fpr``."""
    return chi2_wide(df, cols, label).where(F.col("p_value") < fpr)
