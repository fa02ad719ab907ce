"""Sketches stored per day and column, merged over any range of days without reading rows again.

One row per (day, column) holds the number of rows and of values and three sketches as binary columns: distinct values (HyperLogLog), quantiles
of the numbers (KLL) and frequent values. A range of d days over c columns reads d * c of these rows, however many transactions the days
have. Merging is associative, so merged rows may be stored and merged again (weeks, months).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.profile import melt

LG_K = 14  # distinct counts: a relative standard error of 0.8 %
KLL_K = 1000  # quantiles: a rank error of about 0.3 % at 99 % confidence
TRACKED = 10_000  # frequent values: counts are off by at most about rows / (0.75 * TRACKED), and exact while there are fewer values


def daily_sketches(df: DataFrame, day: str, cols: Iterable[str]) -> DataFrame:
    """(day, col, rows, n, distinct, quantiles, frequent) for every day and column; rows without a day have a row of their own.

    Values are compared as text; quantiles are those of the values that are numbers, null where a day has none. Days are combined on the map
    side, so a busy day is no large group.
    """
    long = melt(df, cols, [day])
    return long.groupBy(day, "col").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("n"), F.hll_sketch_agg("value", LG_K).alias("distinct"),
        F.kll_sketch_agg_double(F.col("value").try_cast("double"), KLL_K).alias("quantiles"),
        F.expr(f"approx_top_k_accumulate(value, {TRACKED})").alias("frequent")).withColumnRenamed(day, "day")


def merged(sketches: DataFrame, start=None, end=None) -> DataFrame:
    """(col, rows, n, distinct, quantiles, frequent) of the days from ``start`` to ``end``, both included; no bound means all."""
    inside = sketches
    if start is not None:
        inside = inside.where(F.col("day") >= start)
    if end is not None:
        inside = inside.where(F.col("day") <= end)
    return inside.groupBy("col").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent"))


def distinct_estimates(merged_rows: DataFrame) -> DataFrame:
    """(col, n, distinct_cnt)."""
    return merged_rows.select("col", "n", F.hll_sketch_estimate("distinct").alias("distinct_cnt"))


def quantile_estimates(merged_rows: DataFrame, probabilities: Iterable[float]) -> DataFrame:
    """(col, probability, value) for columns with numbers."""
    known = merged_rows.where(F.col("quantiles").isNotNull() & (F.kll_sketch_get_n_double("quantiles") > 0))
    at = F.array(*[F.lit(float(p)) for p in probabilities])
    values = F.kll_sketch_get_quantile_double("quantiles", at)
    return known.select("col", F.explode(F.arrays_zip(at.alias("probability"), values.alias("value"))).alias("q")).select("col", "q.*")


def frequent_estimates(merged_rows: DataFrame, share: float, most: int = 100) -> DataFrame:
    """(col, value, cnt): up to ``most`` values per column that hold more than ``share`` of its values."""
    found = F.expr(f"approx_top_k_estimate(frequent, {most})")
    rows = merged_rows.select("col", "n", F.explode(found).alias("f"))
    return rows.where((F.col("f.count") > share * F.col("n")) & F.col("f.item").isNotNull()).select("col", F.col("f.item").alias("value"), F.col("f.count").alias("cnt"))
