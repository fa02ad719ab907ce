"""Joins back to rows where one key may own a large share of them.

There is one plan for every key. Grouping is safe, because Spark combines on the map side. A join against a table that holds a key
once is an equi-join, where adaptive execution measures the shuffled partitions and splits those of a hot key. Ordered features are cut
into parts of equal size in ``windows``. Nothing here lists hot keys, counts rows to choose a plan, or runs a job while planning.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "left",
                   small: bool = False) -> DataFrame:
    """Join on ``keys`` where null meets null, as it does in grouping. ``small`` marks a bounded right side."""
    keys = list(keys)
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    joined = left.join(F.broadcast(renamed) if small else renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def join_unique(df: DataFrame, unique: DataFrame, keys: Iterable[str], how: str = "left") -> DataFrame:
    """Join rows to a table that holds each key once. Adaptive execution splits a hot key's rows and repeats its one row."""
    return null_safe_join(df, unique, keys, how)


def part_borders(df: DataFrame, keys: Iterable[str], order: str, tie: str, parts: int | None = None) -> DataFrame:
    """(keys, ``_borders``): sorted (order, tie) of sampled rows, for keys with a row in the sample.

    The sample holds ``parts`` - 1 rows (default: the session's shuffle partitions), so the table is bounded and may be broadcast. It is drawn by
    a hash of (keys, order, tie), so every use of it is the same and no job runs for it while a plan is built. A key with a third of all rows
    has about a third of the borders.
    """
    keys = list(keys)
    number = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = df.select(*keys, F.col(order).alias("_t"), F.col(tie).alias("_i")).orderBy(
        F.xxhash64(*keys, "_t", "_i"), *keys, "_t", "_i").limit(max(1, number - 1))
    return drawn.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct(F.col("_t").alias("t"), F.col("_i").alias("i")))).alias("_borders"))


def part_number(order: str, tie: str, most: int) -> Column:
    """How many of the row's ``_borders`` stand at or before (order, tie), by binary search; 0 for a key without any."""
    here = F.struct(F.col(order).alias("t"), F.col(tie).alias("i"))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get("_borders", at + s - 1) <= here, at + s).otherwise(at))
