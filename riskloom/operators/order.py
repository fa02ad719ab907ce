"""Sorts, top lists and set operations."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def secondary_sort(df: DataFrame, by: Iterable[str], within: Iterable[str] = (), descending: bool = True) -> DataFrame:
    """Order by the key columns, then by ``within``, through range partitions over all of them.

    The later columns take part in the ranges, so one frequent key is spread over several tasks.
    """
    order = [F.desc(c) if descending else F.asc(c) for c in (*by, *within)]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def total_sort(df: DataFrame, by: Iterable[str], descending: bool = True) -> DataFrame:
    return df.orderBy(*[F.desc(c) if descending else F.asc(c) for c in by])


def top_n(df: DataFrame, by: str, n: int, ties: str = "one", tie_break: Iterable[str] = ()) -> DataFrame:
    """The ``n`` largest rows, or with ``ties="all"`` every row of the ``n`` largest values."""
    if ties == "one":
        return df.orderBy(F.desc(by), *tie_break).limit(n)
    best = df.select(by).distinct().orderBy(F.desc(by)).limit(n)
    return df.join(F.broadcast(best), by, "left_semi")  # n rows


def top_n_sum(df: DataFrame, key: str, value: str, n: int, ties: str = "one") -> DataFrame:
    """Largest totals per key."""
    totals = df.groupBy(key).agg(F.sum(value).alias("total"))
    return top_n(totals, "total", n, ties, [key])


def head(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def random_rows(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in a random but repeatable order."""
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    return df.orderBy(digest, id_col).limit(n)


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``."""
    return a.subtract(b)


def distinct(df: DataFrame, cols: Iterable[str | Column]) -> DataFrame:
    return df.select(*cols).distinct()
