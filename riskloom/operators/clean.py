"""Projection and cleaning: code splits, fills, casts, flags, row filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import bool_double, is_qr_extension, is_qr_pay_type


def split_code(df: DataFrame, cols: Iterable[str], width: int = 8, at: int = 4, strict: bool = True) -> DataFrame:
    """Add ``<c>_BK`` and ``<c>_RG``. A strict split leaves codes of another length whole in both."""
    out = []
    for c in cols:
        bank, region = F.substring(c, 1, at), F.substring(c, at + 1, width - at)
        if strict:
            fits = F.length(c) == width
            bank, region = F.when(fits, bank).otherwise(F.col(c)), F.when(fits, region).otherwise(F.col(c))
        out += [bank.alias(f"{c}_BK"), region.alias(f"{c}_RG")]
    return df.select("*", *out)


def fill_empty(df: DataFrame, cols: Iterable[str], empty: str = "NANs", null: str = "NULLs",
               suffix: str = "_filled") -> DataFrame:
    """Add ``<c>_filled`` where null and empty text are separate, visible categories."""
    return df.select("*", *[
        F.when(F.col(c).isNull(), F.lit(null)).when(F.col(c) == "", F.lit(empty)).otherwise(F.col(c)).alias(c + suffix)
        for c in cols
    ])


def fill_text(df: DataFrame, cols: Iterable[str], value: str = "NULL") -> DataFrame:
    return df.na.fill(value, subset=list(cols))


def fill_numeric(df: DataFrame, value: float = -1, cols: Iterable[str] | None = None) -> DataFrame:
    return df.na.fill(value, subset=list(cols)) if cols is not None else df.na.fill(value)


def drop_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(cols)) if cols is not None else df.na.drop()


def low_cardinality(df: DataFrame, cols: Iterable[str], limit: int = 500, exact: bool = True) -> list[str]:
    """Columns with fewer than ``limit`` values, decided in one pass over all of them.

    The exact count reduces the long form to distinct values before it counts, so rows are not expanded into the shuffle.
    """
    cols = list(cols)
    if exact:
        from riskloom.operators.profile import distinct_counts

        counts = {r["col"]: r["distinct_cnt"] for r in distinct_counts(df, cols).collect()}  # one row per column
    else:
        counts = df.agg(*[F.approx_count_distinct(F.col(c)).alias(c) for c in cols]).first().asDict()
    return [c for c in cols if counts.get(c, 0) < limit]


def to_double(df: DataFrame, cols: Iterable[str], keep: Iterable[str] = (), suffix: str = "_db") -> DataFrame:
    """Keep the key columns and cast the features; text that is no number becomes null."""
    return df.select(*keep, *[F.col(c).try_cast("double").alias(c + suffix) for c in cols])


def strip_suffix(df: DataFrame, suffix: str = "_filled") -> DataFrame:
    return df.withColumnsRenamed({c: c[: -len(suffix)] for c in df.columns if c.endswith(suffix)})


def select_features(df: DataFrame, keep: Iterable[str] | None = None, drop: Iterable[str] = ()) -> DataFrame:
    gone = set(drop)
    return df.select(*[c for c in (keep if keep is not None else df.columns) if c not in gone])


def flag_in(df: DataFrame, col: str | Column, values: Iterable, out: str, negate: bool = False) -> DataFrame:
    """1.0 when the value is in a short list. Long lists belong in a table: see ``flag_listed``."""
    c = F.col(col) if isinstance(col, str) else col
    hit = F.coalesce(c.isin(*values), F.lit(False))
    return df.withColumn(out, bool_double(~hit if negate else hit))


def flag_gt(df: DataFrame, col: str | Column, limit: float, out: str, negate: bool = False) -> DataFrame:
    c = F.col(col) if isinstance(col, str) else col
    return df.withColumn(out, bool_double(c <= limit if negate else c > limit))


def flag_expr(df: DataFrame, condition: Column, out: str, unknown: float = 0.0) -> DataFrame:
    """1.0 / 0.0 by a condition, ``unknown`` where it cannot be decided."""
    return df.withColumn(out, F.coalesce(bool_double(condition), F.lit(float(unknown))))


def risk_flag_pairs(df: DataFrame, rules: dict[str, tuple[str, Iterable | float]]) -> DataFrame:
    """``is_<name>`` / ``not_<name>`` pairs in one projection.

    A rule is ``(column, list)`` for membership or ``(column, number)`` for "greater than".
    """
    out = []
    for name, (col, rule) in rules.items():
        hit = F.col(col) > rule if isinstance(rule, (int, float)) else F.col(col).isin(*rule)
        hit = F.coalesce(hit, F.lit(False))
        out += [bool_double(hit).alias(f"is_{name}"), bool_double(~hit).alias(f"not_{name}")]
    return df.select("*", *out)


def qr_flag(df: DataFrame, col: str, out: str = "is_QR", pos: int | None = 27, allowed: tuple[str, ...] = ("Y", "Z")) -> DataFrame:
    """QR-payment mark, from a fixed position or (``pos=None``) from a leading digit."""
    c = F.col(col)
    return df.withColumn(out, is_qr_pay_type(c) if pos is None else is_qr_extension(c, pos, allowed))


def valuable_cards(stats: DataFrame, **bounds: tuple[float | None, float | None]) -> DataFrame:
    """Rows whose statistics all lie within inclusive ``column=(low, high)`` bounds."""
    keep = F.lit(True)
    for name, (low, high) in bounds.items():
        if low is not None:
            keep &= F.col(name) >= low
        if high is not None:
            keep &= F.col(name) <= high
    return stats.where(keep)


def compare_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: how often two columns are equal, greater, less, or zero."""
    x, y = F.col(a), F.col(b)
    return df.agg(
        F.count_if(x == y).alias("equal_cnt"), F.count_if(x > y).alias("greater_cnt"),
        F.count_if(x < y).alias("less_cnt"), F.count_if(x == 0).alias("left_zero_cnt"),
        F.count_if(y == 0).alias("right_zero_cnt"), F.count(F.lit(1)).alias("row_cnt"),
    )


def with_label(df: DataFrame, value: float, out: str = "label") -> DataFrame:
    return df.withColumn(out, F.lit(float(value)))


def drop_columns(df: DataFrame, *cols: str) -> DataFrame:
    return df.drop(*cols)
