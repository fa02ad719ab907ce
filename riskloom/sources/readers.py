"""Readers. Every one declares its schema, so nothing is read twice to be inferred."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import day_of_week, hour_of, parse_time
from riskloom.operators.clean import split_code
from riskloom.schema import FRAUD_LIST_COLUMNS, FRAUD_LIST_LONG_COLUMNS, INSTITUTION_CODES, indexed_schema, text_schema


def _days(start: str, end: str) -> list[str]:
    first, last = (date(int(d[:4]), int(d[4:6]), int(d[6:8])) for d in (start, end))
    return [(first + timedelta(i)).strftime("%Y%m%d") for i in range((last - first).days + 1)]


BAD = "bad_line"


def read_checked(spark: SparkSession, path: str | list[str], schema: T.StructType, **options) -> DataFrame:
    """Delimited text with two more columns: ``bad_line`` (the whole line if it has too few or too many fields or a value that is no number
    where one is declared, else null) and ``file``. Nothing is dropped; ``good_rows``, ``bad_lines`` and ``line_counts`` split the result.
    """
    declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*schema.fields, T.StructField(BAD, T.StringType())])
    # Lines are parsed as an expression: a line is bad or good whatever a query selects, also where it selects nothing but the bad lines.
    parsed = F.from_csv("value", F.lit(declared), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "columnPruning": "false", **options})
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(parsed.alias("r"), F.col("_metadata.file_path").alias("file")).select("r.*", "file")


def good_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.col(BAD).isNull()).drop(BAD, "file")


def bad_lines(checked: DataFrame) -> DataFrame:
    """(file, bad_line): the side output, to be written beside the good rows."""
    return checked.where(F.col(BAD).isNotNull()).select("file", BAD)


def line_counts(checked: DataFrame) -> DataFrame:
    """(file, good, bad) for every file with a line."""
    return checked.groupBy("file").agg(F.count_if(F.col(BAD).isNull()).alias("good"), F.count_if(F.col(BAD).isNotNull()).alias("bad"))


def read_daily_log(spark: SparkSession, base: str, start: str, end: str, columns: Sequence[str],
                   pattern: str = "{base}/{day}*", codes: Iterable[str] | None = None, checked: bool = False) -> DataFrame:
    """Quoted comma logs, one file or folder per day, for ``start`` .. ``end`` (``yyyyMMdd``), in one scan.

    ``pdate`` comes from the file name. Institution codes present in ``columns`` are split. The days are one glob, so a day
    without a file is no error. With ``checked`` the columns of ``read_checked`` are added; otherwise missing fields of a short line are null.
    """
    path = pattern.format(base=base, day="{" + ",".join(_days(start, end)) + "}")
    form = {"sep": ",", "quote": '"', "escape": '"'}
    raw = read_checked(spark, path, text_schema(columns), **form) if checked else spark.read.csv(path, schema=text_schema(columns), **form)
    more = [BAD, "file"] if checked else []
    source = F.split(F.col("file" if checked else "_metadata.file_path"), "/")
    name, parent = F.element_at(source, -1), F.element_at(source, -2)
    # A day begins the name of a file or folder, or follows "="; other digits are part of some file's random name.
    in_name, in_parent = (F.regexp_extract(x, r"^(?:[^/=]*=)?(\d{8})", 1) for x in (name, parent))
    pdate = F.when(in_name != "", in_name).otherwise(in_parent)
    df = raw.select(*columns, pdate.alias("pdate"), *more)
    wanted = codes if codes is not None else [c for c in INSTITUTION_CODES if c in columns]
    return split_code(df, wanted) if wanted else df


def read_fraud_list(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
                    sep: str = "\t", columns: Sequence[str] = tuple(FRAUD_LIST_COLUMNS), date_col: str = "pdate",
                    checked: bool = False) -> DataFrame:
    """Delimited fraud list, ``start <= date <= end``. With ``checked`` the columns of ``read_checked`` are added and bad lines stay whatever
    their date."""
    if checked:
        df = read_checked(spark, path, text_schema(columns), sep=sep)
        inside = (F.lit(True) if start is None else F.col(date_col) >= start) & (F.lit(True) if end is None else F.col(date_col) <= end)
        return df.where(F.col(BAD).isNotNull() | inside)
    df = spark.read.csv(path, schema=text_schema(columns), sep=sep)
    if start is not None:
        df = df.where(F.col(date_col) >= start)
    return df.where(F.col(date_col) <= end) if end is not None else df


def read_fraud_list_long(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The Control-A delimited form with terminal and region."""
    return read_fraud_list(spark, path, start, end, "\u0001", FRAUD_LIST_LONG_COLUMNS, "trans_dt")


def read_stage(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """A stage between jobs: Parquet, or with ``names`` imported comma text with all-string columns."""
    return spark.read.parquet(path) if names is None else spark.read.csv(path, schema=text_schema(names))


def read_labeled(spark: SparkSession, path: str, names: Sequence[str] | None = None, time_col: str = "tfr_dt_tm",
                 fmt: str = "MMddHHmmss", year: int | None = 2016) -> DataFrame:
    """A labelled stage with ``day_week`` and ``hour`` of the time text."""
    ts = parse_time(F.col(time_col), fmt, year)
    return read_stage(spark, path, names).select("*", day_of_week(ts).alias("day_week"), hour_of(ts).alias("hour"))


def read_indexed(spark: SparkSession, path: str, key: str, names: Sequence[str], checked: bool = False) -> DataFrame:
    """A key text and numbers. With ``checked``, lines that do not fit are told apart as ``read_checked`` does."""
    schema = indexed_schema(key, names)
    return read_checked(spark, path, schema) if checked else spark.read.csv(path, schema=schema)


def read_csv_typed(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def scan_range(spark: SparkSession, table: str, start, end, cols: Iterable[str], date_col: str = "pdate") -> DataFrame:
    """Projection of a table over a date range; the predicate prunes partitions or row groups."""
    source = spark.read.parquet(table) if "/" in table else spark.table(table)
    return source.where((F.col(date_col) >= start) & (F.col(date_col) <= end)).select(*cols)


def scan_listed_days(spark: SparkSession, table: str, listed: DataFrame, keys: Sequence[str], date_col: str = "pdate") -> DataFrame:
    """Rows of a date-partitioned table that are on a list of ``keys``, ``date_col`` among them; partitions of other days are not opened.

    The list is filtered and small against the log, so Spark runs it first and prunes the partitions at run time by its dates.
    """
    wanted = listed.where(F.col(date_col).isNotNull()).select(*keys).distinct()
    source = spark.read.parquet(table) if "/" in table else spark.table(table)
    return source.join(wanted, list(keys), "left_semi")


def read_ragged(spark: SparkSession, path: str, names: Sequence[str], types: Sequence[str],
                defaults: Sequence, sep: str = ",") -> DataFrame:
    """Comma text where a line with the wrong number of fields keeps its first and takes defaults."""
    lines = spark.read.text(path)
    # A trailing separator adds no field.
    body = F.regexp_replace("value", f"({sep})+$", "")
    parts = F.split(body, sep)
    whole = F.size(parts) == len(names)
    out = [F.element_at(parts, 1).try_cast(types[0]).alias(names[0])]
    for i, (name, kind, default) in enumerate(zip(names[1:], types[1:], defaults[1:]), start=2):
        out.append(F.when(whole, F.try_element_at(parts, F.lit(i)).try_cast(kind))
                   .otherwise(F.lit(default).cast(kind)).alias(name))
    return lines.select(*out)


def read_edges(spark: SparkSession, path: str, weighted: bool = True, indexed: bool = False) -> DataFrame:
    """Whitespace edge list. A bad weight counts 1.0; a line without two ends is dropped."""
    parts = F.split(F.trim("value"), r"\s+")
    kind = "bigint" if indexed else "string"
    weight = F.try_element_at(parts, F.lit(3)).try_cast("double") if weighted else F.lit(1.0)
    return spark.read.text(path).where(F.size(parts) >= 2).select(
        F.element_at(parts, 1).try_cast(kind).alias("src"), F.element_at(parts, 2).try_cast(kind).alias("dst"),
        F.coalesce(weight, F.lit(1.0)).alias("weight"),
    ).where(F.col("src").isNotNull() & F.col("dst").isNotNull())


def read_node_ids(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    return spark.read.csv(path, sep=sep, schema="name string, id bigint")


def read_risk_list(spark: SparkSession, path: str, col: str, kind: str = "string", columns: Sequence[str] | None = None) -> DataFrame:
    """One column of a headered report written by an earlier job, as distinct values. ``columns`` are those of the report (default: only ``col``)."""
    report = spark.read.csv(path, header=True, schema=text_schema(columns or [col]), enforceSchema=False)  # a header that differs is an error
    return report.select(F.col(col).try_cast(kind).alias(col)).where(F.col(col).isNotNull()).distinct()


def date_dim(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(pdate, day, day_no) for every day of the range; ``day_no`` counts from 0."""
    first, last = (F.to_date(F.lit(d), "yyyyMMdd") for d in (start, end))
    return spark.range(1).select(F.explode(F.sequence(first, last)).alias("day")).select(
        F.date_format("day", "yyyyMMdd").alias("pdate"), "day", F.date_diff("day", first).alias("day_no"))
