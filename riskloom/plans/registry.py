"""Registry of named queries over the tables of one folder, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Card transactions read off the event table; the same view on both sides of the comparison.
TXN_SQL = """txn AS (
  SELECT event_id AS txn_id, user_id AS card, ts, CAST(round(value * 100) AS BIGINT) AS cents, value AS amount,
         event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS place,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label
  FROM events)"""
LINES_SQL = """lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
         l_linestatus, l_shipdate, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
  FROM lineitem)"""


class Tables:
    """Lazy access to the tables of a folder, and the two transaction views."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def txn(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("txn_id"), F.col("user_id").alias("card"), "ts",
            F.round(F.col("value") * 100).cast("bigint").alias("cents"), F.col("value").alias("amount"), "event_type",
            F.get_json_object("props", "$.k").cast("int").alias("place"),
            (F.col("event_type") == "error").cast("int").alias("label"))

    @property
    def lines(self) -> DataFrame:
        return self.lineitem.select(
            "*", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
            (F.col("l_returnflag") == "R").cast("int").alias("label"))

    def scratch(self, name: str) -> str:
        """A fresh folder beside the checkpoints, for queries that write and read back."""
        return f"{ensure_checkpoint_dir(self.spark)}/{name}-{uuid.uuid4().hex}"


def query(sql: str | None = None, name: str | None = None):
    """Register ``fn(tables)`` under its own name. ``sql`` may use the ``txn`` and ``lines`` views."""

    def register(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[key] = _with_views(sql)
        return fn

    return register


def _with_views(sql: str) -> str:
    text = sql.strip()
    views = [v for word, v in ((" txn", TXN_SQL), (" lines", LINES_SQL)) if word in text.replace("\n", " ")]
    if not views:
        return text
    if text[:4].upper() == "WITH":
        return "WITH " + ", ".join(views) + ", " + text[4:].lstrip()
    return "WITH " + ", ".join(views) + "\n" + text


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that sums in another order compare equal."""
    return df.selectExpr(*[f"round(`{c}`, {digits}) AS `{c}`" if t == "double" else f"`{c}`" for c, t in df.dtypes])
