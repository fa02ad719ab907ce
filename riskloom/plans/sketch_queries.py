"""Queries over sketches that were stored per day: only the stored rows of a range are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import sketches as sk
from riskloom.plans.registry import query
from riskloom.session import stored

COLS = ["event_type", "place", "cents"]
RANGE = ("2024-01-05", "2024-01-20")
IN_RANGE = f"CAST(ts AS DATE) BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'"
PROBABILITIES = [0.1, 0.25, 0.5, 0.75, 0.9]


def _stored(t):
    """The daily sketches of all transactions, as a job would leave them behind."""
    return stored(sk.daily_sketches(t.txn.withColumn("day", F.to_date("ts")), "day", COLS), "daily-sketches")


def _merged(t):
    return sk.merged(_stored(t), *RANGE)


@query(f"""
SELECT col, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS rows, count(value) AS n FROM (
  SELECT ts, 'event_type' AS col, event_type AS value FROM txn UNION ALL SELECT ts, 'place', CAST(place AS VARCHAR) FROM txn
  UNION ALL SELECT ts, 'cents', CAST(cents AS VARCHAR) FROM txn) WHERE {IN_RANGE} GROUP BY col
""")
def daily_sketch_counts(t):
    """Days, rows and values of each column, from as many stored rows as days and columns."""
    days = _stored(t).where(F.col("day").between(*[F.lit(d).cast("date") for d in RANGE]))
    return days.groupBy("col").agg(F.count(F.lit(1)).alias("days"), F.sum("rows").alias("rows"), F.sum("n").alias("n"))


# A column with fewer values than a sketch tracks is counted exactly, so the frequent values have a plain twin.
@query(f"""
WITH v AS (SELECT 'event_type' AS col, event_type AS value, count(*) AS cnt FROM txn WHERE {IN_RANGE} GROUP BY ALL
  UNION ALL SELECT 'place', CAST(place AS VARCHAR), count(*) FROM txn WHERE {IN_RANGE} GROUP BY ALL)
SELECT col, value, cnt FROM v WHERE cnt > 0.012 * (SELECT count(*) FROM txn WHERE {IN_RANGE})
""")
def frequent_from_sketches(t):
    return sk.frequent_estimates(_merged(t), 0.012, 1000).where("col <> 'cents'")


@query()
def distinct_from_sketches(t):
    """(col, n, distinct_cnt) of the range."""
    return sk.distinct_estimates(_merged(t))


@query()
def quantiles_from_sketches(t):
    """(col, probability, value) of the range, for the columns with numbers."""
    return sk.quantile_estimates(_merged(t), PROBABILITIES)


# The promise of the sketches: distinct counts within three standard errors, values within the rank error on both sides of their ties.
@query(f"""
SELECT unnest(['distinct event_type', 'distinct place', 'distinct cents', {', '.join(f"'cents {p}', 'place {p}'" for p in PROBABILITIES)}]) AS answer, true AS within_bound
""")
def sketch_checks(t):
    merged = stored(_merged(t), "merged-sketches")
    rows = t.txn.where(F.to_date("ts").between(*[F.lit(d).cast("date") for d in RANGE]))
    exact = rows.agg(*[F.count_distinct(c).alias(c) for c in COLS]).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("exact")) for c in COLS])).alias("r")).select("r.*")
    distinct = sk.distinct_estimates(merged).join(exact, "col").select(
        F.concat(F.lit("distinct "), "col").alias("answer"), (F.abs(F.col("distinct_cnt") / F.col("exact") - 1) <= 0.025).alias("within_bound"))
    found = sk.quantile_estimates(merged, PROBABILITIES)
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("x")) for c in ("cents", "place")])).alias("r")).select("r.*")
    met = long.join(F.broadcast(found), "col").groupBy("col", "probability").agg(  # ten answers at most
        F.avg((F.col("x") < F.col("value")).cast("int")).alias("low"), F.avg((F.col("x") <= F.col("value")).cast("int")).alias("high"))
    held = (F.col("low") - 0.006 <= F.col("probability")) & (F.col("probability") <= F.col("high") + 0.006)
    return distinct.unionByName(met.select(F.concat_ws(" ", "col", F.col("probability").cast("string")).alias("answer"), held.alias("within_bound")))
