"""Queries over ordered features. The ``*_split`` ones use so many parts that most keys span several."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import labels
from riskloom.operators import windows as w
from riskloom.plans.registry import query, rounded

CARD = ("card", "ts", "txn_id")
SPLIT = {"parts": 97}

PREV_SQL = """
WITH p AS (SELECT *, lag(ts) OVER o AS pt, lag(cents) OVER o AS pa, lag(place) OVER o AS pp, lag(event_type) OVER o AS pe
  FROM txn WINDOW o AS (PARTITION BY card ORDER BY ts, txn_id))
SELECT txn_id, pa AS last_amount, CAST(abs(cents - pa) AS DOUBLE) AS amount_gap, CASE WHEN pa IS NULL THEN NULL WHEN cents = pa THEN 1e0 ELSE 0e0 END AS amount_eq_last,
  CASE WHEN pa IS NULL OR cents = 0 THEN NULL WHEN abs(cents - pa) / CAST(cents AS DOUBLE) <= 0.01 THEN 1e0 ELSE 0e0 END AS amount_near_last,
  CAST(cents - pa AS DOUBLE) AS amount_change, epoch_us(pt) AS last_us,
  CASE WHEN pp IS NOT NULL AND place <> pp THEN 1e0 ELSE 0e0 END AS is_place_changed,
  CASE WHEN pe IS NOT NULL AND event_type <> pe THEN 1e0 ELSE 0e0 END AS is_event_type_changed
FROM p
"""
PREV_COLS = ["txn_id", "last_amount", "amount_gap", "amount_eq_last", "amount_near_last", "amount_change", "last_us",
             "is_place_changed", "is_event_type_changed"]


def _previous(t, **split):
    df = w.previous_features(t.txn, *CARD, "cents", ["place", "event_type"], **split)
    return df.withColumn("last_us", F.unix_micros(F.col("last_ts").cast("timestamp"))).select(*PREV_COLS)


@query(PREV_SQL)
def previous_row_features(t):
    return _previous(t)


@query(PREV_SQL)
def previous_row_features_split(t):
    return _previous(t, **SPLIT)


def _frame_sql(f: w.Frame) -> str:
    if f.kind == "rows":
        return f"(PARTITION BY card ORDER BY ts, txn_id ROWS BETWEEN {-f.start} PRECEDING AND CURRENT ROW)"
    if f.kind == "time":
        return f"(PARTITION BY card ORDER BY us RANGE BETWEEN {-f.start * 1_000_000} PRECEDING AND CURRENT ROW)"
    start = "UNBOUNDED PRECEDING" if f.start is None else f"{-f.start} PRECEDING"
    end = "CURRENT ROW" if f.end == 0 else f"{-f.end} PRECEDING"
    return f"(PARTITION BY card ORDER BY day RANGE BETWEEN {start} AND {end})"


def velocity_sql(frames, fraud: bool = True) -> str:
    cols, windows = [], []
    for f in frames:
        n, own = f.name, 1 if f.has_self else 0
        windows.append(f"{n} AS {_frame_sql(f)}")
        cols += [
            f"CAST(sum(cents) OVER {n} AS BIGINT) AS {n}_tot_amt", f"count(cents) OVER {n} AS {n}_tot_cnt",
            f"max(cents) OVER {n} AS {n}_max_amt", f"min(cents) OVER {n} AS {n}_min_amt",
            f"round(CAST(sum(cents) OVER {n} AS DOUBLE) / nullif(count(cents) OVER {n}, 0), 6) AS {n}_avg_amt",
            f"CASE WHEN count(cents) OVER {n} = {own} THEN 1 ELSE 0 END AS {n}_no_trans",
            f"CAST(coalesce(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER {n}, 0) AS BIGINT) AS {n}_query_cnt",
            f"CAST(coalesce(sum(CASE WHEN place >= 90 THEN 1 ELSE 0 END) OVER {n}, 0) AS BIGINT) AS {n}_highrisk_cnt",
            f"min(gap) OVER {n} AS {n}_min_interval",
            f"round(sum(gap) OVER {n} / nullif(count(gap) OVER {n}, 0), 6) AS {n}_avg_interval",
            f"CAST(coalesce(sum(CASE WHEN exact <= 5 THEN 1 ELSE 0 END) OVER {n}, 0) AS BIGINT) AS {n}_freq_cnt",
        ]
        if fraud and not f.has_self:
            cols.append(f"CAST(coalesce(sum(label) OVER {n}, 0) AS BIGINT) AS {n}_fraud_cnt")
    return f"""
WITH e AS (SELECT *, epoch_us(ts) AS us, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day,
    (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY card ORDER BY ts, txn_id))) / 6e7 AS exact FROM txn),
g AS (SELECT *, ceil(exact) AS gap FROM e)
SELECT txn_id, {', '.join(cols)}
FROM g WINDOW {', '.join(windows)}"""


def _velocity(t, frames, **parts):
    df = w.prev_interval(t.txn, *CARD, **parts)
    out = w.velocity(df, *CARD, "cents", frames, {"query": F.col("event_type") == "view", "highrisk": F.col("place") >= 90},
                     "interval_minutes", "interval_bucket", "label", **parts)
    return rounded(out.select("txn_id", *[c for c in out.columns if c not in df.columns]))


DAY_FRAMES = [w.TODAY, w.DAY1_INCL, w.DAY3_INCL, w.DAY3, w.DAY7, w.DAY30, w.HISTORY]
TIME_FRAMES = [w.MIN5, w.MIN15, w.HOUR1, w.HOUR2, w.MIN120]
ROW_FRAMES = [w.LAST1, w.LAST3]


@query(velocity_sql(DAY_FRAMES))
def velocity_day_frames(t):
    return _velocity(t, DAY_FRAMES)


@query(velocity_sql(TIME_FRAMES))
def velocity_time_frames(t):
    return _velocity(t, TIME_FRAMES)


@query(velocity_sql(ROW_FRAMES))
def velocity_row_frames(t):
    return _velocity(t, ROW_FRAMES)


@query(velocity_sql([*DAY_FRAMES[3:], w.MIN15, w.HOUR2, w.LAST3]))
def velocity_split(t):
    return _velocity(t, [*DAY_FRAMES[3:], w.MIN15, w.HOUR2, w.LAST3], **SPLIT)


MOVING_SQL = """
SELECT txn_id, round(avg(cents) OVER (PARTITION BY card ORDER BY ts, txn_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS moving_avg FROM txn
"""


@query(MOVING_SQL)
def moving_average(t):
    return rounded(w.moving_average(t.txn, *CARD, "cents").select("txn_id", "moving_avg"))


@query(MOVING_SQL)
def moving_average_split(t):
    return rounded(w.moving_average(t.txn, *CARD, "cents", **SPLIT).select("txn_id", "moving_avg"))


REVISIT_SQL = """
WITH v AS (SELECT DISTINCT card, place, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day FROM txn),
s AS (SELECT card, place, min(gap) AS gap FROM (SELECT *, day - lag(day) OVER (PARTITION BY card, place ORDER BY day) AS gap FROM v) GROUP BY ALL)
SELECT card, count(*) FILTER (WHERE gap <= 3) AS places_day3_cnt, count(*) FILTER (WHERE gap <= 7) AS places_day7_cnt,
  count(*) FILTER (WHERE gap <= 30) AS places_day30_cnt FROM s GROUP BY card
"""


@query(REVISIT_SQL)
def places_revisited(t):
    return w.places_revisited(t.txn, "card", "place", "ts")


HISTORY_SQL = """
days AS (SELECT l_suppkey, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS n, sum(label) AS f FROM lines
  WHERE l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY ALL),
counts AS (SELECT l_suppkey, n,
  CAST(coalesce(sum(f) OVER (PARTITION BY l_suppkey ORDER BY n RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS day3_fcnt,
  CAST(coalesce(sum(f) OVER (PARTITION BY l_suppkey ORDER BY n RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS day7_fcnt,
  CAST(coalesce(sum(f) OVER (PARTITION BY l_suppkey ORDER BY n RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS day30_fcnt FROM days)"""


def _history(t):
    return w.entity_fraud_history(t.lines, t.lines.where("label = 1"), "l_suppkey", "l_shipdate")


@query(f"WITH {HISTORY_SQL.strip()} SELECT l_suppkey, CAST(DATE '1970-01-01' + CAST(n AS INTEGER) AS VARCHAR)[:10] AS day, day3_fcnt, day7_fcnt, day30_fcnt FROM counts")
def merchant_fraud_history(t):
    return _history(t).select("l_suppkey", F.date_from_unix_date("_day").cast("string").alias("day"), "day3_fcnt", "day7_fcnt", "day30_fcnt")


# Written without windows: count the frauds of the days before each row directly.
@query("""
WITH frauds AS (SELECT l_suppkey AS s, CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lines WHERE label = 1 GROUP BY ALL)
SELECT l_orderkey, l_linenumber,
  CAST(coalesce(sum(n) FILTER (WHERE d >= CAST(l_shipdate AS DATE) - 3), 0) AS BIGINT) AS day3_fcnt,
  CAST(coalesce(sum(n) FILTER (WHERE d >= CAST(l_shipdate AS DATE) - 7), 0) AS BIGINT) AS day7_fcnt,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS day30_fcnt
FROM lines LEFT JOIN frauds ON l_suppkey = s AND d >= CAST(l_shipdate AS DATE) - 30 AND d < CAST(l_shipdate AS DATE)
GROUP BY l_orderkey, l_linenumber, l_shipdate, l_suppkey""")
def merchant_fraud_history_on_rows(t):
    return labels.with_fraud_history(t.lines, _history(t), "l_suppkey", "l_shipdate").select(
        "l_orderkey", "l_linenumber", "day3_fcnt", "day7_fcnt", "day30_fcnt")
