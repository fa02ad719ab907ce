"""Queries over fraud-list joins, sampling, splitting, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import labels as lb
from riskloom.operators import order as od
from riskloom.plans.registry import query

KEYS = ["txn_id", "card", "place", "day"]
# The fraud list: large errors, once per day of report, so an entry may repeat.
FRAUD_SQL = """fraud AS (SELECT txn_id, card, place, CAST(ts AS DATE) AS day FROM txn WHERE label = 1 AND cents > 3000
  UNION ALL SELECT txn_id, card, place, CAST(ts AS DATE) FROM txn WHERE label = 1 AND cents > 9000)"""


def _txn(t):
    return t.txn.withColumn("day", F.to_date("ts"))


def _fraud(t):
    rows = _txn(t).where("label = 1")
    return rows.where("cents > 3000").select(*KEYS).unionByName(rows.where("cents > 9000").select(*KEYS))


@query(f"WITH {FRAUD_SQL} SELECT txn_id, card, cents FROM txn WHERE (txn_id, card, place, CAST(ts AS DATE)) IN (SELECT (txn_id, card, place, day) FROM fraud)"
       .replace("SELECT (txn_id, card, place, day) FROM", "SELECT txn_id, card, place, day FROM"))
def select_fraud(t):
    return lb.select_fraud(_txn(t), _fraud(t), KEYS).select("txn_id", "card", "cents")


@query(f"WITH {FRAUD_SQL} SELECT txn_id, card, cents FROM txn WHERE txn_id IN (SELECT txn_id FROM fraud)")
def select_fraud_by_trace(t):
    return lb.select_fraud(_txn(t), _fraud(t), ["txn_id"]).select("txn_id", "card", "cents")


@query(f"WITH {FRAUD_SQL} SELECT txn_id, card, cents FROM txn t WHERE NOT EXISTS (SELECT 1 FROM fraud f WHERE f.txn_id = t.txn_id AND f.card = t.card AND f.place = t.place AND f.day = CAST(t.ts AS DATE))")
def select_normal(t):
    return lb.select_normal(_txn(t), _fraud(t), KEYS).select("txn_id", "card", "cents")


@query(f"WITH {FRAUD_SQL} SELECT txn_id, CASE WHEN txn_id IN (SELECT txn_id FROM fraud) THEN 1e0 ELSE 0e0 END AS is_fraud FROM txn")
def label_transactions(t):
    return lb.label_transactions(_txn(t), _fraud(t), KEYS, "is_fraud").select("txn_id", "is_fraud")


@query("SELECT txn_id, card FROM txn WHERE card IN (SELECT card FROM txn WHERE place = 7)")
def related_rows(t):
    return lb.related_rows(t.txn, F.col("place") == 7, "card").select("txn_id", "card")


@query("SELECT txn_id, card FROM txn WHERE card NOT IN (SELECT card FROM txn WHERE label = 1 AND cents > 10000)")
def rows_without_listed_ids(t):
    return lb.anti_by_ids(t.txn, t.txn.where("label = 1 AND cents > 10000"), "card").select("txn_id", "card")


@query("""
SELECT o_orderkey, c_mktsegment, date_diff('day', (SELECT min(CAST(o_orderdate AS DATE)) FROM orders), CAST(o_orderdate AS DATE)) AS day_no
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
def dimension_columns(t):
    from riskloom.sources.readers import date_dim

    span = t.orders.agg(F.date_format(F.min("o_orderdate"), "yyyyMMdd"), F.date_format(F.max("o_orderdate"), "yyyyMMdd")).first()
    days = date_dim(t.spark, span[0], span[1]).select("pdate", "day_no")
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.date_format("o_orderdate", "yyyyMMdd").alias("pdate"))
    rows = lb.with_dimension(rows, t.customer.select("c_custkey", "c_mktsegment"), ["c_custkey"])
    return lb.with_dimension(rows, days, ["pdate"]).select("o_orderkey", "c_mktsegment", "day_no")


@query("""
SELECT txn_id, (CASE WHEN label = 1 THEN 'fraud' ELSE 'normal' END) || '_' || (CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' ELSE 'test' END) AS division FROM txn
""")
def division(t):
    return lb.with_division(t.txn, "label", F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")).select("txn_id", "division")


def bucket_sql(col: str, seed: int = 0, buckets: int = 1_000_000) -> str:
    return f"(('0x' || substr(md5(CAST({col} AS VARCHAR) || ':{seed}'), 1, 8))::BIGINT % {buckets})"


@query(f"SELECT txn_id FROM txn WHERE {bucket_sql('txn_id', 5)} < 100000")
def sample_fraction(t):
    return lb.sample_fraction(t.txn, "txn_id", 0.1, 5).select("txn_id")


@query("SELECT card FROM (SELECT DISTINCT card FROM txn) ORDER BY md5(CAST(card AS VARCHAR) || ':3'), card LIMIT 40")
def sample_cards_exactly(t):
    return lb.sample_n(t.txn, "card", 40, 3)


@query(f"""
WITH bad AS (SELECT card FROM txn WHERE label = 1 AND cents > 15000),
pool AS (SELECT DISTINCT card FROM txn WHERE {bucket_sql('txn_id', 1)} < 10000),
chosen AS (SELECT card FROM pool ORDER BY md5(CAST(card AS VARCHAR) || ':1'), card LIMIT (SELECT CAST(count(DISTINCT card) * 2 AS BIGINT) FROM bad))
SELECT txn_id, card FROM txn WHERE card IN (SELECT card FROM chosen) OR card IN (SELECT card FROM bad)
""")
def sampled_card_rows(t):
    bad = t.txn.where("label = 1 AND cents > 15000").select("card")
    return lb.sample_cards(t.txn, bad, "card", "txn_id", 2.0, 0.01, 1, population=1.0).select("txn_id", "card")


@query("SELECT txn_id, card FROM txn WHERE card NOT IN (SELECT card FROM txn GROUP BY card HAVING count(*) >= 80)")
def active_cards_capped(t):
    return lb.cap_activity(t.txn, "card", 80).select("txn_id", "card")


@query("""
SELECT txn_id, bad FROM (SELECT txn_id, card, CASE WHEN label = 1 AND cents > 15000 THEN 1 ELSE 0 END AS bad FROM txn)
WHERE bad = 1 OR card NOT IN (SELECT card FROM txn WHERE label = 1 AND cents > 15000)
""")
def confusable_rows_dropped(t):
    marked = t.txn.withColumn("bad", F.when((F.col("label") == 1) & (F.col("cents") > 15000), 1).otherwise(0))
    return lb.drop_confusable(marked, "card", "bad").select("txn_id", "bad")


@query(f"SELECT txn_id, label FROM txn WHERE (label = 0 AND {bucket_sql('txn_id', 0)} < 5000) OR label = 1")
def rebalanced_rows(t):
    return lb.rebalance(t.txn, "label", "txn_id", {0: 0.005}).select("txn_id", "label")


@query(f"SELECT txn_id, CASE WHEN {bucket_sql('txn_id', 9)} < 800000 THEN 0 WHEN {bucket_sql('txn_id', 9)} < 900000 THEN 1 ELSE 2 END AS part FROM txn")
def split_assignment(t):
    return lb.assign_split(t.txn, "txn_id", [0.8, 0.1, 0.1], 9).select("txn_id", "part")


@query("SELECT txn_id, card FROM txn WHERE CAST(ts AS DATE) = DATE '2024-01-15'")
def day_slice(t):
    return lb.day_slice(t.txn, "ts", "2024-01-15").select("txn_id", "card")


@query("""
SELECT txn_id, card FROM txn WHERE label = 1 AND CAST(ts AS DATE) < DATE '2024-01-11' UNION ALL
SELECT txn_id, card FROM txn WHERE label = 1 AND CAST(ts AS DATE) >= DATE '2024-01-21'
""")
def fraud_of_periods(t):
    first, last = (t.txn.where(F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz")),
                   t.txn.where(F.col("ts") >= F.lit("2024-01-21").cast("timestamp_ntz")))
    return lb.fraud_only("label", first, last).select("txn_id", "card")


# --- order ------------------------------------------------------------------------------------

@query("SELECT o_custkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderkey FROM orders ORDER BY o_custkey DESC, orders.o_orderdate DESC")
def secondary_sort(t):
    out = od.secondary_sort(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate"])
    return out.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT card, txn_id FROM txn ORDER BY card DESC, ts DESC")
def total_sort(t):
    return od.total_sort(t.txn, ["card", "ts"]).select("card", "txn_id")


@query("SELECT l_orderkey, l_linenumber, cents FROM lines ORDER BY cents DESC, l_orderkey, l_linenumber LIMIT 10")
def top_rows(t):
    return od.top_n(t.lines, "cents", 10, tie_break=["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "cents")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lines WHERE l_quantity IN (SELECT DISTINCT l_quantity FROM lines ORDER BY 1 DESC LIMIT 2)")
def top_rows_with_ties(t):
    return od.top_n(t.lines, "l_quantity", 2, "all").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_suppkey, CAST(sum(cents) AS BIGINT) AS total FROM lines GROUP BY l_suppkey ORDER BY total DESC, l_suppkey LIMIT 10")
def top_totals(t):
    return od.top_n_sum(t.lines, "l_suppkey", "cents", 10)


@query("""
WITH s AS (SELECT card, CAST(sum(place) AS BIGINT) AS total FROM txn GROUP BY card)
SELECT card, total FROM s WHERE total IN (SELECT DISTINCT total FROM s ORDER BY 1 DESC LIMIT 10)
""")
def top_totals_with_ties(t):
    return od.top_n_sum(t.txn, "card", "place", 10, "all").select("card", "total")


@query("SELECT txn_id FROM txn ORDER BY md5(CAST(txn_id AS VARCHAR) || ':4'), txn_id LIMIT 25")
def random_rows(t):
    return od.random_rows(t.txn, "txn_id", 25, 4).select("txn_id")


@query("SELECT txn_id FROM txn WHERE label = 1 UNION ALL SELECT txn_id FROM txn WHERE cents > 5000")
def union_of_parts(t):
    return od.union_all(t.txn.where("label = 1").select("txn_id"), t.txn.where("cents > 5000").select("txn_id"))


@query("SELECT card, place FROM txn EXCEPT SELECT card, place FROM txn WHERE label = 1")
def set_difference(t):
    return od.minus(t.txn.select("card", "place"), t.txn.where("label = 1").select("card", "place"))


@query("SELECT DISTINCT card, event_type FROM txn")
def distinct_pairs(t):
    return od.distinct(t.txn, ["card", "event_type"])
