"""Queries over profiles, risk lists and column analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import clean, labels
from riskloom.operators import profile as pf
from riskloom.operators.clean import risk_flag_pairs
from riskloom.plans.registry import query, rounded
from riskloom.schema import (
    CARDHOLDER_FAILURE_CODES, HIGH_RISK_MCC, HIGH_RISK_REGION_PREFIXES, LOW_RISK_MCC, MCC_GROUPS, RESPONSE_OK,
)

MONTHS = 79


ORDER_CENTS = "(SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"


def _order_cents(t):
    return t.orders.withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))


@query(f"""
SELECT o_custkey, CAST(sum(cents) AS BIGINT) AS amount_sum, round(avg(cents), 6) AS amount_avg, round(stddev_samp(cents), 2) AS amount_std,
  count(*) AS txn_cnt, count(DISTINCT CAST(o_orderdate AS DATE)) AS active_days, count(DISTINCT date_trunc('month', o_orderdate)) AS active_months,
  round(sum(cents) / CAST({MONTHS} AS DOUBLE), 4) AS amount_per_month, round(count(*) / CAST({MONTHS} AS DOUBLE), 4) AS cnt_per_month
FROM {ORDER_CENTS} GROUP BY o_custkey
""")
def spend_profile(t):
    p = pf.spend_profile(_order_cents(t), "o_custkey", "cents", "o_orderdate", MONTHS)
    digits = {"amount_avg": 6, "amount_std": 2, "amount_per_month": 4, "cnt_per_month": 4}
    return p.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(f"SELECT o_custkey, round(avg(cents), 6) AS amount_avg FROM {ORDER_CENTS} GROUP BY o_custkey")
def mean_spend(t):
    return rounded(pf.mean_by(_order_cents(t), "o_custkey", "cents"))


QR_SQL = """
SELECT card, count(*) FILTER (WHERE f = 1) AS QR_cnt, round(count(*) FILTER (WHERE f = 1) / CAST(count(f) AS DOUBLE), 6) AS QR_cnt_ratio,
  round(avg(cents) FILTER (WHERE f = 1), 6) AS QR_avg_RMB, count(DISTINCT CAST(ts AS DATE)) FILTER (WHERE f = 1) AS QR_date_cnt,
  count(DISTINCT place) FILTER (WHERE f = 1) AS QR_mcc_tps
FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS f FROM {source}) GROUP BY card HAVING count(*) FILTER (WHERE f = 1) > 0
"""


def _qr_rows(t):
    return clean.flag_in(t.txn, "event_type", ["purchase"], "f").withColumn("day", F.to_date("ts"))


def _qr_profile(t):
    return pf.qr_profile(_qr_rows(t), "card", "f", "cents", "day", "place")


@query(QR_SQL.format(source="txn"))
def qr_profile(t):
    return rounded(_qr_profile(t))


@query("SELECT card, QR_cnt, QR_cnt_ratio FROM (" + QR_SQL.format(source="txn") +
       ") WHERE QR_cnt BETWEEN 10 AND 1000 AND QR_cnt_ratio >= 0.15 AND QR_date_cnt >= 5")
def valuable_cards(t):
    kept = clean.valuable_cards(rounded(_qr_profile(t)), QR_cnt=(10, 1000), QR_cnt_ratio=(0.15, None), QR_date_cnt=(5, None))
    return kept.select("card", "QR_cnt", "QR_cnt_ratio")


VALUABLE_SQL = "SELECT card FROM (" + QR_SQL.format(source="txn") + ") WHERE QR_cnt BETWEEN 10 AND 1000"


@query(f"SELECT txn_id, card, cents FROM txn WHERE card IN ({VALUABLE_SQL})")
def valuable_card_rows(t):
    kept = clean.valuable_cards(_qr_profile(t), QR_cnt=(10, 1000))
    return labels.semi_by_ids(t.txn, kept, "card").select("txn_id", "card", "cents")


@query(f"""
SELECT count(DISTINCT card) AS card_cnt, count(DISTINCT card) FILTER (WHERE v) AS valuable_card_cnt, count(*) AS txn_cnt,
  count(*) FILTER (WHERE v) AS valuable_txn_cnt, count(*) FILTER (WHERE q) AS qr_txn_cnt, count(*) FILTER (WHERE v AND q) AS valuable_qr_txn_cnt,
  round(sum(cents) / 100.0, 2) AS amount, round(coalesce(sum(cents) FILTER (WHERE v), NULL) / 100.0, 2) AS valuable_amount,
  round(sum(cents) FILTER (WHERE v AND q) / 100.0, 2) AS valuable_qr_amount
FROM (SELECT *, card IN ({VALUABLE_SQL}) AS v, event_type = 'purchase' AS q FROM txn)
""")
def population_report(t):
    kept = clean.valuable_cards(_qr_profile(t), QR_cnt=(10, 1000))
    return rounded(pf.population_report(_qr_rows(t), kept, "card", "cents", "f"), 2)


@query("""
SELECT card, count(*) FILTER (WHERE event_type = 'view') AS view_cnt, count(*) FILTER (WHERE cents > 10000) AS large_cnt,
  count(*) FILTER (WHERE label = 1 AND cents > 5000) AS bad_large_cnt FROM txn GROUP BY card
""")
def conditional_counts(t):
    return pf.count_where(t.txn, "card", {
        "view": F.col("event_type") == "view", "large": F.col("cents") > 10000,
        "bad_large": (F.col("label") == 1) & (F.col("cents") > 5000)})


@query("""
SELECT card, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT place) AS places_cnt,
  count(DISTINCT substr(CAST(place AS VARCHAR), 1, 1)) AS provinces_cnt FROM txn GROUP BY ALL
""")
def distinct_places_by_day(t):
    return pf.distinct_places(t.txn, "card", "place", "ts", 1).withColumn("day", F.col("day").cast("string"))


@query("""
SELECT card, count(DISTINCT place) AS places_cnt, count(DISTINCT substr(CAST(place AS VARCHAR), 1, 1)) AS provinces_cnt
FROM txn GROUP BY card
""")
def distinct_places(t):
    return pf.distinct_places(t.txn, "card", "place", province_chars=1)


@query("""
WITH d AS (SELECT card, CAST(ts AS DATE) AS day, count(DISTINCT place) AS cur_tot_locs, count(DISTINCT substr(CAST(place AS VARCHAR), 1, 2)) AS cur_tot_provs
  FROM txn GROUP BY ALL), a AS (SELECT card, count(DISTINCT place) AS tot_locs, count(DISTINCT substr(CAST(place AS VARCHAR), 1, 2)) AS tot_provs FROM txn GROUP BY card)
SELECT txn_id, cur_tot_locs, cur_tot_provs, tot_locs, tot_provs FROM txn t JOIN d ON t.card = d.card AND CAST(t.ts AS DATE) = d.day
JOIN a ON t.card = a.card
""")
def place_counts_on_rows(t):
    return pf.with_place_counts(t.txn, "card", "place", "ts").select(
        "txn_id", "cur_tot_locs", "cur_tot_provs", "tot_locs", "tot_provs")


@query("""
SELECT card, arg_max(place, (n, place)) AS mode_place, max(n) AS mode_place_cnt
FROM (SELECT card, place, count(*) AS n FROM txn GROUP BY ALL) GROUP BY card
""")
def mode_place(t):
    return pf.mode_by(t.txn, "card", "place")


@query("""
WITH m AS (SELECT card, arg_max(place, (n, place)) AS mode_place, max(n) AS mode_place_cnt
  FROM (SELECT card, place, count(*) AS n FROM txn GROUP BY ALL) GROUP BY card)
SELECT txn_id, mode_place_cnt, CASE WHEN place = mode_place THEN 1e0 ELSE 0e0 END AS is_frequent_place,
  CASE WHEN mode_place IN (39, 40, 41, 42, 43, 44, 64) THEN 1e0 ELSE 0e0 END AS is_mode_place_risky
FROM txn JOIN m USING (card)
""")
def mode_flags(t):
    return pf.with_mode_flags(t.txn, "card", "place", [39, 40, 41, 42, 43, 44, 64]).select(
        "txn_id", "mode_place_cnt", "is_frequent_place", "is_mode_place_risky")


@query("""
SELECT o_custkey, count(*) FILTER (WHERE p_type IN ('PROMO', 'SMALL')) AS light_cnt, count(*) FILTER (WHERE p_type IN ('ECONOMY')) AS economy_cnt,
  count(*) FILTER (WHERE p_type IN ('LARGE', 'STANDARD', 'MEDIUM')) AS heavy_cnt
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_custkey
""")
def category_group_counts(t):
    rows = t.orders.select("o_orderkey", "o_custkey").join(
        t.lineitem.select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(
        t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return pf.group_counts(rows, "o_custkey", "p_type", {
        "light": ["PROMO", "SMALL"], "economy": ["ECONOMY"], "heavy": ["LARGE", "STANDARD", "MEDIUM"]})


@query("""
SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS "1-URGENT_cnt",
  count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS "5-LOW_cnt" FROM orders GROUP BY o_custkey
""")
def single_code_counts(t):
    return pf.code_counts(t.orders, "o_custkey", "o_orderpriority", ["1-URGENT", "5-LOW"])


@query("""
SELECT l_partkey, s_nationkey AS list_name, count(*) AS list_cnt FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL
""")
def merchant_list_counts(t):
    lists = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("list_name"))
    return pf.listed_counts(t.lineitem, "l_partkey", "l_suppkey", lists)


@query("""
SELECT l_suppkey, sum(a) AS is_large_cnt, round(sum(a) / count(a), 6) AS is_large_ratio, sum(b) AS is_returned_cnt,
  round(sum(b) / count(b), 6) AS is_returned_ratio
FROM (SELECT l_suppkey, CASE WHEN cents > 5000000 THEN 1e0 ELSE 0e0 END AS a, CAST(label AS DOUBLE) AS b FROM lines) GROUP BY l_suppkey
""")
def risk_flag_ratios(t):
    df = clean.flag_in(clean.flag_gt(t.lines, "cents", 5_000_000, "is_large"), "label", [1], "is_returned")
    return rounded(pf.flag_ratios(df, "l_suppkey", ["is_large", "is_returned"]))


@query("""
SELECT l_suppkey, sum(CASE WHEN cents > 5000000 THEN 1e0 ELSE 0e0 END) AS is_large_cnt, sum(CAST(label AS DOUBLE)) AS is_returned_cnt
FROM lines GROUP BY l_suppkey
""")
def risk_flag_counts(t):
    df = clean.flag_in(clean.flag_gt(t.lines, "cents", 5_000_000, "is_large"), "label", [1], "is_returned")
    return pf.flag_counts(df, "l_suppkey", ["is_large", "is_returned"])


RISK_SQL = """
v AS (SELECT l_partkey, 1 AS bad_seen, CASE WHEN max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) = 1 THEN 0 ELSE 1 END AS risk_only
  FROM lineitem GROUP BY l_partkey HAVING max(label_bad(l_returnflag)) = 1)""".replace(
    "label_bad(l_returnflag)", "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 45 THEN 1 ELSE 0 END")


def _risk_rows(t):
    bad = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45)
    return t.lineitem.withColumn("state", F.when(bad, 0).when(F.col("l_returnflag") == "N", 1).otherwise(-1))


@query(f"WITH {RISK_SQL.strip()} SELECT l_partkey, bad_seen, risk_only FROM v")
def learned_risk_values(t):
    from riskloom.operators.profile import learn_risk_values

    return learn_risk_values(_risk_rows(t), "l_partkey", "state")


@query(f"""
WITH {RISK_SQL.strip()}
SELECT l_suppkey, CAST(count(bad_seen) AS BIGINT) AS bad_cnt, CAST(coalesce(sum(risk_only), 0) AS BIGINT) AS risk_cnt, count(*) AS txn_cnt,
  CASE WHEN count(bad_seen) > 0 THEN 1e0 ELSE 0e0 END AS has_bad, CASE WHEN coalesce(sum(risk_only), 0) > 0 THEN 1e0 ELSE 0e0 END AS has_risk,
  round(count(bad_seen) / CAST(count(*) AS DOUBLE), 6) AS bad_ratio, round(coalesce(sum(risk_only), 0) / CAST(count(*) AS DOUBLE), 6) AS risk_ratio
FROM lineitem LEFT JOIN v USING (l_partkey) GROUP BY l_suppkey
""")
def risk_exposure(t):
    rows = _risk_rows(t)
    return rounded(pf.risk_exposure(rows, "l_suppkey", "l_partkey", pf.learn_risk_values(rows, "l_partkey", "state")))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000) THEN 1e0 ELSE 0e0 END AS at_risk
FROM lineitem
""")
def listed_merchant_flag(t):
    listed = t.supplier.where(F.col("s_acctbal") < 2000).select("s_suppkey")
    return pf.flag_listed(t.lineitem, "l_suppkey", listed, "at_risk").select("l_orderkey", "l_linenumber", "at_risk")


CROSSTAB_SQL = """
SELECT col, value, count(*) FILTER (WHERE state = 0) AS n0, count(*) FILTER (WHERE state = 1) AS n1, count(*) FILTER (WHERE state = -1) AS n_unknown,
  round(count(*) FILTER (WHERE state = 1) / nullif(CAST(count(*) FILTER (WHERE state = 0) AS DOUBLE), 0), 6) AS ratio
FROM (
  SELECT 'l_suppkey' AS col, CAST(l_suppkey AS VARCHAR) AS value, state FROM r UNION ALL
  SELECT 'l_linestatus', l_linestatus, state FROM r UNION ALL
  SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), state FROM r) GROUP BY ALL"""
STATE_SQL = "WITH r AS (SELECT *, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE -1 END AS state FROM lineitem) "
STATE_COLS = ["l_suppkey", "l_linestatus", "l_linenumber"]


def _state(t):
    return t.lineitem.withColumn("state", F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "N", 1).otherwise(-1))


@query(STATE_SQL + CROSSTAB_SQL)
def crosstab_ratios(t):
    return rounded(pf.crosstab_ratio(_state(t), STATE_COLS, "state"))


@query(STATE_SQL + f"SELECT * FROM ({CROSSTAB_SQL}) WHERE n0 > 10 AND n_unknown > 10 AND ratio < 1")
def crosstab_risk_values(t):
    return rounded(pf.risk_values(_state(t), STATE_COLS, "state"))


@query("""
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O",
  count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY o_orderpriority
""")
def crosstab_two_columns(t):
    return pf.crosstab(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def _describe_sql(cols):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS col, count({c}) AS cnt, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
        f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem" for c in cols)


@query(_describe_sql(["l_quantity", "l_discount", "l_linenumber"]))
def describe_columns(t):
    return rounded(pf.describe(t.lineitem, ["l_quantity", "l_discount", "l_linenumber"]), 4)


@query(" UNION ALL ".join(f"SELECT '{c}' AS col, round(corr({c}, label), 6) AS corr FROM lines" for c in ("l_quantity", "cents", "l_tax")))
def label_correlation(t):
    return rounded(pf.label_corr(t.lines, ["l_quantity", "cents", "l_tax"], "label"))


@query("""
SELECT col, value, cnt FROM (
  SELECT 'o_orderstatus' AS col, o_orderstatus AS value, count(*) AS cnt FROM orders GROUP BY ALL UNION ALL
  SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL UNION ALL
  SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM orders GROUP BY ALL) WHERE cnt > 0.2 * (SELECT count(*) FROM orders)
""")
def frequent_items(t):
    return pf.freq_items(t.orders, ["o_orderstatus", "o_orderpriority", "o_custkey"], 0.2)


@query("""
SELECT p AS probability, round(v, 4) AS value FROM (
  SELECT unnest([0.2, 0.4, 0.6, 0.8]::DOUBLE[]) AS p, unnest(quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8])) AS v FROM orders)
""")
def exact_quantiles(t):
    return rounded(pf.quantiles(t.orders, "o_totalprice", [0.2, 0.4, 0.6, 0.8], exact=True), 4)


@query()
def approximate_quantiles(t):
    """(p, value, rank): the sketch's values and the share of rows at or below each."""
    found = pf.quantiles(t.orders, "o_totalprice", [0.1, 0.25, 0.5, 0.75, 0.9])
    # One pass over the rows; the few values are one row.
    values = found.agg(F.sort_array(F.collect_list(F.struct("probability", "value"))).alias("vs")).withColumn("k", F.lit(0))
    rows = t.orders.where("o_totalprice IS NOT NULL").select(F.lit(0).alias("k"), "o_totalprice").join(F.broadcast(values), "k")
    hit = rows.select("k", F.inline(F.transform("vs", lambda v: F.struct(
        v["probability"].alias("p"), v["value"].alias("value"), (F.col("o_totalprice") <= v["value"]).cast("double").alias("at")))))
    return hit.groupBy("p", "value").agg(F.avg("at").alias("rank"))


# The sketch may be off by a rank error of rows / accuracy, so the result is the promise it keeps.
@query("SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]::DOUBLE[]) AS p, true AS within_bound")
def approximate_quantile_checks(t):
    one = t.orders.where("o_totalprice IS NOT NULL").agg((1 / F.count(F.lit(1))).alias("one"))  # one row
    return approximate_quantiles(t).join(F.broadcast(one)).select("p", (F.abs(F.col("rank") - F.col("p")) <= 0.0001 + F.col("one")).alias("within_bound"))


@query("""
SELECT bucket, ([0, 5, 10, 20, 30, 40, 50, 100, 200, 500])[bucket + 1] AS above, count(*) AS key_cnt FROM (
  SELECT CASE WHEN n <= 5 THEN 0 WHEN n <= 10 THEN 1 WHEN n <= 20 THEN 2 WHEN n <= 30 THEN 3 WHEN n <= 40 THEN 4 WHEN n <= 50 THEN 5
    WHEN n <= 100 THEN 6 WHEN n <= 200 THEN 7 WHEN n <= 500 THEN 8 ELSE 9 END AS bucket
  FROM (SELECT card, count(*) AS n FROM txn GROUP BY card)) GROUP BY bucket
""")
def activity_histogram(t):
    return pf.activity_histogram(t.txn, "card")


@query("""
SELECT CAST(floor((n - 1) / 5) AS INTEGER) AS bucket, CAST(floor((n - 1) / 5) * 5 AS INTEGER) AS above, count(*) AS key_cnt
FROM (SELECT o_custkey, least(count(*), 101) AS n FROM orders GROUP BY o_custkey) GROUP BY ALL
""")
def activity_histogram_fine(t):
    return pf.activity_histogram(t.orders, "o_custkey", range(0, 105, 5))


@query("SELECT round(avg(n), 6) AS avg_cnt, round(var_pop(n), 6) AS var_cnt FROM (SELECT count(*) AS n FROM txn GROUP BY card)")
def activity_moments(t):
    return rounded(pf.activity_moments(t.txn, "card"))


@query("""
SELECT 'o_orderstatus' AS col, o_orderstatus AS value, count(*) AS cnt FROM orders GROUP BY ALL UNION ALL
SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL
""")
def column_value_counts(t):
    return pf.value_counts(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("""
SELECT 'card' AS col, count(DISTINCT card) AS distinct_cnt FROM txn UNION ALL SELECT 'place', count(DISTINCT place) FROM txn UNION ALL
SELECT 'event_type', count(DISTINCT event_type) FROM txn
""")
def distinct_counts(t):
    return pf.distinct_counts(t.txn, ["card", "place", "event_type"])


@query("""
WITH d AS (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM txn)
SELECT day, 'card' AS col, count(DISTINCT card) AS distinct_cnt FROM d GROUP BY day UNION ALL
SELECT day, 'place', count(DISTINCT place) FROM d GROUP BY day
""")
def distinct_counts_by_day(t):
    return pf.distinct_counts(t.txn.withColumn("day", F.to_date("ts").cast("string")), ["card", "place"], "day")


@query("""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(sum(cents) AS BIGINT) AS amount, count(*) AS cnt FROM txn WHERE label = 1 GROUP BY 1
""")
def daily_fraud_total(t):
    return pf.daily_total(t.txn.where("label = 1"), "ts", "cents").withColumn("day", F.col("day").cast("string"))


@query("""
SELECT f AS fraud_cnt, n AS normal_cnt, round(n / CAST(f AS DOUBLE), 6) AS normal_per_fraud, round(n / 1000.0 / f, 6) AS fraud_rate
FROM (SELECT count(*) FILTER (WHERE label = 1) AS f, count(*) FILTER (WHERE label = 0) AS n FROM txn)
""")
def class_balance(t):
    return rounded(pf.class_balance(t.txn, "label", 1000))


@query("SELECT substr(o_orderpriority, 1, 1) AS value, count(*) AS cnt FROM orders WHERE o_orderpriority >= '1' AND o_orderpriority <= '4' GROUP BY 1")
def count_by_pay_type(t):
    kept = t.orders.where((F.col("o_orderpriority") >= "1") & (F.col("o_orderpriority") <= "4"))
    return pf.count_by(kept, F.substring("o_orderpriority", 1, 1))


@query("""
SELECT c_nationkey, dc AS deposit_cards_cnt, cc AS credit_cards_cnt, dt AS deposit_trans_cnt, ct AS credit_trans_cnt,
  round(cc / nullif(CAST(cc + dc AS DOUBLE), 0), 6) AS credit_cards_ratio, round(ct / nullif(CAST(ct + dt AS DOUBLE), 0), 6) AS credit_trans_ratio
FROM (SELECT c_nationkey, count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') AS dc, count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus <> 'F') AS cc,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS dt, count(*) FILTER (WHERE o_orderstatus <> 'F') AS ct
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey)
""")
def card_kind_profile(t):
    rows = labels.with_dimension(
        t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus"), t.customer.select("c_custkey", "c_nationkey"), ["c_custkey"])
    return rounded(pf.card_kind_profile(rows, "c_nationkey", "c_custkey", F.col("o_orderstatus") == "F"))


@query("""
SELECT card, count(*) FILTER (WHERE cents >= 0 AND cents < 1000) AS amount_0_cnt, count(*) FILTER (WHERE cents >= 1000 AND cents < 5000) AS amount_1_cnt,
  count(*) FILTER (WHERE cents >= 5000 AND cents < 20000) AS amount_2_cnt, count(*) FILTER (WHERE cents >= 20000) AS amount_3_cnt FROM txn GROUP BY card
""")
def amount_bucket_counts(t):
    return pf.amount_bucket_counts(t.txn, "card", "cents", [0, 1000, 5000, 20000, float("inf")])


@query("""
SELECT l_suppkey, count(DISTINCT o_custkey) AS person_cnt, count(*) AS txn_cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey
""")
def merchant_reach(t):
    rows = t.lineitem.select("l_suppkey", F.col("l_orderkey").alias("o_orderkey")).join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    return pf.merchant_reach(rows, "l_suppkey", "o_custkey")


@query("SELECT event_type, count(*) FILTER (WHERE cents > 5000) AS fraud_cnt, count(*) FILTER (WHERE cents <= 5000) AS normal_cnt FROM txn GROUP BY event_type")
def class_value_counts(t):
    return pf.class_value_counts(t.txn.withColumn("label", (F.col("cents") > 5000).cast("int")), "event_type", "label")


@query("""
SELECT txn_id, round(avg(cents) OVER (PARTITION BY card), 6) AS card_avg, max(cents) OVER (PARTITION BY card) AS card_max FROM txn
""")
def group_stat_on_rows(t):
    out = pf.with_group_stat(t.txn, ["card"], {"card_avg": F.avg("cents"), "card_max": F.max("cents")})
    return rounded(out.select("txn_id", "card_avg", "card_max"))


@query("""
SELECT txn_id, CAST(sum(cents) OVER w AS BIGINT) AS day_tot_amt, count(*) OVER w AS day_tot_cnt FROM txn
WINDOW w AS (PARTITION BY card, CAST(ts AS DATE))
""")
def day_totals_on_rows(t):
    return pf.with_day_totals(t.txn, "card", "ts", "cents").select("txn_id", "day_tot_amt", "day_tot_cnt")


# --- the fixed code lists ---------------------------------------------------------------------

# Merchant category, region and response codes made from the keys of a line, so that all fixed lists are met.
CODES_SQL = """codes AS (SELECT l_orderkey, l_linenumber, l_suppkey, lpad(CAST(1000 + l_partkey * 37 % 9000 AS VARCHAR), 4, '0') AS mcc,
  lpad(CAST(l_suppkey % 70 AS VARCHAR), 2, '0') AS region, (['00', '51', '55', '61', '65', '75', '05'])[l_linenumber] AS response FROM lines)"""


def _codes(t):
    text = lambda c: F.lpad(c.cast("string"), 4, "0")
    responses = F.array(*[F.lit(x) for x in ("00", "51", "55", "61", "65", "75", "05")])
    return t.lines.select(
        "l_orderkey", "l_linenumber", "l_suppkey", text(1000 + F.col("l_partkey") * 37 % 9000).alias("mcc"),
        F.lpad((F.col("l_suppkey") % 70).cast("string"), 2, "0").alias("region"), F.element_at(responses, F.col("l_linenumber").cast("int")).alias("response"))


CODE_RULES = {"high_risk_mcc": ("mcc", HIGH_RISK_MCC), "low_risk_mcc": ("mcc", LOW_RISK_MCC), "risky_region": ("region", HIGH_RISK_REGION_PREFIXES),
              "accepted": ("response", [RESPONSE_OK]), "cardholder_failure": ("response", CARDHOLDER_FAILURE_CODES)}


def _in(col: str, values) -> str:
    return f"coalesce({col} IN ({', '.join(repr(v) for v in values)}), false)"


@query(f"""WITH {CODES_SQL} SELECT l_orderkey, l_linenumber, {', '.join(
    f"CASE WHEN {_in(c, v)} THEN 1e0 ELSE 0e0 END AS is_{n}, CASE WHEN {_in(c, v)} THEN 0e0 ELSE 1e0 END AS not_{n}" for n, (c, v) in CODE_RULES.items())} FROM codes""")
def fixed_risk_flags(t):
    return risk_flag_pairs(_codes(t), CODE_RULES).drop("l_suppkey", "mcc", "region", "response")


@query(f"""WITH {CODES_SQL} SELECT l_suppkey, {', '.join(f"count(*) FILTER (WHERE {_in('mcc', v)}) AS {n}_cnt" for n, v in MCC_GROUPS.items())}
FROM codes GROUP BY l_suppkey""")
def merchant_group_counts(t):
    return pf.group_counts(_codes(t), "l_suppkey", "mcc", MCC_GROUPS)
