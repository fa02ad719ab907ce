"""Queries over the column functions and the cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import functions as fn
from riskloom.operators import clean
from riskloom.plans.registry import query, rounded


@query("""
SELECT l_orderkey, l_linenumber, units, length(regexp_extract(CAST(units AS VARCHAR), '([1-9]*)$', 1)) AS trailing_digits,
  CASE WHEN units % 500 = 0 THEN 1e0 ELSE 0e0 END AS is_multiple_500,
  CASE WHEN units % 1000 = 0 THEN 1e0 ELSE 0e0 END AS is_multiple_1000,
  CASE WHEN abs(units / pow(10, b - 1) - round(units / pow(10, b - 1))) / b < 0.01 AND units > 1000 THEN 1e0 ELSE 0e0 END AS is_round,
  CAST(length(regexp_replace(s, '[^89]', '', 'g')) AS DOUBLE) AS lucky_cnt,
  round(length(regexp_replace(s, '[^89]', '', 'g')) / CAST(length(s) AS DOUBLE), 6) AS lucky_ratio,
  round(abs(l_extendedprice - l_quantity * 1000), 4) AS gap
FROM (SELECT *, cents // 100 AS units, length(CAST(cents // 100 AS VARCHAR)) AS b, CAST(cents AS VARCHAR) AS s FROM lines)
""")
def amount_functions(t):
    units, text = fn.amount_units(F.col("cents")), F.col("cents").cast("string")
    return t.lines.select(
        "l_orderkey", "l_linenumber", units.alias("units"), fn.trailing_nonzero_digits(units).alias("trailing_digits"),
        fn.is_multiple(units, 500).alias("is_multiple_500"), fn.is_multiple(units, 1000).alias("is_multiple_1000"),
        fn.is_round_amount(units).alias("is_round"), fn.lucky_digit_count(text).alias("lucky_cnt"),
        F.round(fn.lucky_digit_ratio(text), 6).alias("lucky_ratio"),
        F.round(fn.amount_delta(F.col("l_extendedprice"), F.col("l_quantity") * 1000), 4).alias("gap"))


@query("""
SELECT txn_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day_no, month(ts) AS month_no, isodow(ts) AS day_week,
  CASE WHEN isodow(ts) IN (6, 7) THEN 1e0 ELSE 0e0 END AS weekend, hour(ts) AS hour_no,
  CASE WHEN hour(ts) IN (23, 0, 1, 2, 3, 4, 5) THEN 1e0 ELSE 0e0 END AS night,
  round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 6e7, 8) AS minutes,
  round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9, 10) AS hours
FROM txn
""")
def time_functions(t):
    ts = F.col("ts")
    return t.txn.select(
        "txn_id", fn.day_no(ts).alias("day_no"), fn.month_of(ts).alias("month_no"), fn.day_of_week(ts).alias("day_week"),
        fn.is_weekend(ts).alias("weekend"), fn.hour_of(ts).alias("hour_no"), fn.is_night(ts).alias("night"),
        F.round(fn.minutes_since(ts, "2024-01-01 00:00:00"), 8).alias("minutes"),
        F.round(fn.hours_since(ts, "2024-01-01 00:00:00"), 10).alias("hours"))


@query("""
WITH parsed AS (
  SELECT txn_id, ts, try_strptime(CASE WHEN label = 1 THEN 'n/a' ELSE strftime(ts, '%Y%m%d%H%M%S') END, '%Y%m%d%H%M%S') AS a,
         try_strptime('2024' || strftime(ts, '%m%d%H%M%S'), '%Y%m%d%H%M%S') AS b FROM txn)
SELECT txn_id, round((epoch_us(ts) - epoch_us(a)) / 1000000.0, 6) AS secs,
  round((epoch_us(b) - epoch_us(TIMESTAMP '2024-01-01')) / 60000000.0, 6) AS mins,
  round((epoch_us(b) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0, 6) AS hours, hour(a) AS hour_no, isodow(b) AS day_week
FROM parsed
""")
def time_text_functions(t):
    long_text = F.when(F.col("label") == 1, "n/a").otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    a, b = fn.parse_time(long_text), fn.parse_time(F.date_format("ts", "MMddHHmmss"), "MMddHHmmss", 2024)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return t.txn.select(
        "txn_id", F.round(fn.time_delta(F.col("ts"), a, "seconds"), 6).alias("secs"),
        F.round(fn.time_delta(b, start, "mins"), 6).alias("mins"), F.round(fn.time_delta(b, start, "hours"), 6).alias("hours"),
        fn.hour_of(a).alias("hour_no"), fn.day_of_week(b).alias("day_week"))


@query("""
WITH codes AS (
  SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name || p_brand || p_type END AS s FROM part),
h AS (
  SELECT p_partkey, s,
    list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(string_split(s, ''), lambda c: CAST(ascii(c) AS HUGEINT))),
      lambda x, y: (x * 131 + y) % 18446744073709551616) AS w,
    list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(string_split(s, ''), lambda c: CAST(ascii(c) AS HUGEINT))),
      lambda x, y: (x * 131 + y) % 8388608) AS m
  FROM codes)
SELECT p_partkey,
  CASE WHEN s = '' THEN -1 ELSE CAST(CASE WHEN w >= 9223372036854775808 THEN w - 18446744073709551616 ELSE w END AS BIGINT) END AS wrapped,
  CASE WHEN s = '' THEN -1 ELSE CAST(m AS BIGINT) END AS masked,
  CASE WHEN s = '' THEN -999 ELSE CAST(m AS BIGINT) END AS masked_low
FROM h
""")
def string_hashes(t):
    s = F.when(F.col("p_size") % 7 == 0, "").otherwise(F.concat("p_name", "p_brand", "p_type"))
    return t.part.select("p_partkey", s.alias("s")).select(
        "p_partkey", fn.bkdr_hash(F.col("s")).alias("wrapped"), fn.bkdr_hash(F.col("s"), mask=0x7FFFFF).alias("masked"),
        fn.bkdr_hash(F.col("s"), mask=0x7FFFFF, empty=-999).alias("masked_low"))


@query("""
SELECT p_partkey, CASE WHEN length(p_brand) = 8 THEN substr(p_brand, 1, 4) ELSE p_brand END AS brand_bank,
  CASE WHEN length(p_brand) = 8 THEN substr(p_brand, 5, 4) ELSE p_brand END AS brand_region,
  substr(p_name, 1, 4) AS name_head, substr(p_name, 5, 4) AS name_tail, substr(p_type, 1, 2) AS province,
  CASE WHEN right(p_brand, 1) = '1' THEN 1e0 ELSE 0e0 END AS pin_entry
FROM part
""")
def code_split(t):
    both = clean.split_code(clean.split_code(t.part, ["p_brand"]), ["p_name"], strict=False)
    return both.select(
        "p_partkey", F.col("p_brand_BK").alias("brand_bank"), F.col("p_brand_RG").alias("brand_region"),
        F.col("p_name_BK").alias("name_head"), F.col("p_name_RG").alias("name_tail"),
        fn.prefix(F.col("p_type")).alias("province"), fn.last_char_is(F.col("p_brand"), "1").alias("pin_entry"))


@query("""
SELECT txn_id, CASE WHEN kind IS NULL THEN 'NULLs' WHEN kind = '' THEN 'NANs' ELSE kind END AS kind,
  coalesce(kind, 'NULL') AS kind_text, coalesce(part_cents, -1) AS part_cents
FROM (SELECT txn_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN '' ELSE event_type END AS kind,
        CASE WHEN event_type <> 'view' THEN cents END AS part_cents FROM txn)
""")
def fill_columns(t):
    kind = F.when(F.col("event_type") == "error", None).when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    raw = t.txn.select("txn_id", kind.alias("kind"), kind.alias("kind_text"),
                       F.when(F.col("event_type") != "view", F.col("cents")).alias("part_cents"))
    filled = clean.fill_numeric(clean.fill_text(clean.fill_empty(raw, ["kind"]), ["kind_text"]), -1, ["part_cents"])
    return clean.strip_suffix(filled.drop("kind"))


@query("""
SELECT txn_id, part_cents FROM (
  SELECT txn_id, CASE WHEN event_type <> 'view' THEN cents END AS part_cents FROM txn) WHERE part_cents IS NOT NULL
""")
def drop_null_rows(t):
    return clean.drop_null(t.txn.select(
        "txn_id", F.when(F.col("event_type") != "view", F.col("cents")).alias("part_cents")), ["part_cents"])


@query("""
SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS rank_db, TRY_CAST(o_orderpriority AS DOUBLE) AS text_db,
  coalesce(TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE), -1.0) AS rank_safe,
  coalesce(TRY_CAST(o_orderstatus AS DOUBLE), -1.0) AS status_safe
FROM orders
""")
def numeric_casts(t):
    raw = t.orders.select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("rank"), F.col("o_orderpriority").alias("text"), "o_orderstatus",
        "o_totalprice")
    chosen = clean.select_features(raw, drop=["o_totalprice"])
    return clean.to_double(chosen.withColumns({
        "rank_safe": fn.safe_number(F.col("rank")), "status_safe": fn.safe_number(F.col("o_orderstatus")),
    }), ["rank", "text"], ["o_orderkey", "rank_safe", "status_safe"])


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END AS is_success,
  CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 1e0 ELSE 0e0 END AS is_high_risk,
  CASE WHEN o_orderpriority NOT IN ('5-LOW') THEN 1e0 ELSE 0e0 END AS not_low,
  CASE WHEN o_totalprice > 250000 THEN 1e0 ELSE 0e0 END AS is_large, CASE WHEN o_totalprice <= 250000 THEN 1e0 ELSE 0e0 END AS not_large,
  CASE WHEN o_custkey = o_orderkey THEN 1e0 ELSE 0e0 END AS same_key
FROM orders
""")
def membership_flags(t):
    df = clean.flag_in(t.orders, "o_orderstatus", ["F"], "is_success")
    df = clean.flag_in(df, fn.prefix(F.col("o_orderpriority"), 1), ["1", "2"], "is_high_risk")
    df = clean.flag_in(df, "o_orderpriority", ["5-LOW"], "not_low", negate=True)
    df = clean.flag_gt(clean.flag_gt(df, "o_totalprice", 250000, "is_large"), "o_totalprice", 250000, "not_large", negate=True)
    df = clean.flag_expr(df, F.col("o_custkey") == F.col("o_orderkey"), "same_key")
    return df.select("o_orderkey", "is_success", "is_high_risk", "not_low", "is_large", "not_large", "same_key")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey IN (1, 3, 5, 7) THEN 1e0 ELSE 0e0 END AS is_HR_merchant,
  CASE WHEN l_suppkey IN (1, 3, 5, 7) THEN 0e0 ELSE 1e0 END AS not_HR_merchant,
  CASE WHEN l_quantity > 20 THEN 1e0 ELSE 0e0 END AS is_HR_entry, CASE WHEN l_quantity > 20 THEN 0e0 ELSE 1e0 END AS not_HR_entry,
  CASE WHEN l_linestatus = 'O' THEN 1e0 ELSE 0e0 END AS is_HR_status, CASE WHEN l_linestatus = 'O' THEN 0e0 ELSE 1e0 END AS not_HR_status
FROM lines
""")
def risk_flag_pairs(t):
    return clean.risk_flag_pairs(t.lines, {
        "HR_merchant": ("l_suppkey", [1, 3, 5, 7]), "HR_entry": ("l_quantity", 20), "HR_status": ("l_linestatus", ["O"]),
    }).select("l_orderkey", "l_linenumber", *[f"{p}_HR_{n}" for n in ("merchant", "entry", "status") for p in ("is", "not")])


@query("""
SELECT doc_id, CASE WHEN length(text) >= 28 AND substr(text, 27, 1) IN ('a', 'e') THEN 1e0 ELSE 0e0 END AS is_QR,
  CASE WHEN substr(text, 1, 1) BETWEEN '1' AND '9' THEN 1e0 ELSE 0e0 END AS is_pay_type
FROM documents
""")
def qr_marks(t):
    df = clean.qr_flag(t.documents, "text", "is_QR", 27, ("a", "e"))
    return clean.qr_flag(df, "text", "is_pay_type", None).select("doc_id", "is_QR", "is_pay_type")


@query("""
SELECT count(*) FILTER (WHERE l_discount = l_tax) AS equal_cnt, count(*) FILTER (WHERE l_discount > l_tax) AS greater_cnt,
  count(*) FILTER (WHERE l_discount < l_tax) AS less_cnt, count(*) FILTER (WHERE l_discount = 0) AS left_zero_cnt,
  count(*) FILTER (WHERE l_tax = 0) AS right_zero_cnt, count(*) AS row_cnt FROM lineitem
""")
def compare_amounts(t):
    return clean.compare_columns(t.lineitem, "l_discount", "l_tax")


@query("""
SELECT o_orderkey, 1e0 AS label FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
""")
def filtered_labelled_rows(t):
    rows = t.orders.where((F.col("o_orderstatus") != "P") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return clean.drop_columns(clean.with_label(rows, 1.0), "o_totalprice").select("o_orderkey", "label")


@query("""
SELECT col FROM (
  SELECT 'o_orderstatus' AS col, count(DISTINCT o_orderstatus) AS n FROM orders UNION ALL
  SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders UNION ALL
  SELECT 'o_custkey', count(DISTINCT o_custkey) FROM orders) WHERE n < 500
""")
def low_cardinality_columns(t):
    from riskloom.operators.clean import low_cardinality

    few = low_cardinality(t.orders, ["o_orderstatus", "o_orderpriority", "o_custkey"], 500)
    return t.spark.createDataFrame([(c,) for c in few], "col string")


@query("""
WITH g AS (SELECT txn_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY card ORDER BY ts, txn_id))) / 60000000.0 AS m FROM txn)
SELECT txn_id, CASE WHEN m IS NULL THEN NULL WHEN m <= 1 THEN 0 WHEN m <= 2 THEN 1 WHEN m <= 5 THEN 2 WHEN m <= 10 THEN 3
  WHEN m <= 60 THEN 4 ELSE 5 END AS interval_bucket, ceil(m) AS interval_minutes FROM g
""")
def previous_interval(t):
    from riskloom.operators.windows import prev_interval

    return rounded(prev_interval(t.txn, "card", "ts", "txn_id").select("txn_id", "interval_bucket", "interval_minutes"))
