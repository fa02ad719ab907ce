"""Queries that go through the readers and writers: tables are exported in the source's format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.ml import encode
from riskloom.operators import graph, order
from riskloom.plans.registry import query
from riskloom.sources import readers as rd
from riskloom.sources import writers as wr


@query("""
SELECT CAST(txn_id AS VARCHAR) AS txn_id, CAST(card AS VARCHAR) AS card, strftime(ts, '%Y%m%d') AS pdate, event_type AS acq_ins_id_cd,
  CASE WHEN length(event_type) = 8 THEN substr(event_type, 1, 4) ELSE event_type END AS acq_ins_id_cd_BK,
  CASE WHEN length(event_type) = 8 THEN substr(event_type, 5, 4) ELSE event_type END AS acq_ins_id_cd_RG
FROM txn WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20'
""")
def daily_log_import(t):
    path = t.scratch("daily-log")
    log = t.txn.select(F.date_format("ts", "yyyyMMdd").alias("pdate"), F.col("txn_id").cast("string").alias("txn_id"),
                       F.col("card").cast("string").alias("card"), F.col("event_type").alias("acq_ins_id_cd"))
    log.write.partitionBy("pdate").option("quoteAll", True).csv(path)
    return rd.read_daily_log(t.spark, path, "20240103", "20240120", ["txn_id", "card", "acq_ins_id_cd"], "{base}/pdate={day}")


@query("""
SELECT CAST(txn_id AS VARCHAR) AS sys_tra_no, CAST(card AS VARCHAR) AS pri_acct_no_conv, strftime(ts, '%Y%m%d') AS pdate, event_type AS fraud_tp
FROM txn WHERE label = 1 AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-10'
""")
def fraud_list_import(t):
    path = t.scratch("fraud-list")
    wr.write_stage(t.txn.where("label = 1").select("txn_id", "card", "place", F.date_format("ts", "yyyyMMdd"), "event_type"), path, sep="\t")
    return rd.read_fraud_list(t.spark, path, "20240105", "20240110").select("sys_tra_no", "pri_acct_no_conv", "pdate", "fraud_tp")


@query("""
SELECT CAST(txn_id AS VARCHAR) AS sys_tra_no, strftime(ts, '%Y%m%d') AS trans_dt, CAST(place AS VARCHAR) AS term_id FROM txn
WHERE label = 1 AND CAST(ts AS DATE) >= DATE '2024-01-05'
""")
def fraud_list_long_import(t):
    path = t.scratch("fraud-list-long")
    rows = t.txn.where("label = 1").select(
        "txn_id", F.date_format("ts", "yyyyMMdd"), F.date_format("ts", "MMddHHmmss"), "card", "place", "place", "place", "event_type").toDF(
        *[f"c{i}" for i in range(8)])
    wr.write_stage(rows, path, sep="\u0001")
    return rd.read_fraud_list_long(t.spark, path, "20240105").select("sys_tra_no", "trans_dt", "term_id")


@query("SELECT txn_id, isodow(ts) AS day_week, hour(ts) AS hour FROM (SELECT CAST(txn_id AS VARCHAR) AS txn_id, ts FROM txn)")
def labelled_stage_import(t):
    path = t.scratch("labelled")
    wr.write_stage(t.txn.select("txn_id", F.date_format("ts", "MMddHHmmss"), "label"), path, sep=",")
    return rd.read_labeled(t.spark, path, ["txn_id", "tfr_dt_tm", "label"], year=2024).select("txn_id", "day_week", "hour")


@query("SELECT CAST(card AS VARCHAR) AS card, count(*) AS cnt, CAST(sum(place) AS DOUBLE) AS places FROM txn GROUP BY card")
def indexed_stage_import(t):
    path = t.scratch("indexed")
    wr.write_stage(t.txn.select("card", "place", "label"), path, sep=",")
    return rd.read_indexed(t.spark, path, "card", ["place", "label"]).groupBy("card").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("place").alias("places"))


@query("SELECT c_custkey, c_mktsegment FROM customer")
def typed_csv_import(t):
    path = t.scratch("typed")
    wr.write_report(t.customer.select("c_custkey", "c_mktsegment"), path)
    return rd.read_csv_typed(t.spark, path, "c_custkey bigint, c_mktsegment string")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate <= TIMESTAMP '1997-02-28'")
def table_range_scan(t):
    start, end = F.lit("1996-03-01").cast("timestamp_ntz"), F.lit("1997-02-28").cast("timestamp_ntz")
    return rd.scan_range(t.spark, f"{t.folder}/orders.parquet", start, end, ["o_orderkey", "o_custkey"], "o_orderdate")


@query("""
SELECT CAST(card AS VARCHAR) AS card, count(*) AS cnt, count(*) FILTER (WHERE event_type = 'view') AS short_cnt,
  round(sum(CASE WHEN event_type <> 'view' THEN cents / 100.0 ELSE 0 END), 2) AS amount FROM txn GROUP BY card
""")
def ragged_text_import(t):
    path = t.scratch("ragged")
    whole = F.concat_ws(",", "card", F.col("cents") / 100, F.date_format("ts", "MMddHHmmss"), "event_type", "place")
    t.txn.select(F.when(F.col("event_type") == "view", F.concat_ws(",", "card", "cents")).otherwise(whole).alias("value")).write.text(path)
    rows = rd.read_ragged(t.spark, path, ["card", "trans_at", "tfr_dt_tm", "ext_extend_inf_28", "mchnt_tp"],
                          ["string", "double", "string", "string", "string"], [None, 0.0, "", "", ""])
    return rows.groupBy("card").agg(F.count(F.lit(1)).alias("cnt"), F.count_if(F.col("tfr_dt_tm") == "").alias("short_cnt"),
                                    F.round(F.sum("trans_at"), 2).alias("amount"))


@query("""
SELECT src, dst, weight FROM (SELECT DISTINCT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1e0 ELSE c_acctbal END AS weight FROM customer)
""")
def edge_list_import(t):
    path = t.scratch("edges")
    weight = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "none").otherwise(F.col("c_acctbal").cast("string"))
    lines = t.customer.select(F.concat_ws(" ", F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), weight).alias("value"))
    lines.unionByName(t.customer.select(F.concat(F.lit("broken"), "c_custkey").alias("value"))).write.text(path)
    return rd.read_edges(t.spark, path)


@query("SELECT s_name AS name, s_suppkey AS id FROM supplier")
def node_id_import(t):
    path = t.scratch("node-ids")
    wr.write_stage(t.supplier.select("s_name", "s_suppkey"), path, sep=" ")
    return rd.read_node_ids(t.spark, path)


@query("SELECT DISTINCT CAST(l_suppkey AS DOUBLE) AS l_suppkey FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R'")
def risk_list_import(t):
    path = t.scratch("risk-list")
    wr.write_report(t.lineitem.where("l_quantity >= 49 AND l_returnflag = 'R'").select("l_suppkey"), path)
    return rd.read_risk_list(t.spark, path, "l_suppkey", "double")


@query("""
WITH d AS (SELECT CAST(unnest(generate_series((SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT strftime(day, '%Y%m%d') AS pdate, date_diff('day', (SELECT min(CAST(o_orderdate AS DATE)) FROM orders), day) AS day_no,
  (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) = day) AS order_cnt FROM d
""")
def date_dictionary(t):
    span = t.orders.agg(F.date_format(F.min("o_orderdate"), "yyyyMMdd"), F.date_format(F.max("o_orderdate"), "yyyyMMdd")).first()
    counts = t.orders.groupBy(F.date_format("o_orderdate", "yyyyMMdd").alias("pdate")).agg(F.count(F.lit(1)).alias("order_cnt"))
    return rd.date_dim(t.spark, span[0], span[1]).join(counts, "pdate", "left").fillna(0, ["order_cnt"]).select("pdate", "day_no", "order_cnt")


@query("SELECT txn_id, card, strftime(ts, '%Y-%m-%d') AS day FROM txn")
def stage_round_trip(t):
    path = t.scratch("stage")
    wr.write_stage(t.txn.select("txn_id", "card", F.date_format("ts", "yyyy-MM-dd").alias("day")), path, ["day"])
    return rd.read_stage(t.spark, path).select("txn_id", "card", F.col("day").cast("string").alias("day"))


@query("SELECT s_suppkey, s_name FROM supplier")
def managed_table_round_trip(t):
    name = f"supplier_{uuid.uuid4().hex}"
    wr.write_table(t.supplier.select("s_suppkey", "s_name"), name, "s_suppkey", 4)
    return t.spark.table(name)


@query("""
WITH f AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS i FROM txn GROUP BY event_type)
SELECT txn_id, CAST(f.i AS DOUBLE) AS event_type_idx FROM txn JOIN f USING (event_type)
""")
def model_round_trip(t):
    rows, path = t.txn.select("txn_id", "event_type"), t.scratch("model")
    wr.save_model(encode.index_categories(["event_type"]).fit(rows), path)
    return wr.load_model(path).transform(rows).select("txn_id", "event_type_idx")


@query("""
SELECT CAST(c_custkey * 2 AS VARCHAR) AS start, 10 AS lines, 12 AS nodes FROM customer UNION ALL
SELECT CAST(n * 2 + 1 AS VARCHAR), 10, 12 FROM (SELECT DISTINCT c_nationkey AS n FROM customer)
""")
def walk_files(t):
    edges = t.customer.select((F.col("c_custkey") * 2).alias("src"), (F.col("c_nationkey") * 2 + 1).cast("bigint").alias("dst"), F.lit(1.0).alias("weight"))
    path = t.scratch("walks")
    wr.save_walks(graph.random_walks(graph.neighbors(edges), length=10), path)
    parts = F.split("value", "\t")
    return t.spark.read.text(path).groupBy(parts[0].alias("start")).agg(
        F.count(F.lit(1)).cast("int").alias("lines"), F.max(F.size(parts)).alias("nodes"))


@query("SELECT least(5, count(*)) AS rows FROM orders")
def first_rows(t):
    return order.head(t.orders, 5).agg(F.count(F.lit(1)).alias("rows"))


# A log with planted bad lines: some lack their last field, some have one too many.
PLANT = "CASE WHEN txn_id % 97 = 5 THEN 'short' WHEN txn_id % 89 = 7 THEN 'long' ELSE 'good' END"


@query(f"""
WITH l AS (SELECT *, {PLANT} AS plant FROM txn)
SELECT 'good' AS kind, CAST(txn_id AS VARCHAR) AS txn_id, CAST(card AS VARCHAR) AS card, event_type AS event, CAST(NULL AS VARCHAR) AS line, strftime(ts, '%Y%m%d') AS pdate
FROM l WHERE plant = 'good'
UNION ALL SELECT 'bad', NULL, NULL, NULL, '"' || txn_id || '","' || card || '"' || CASE WHEN plant = 'long' THEN ',"' || event_type || '","x"' ELSE '' END,
  strftime(ts, '%Y%m%d') FROM l WHERE plant <> 'good'
""")
def quarantined_log_lines(t):
    """Good rows and bad lines of a daily log, each with its day."""
    path = t.scratch("planted-log")
    line = F.format_string('"%s","%s"', F.col("txn_id"), F.col("card"))
    plant = F.expr(PLANT)
    line = F.when(plant == "short", line).when(plant == "long", F.concat(line, F.format_string(',"%s","x"', F.col("event_type")))).otherwise(
        F.concat(line, F.format_string(',"%s"', F.col("event_type"))))
    t.txn.select(F.date_format("ts", "yyyyMMdd").alias("pdate"), line.alias("value")).write.partitionBy("pdate").text(path)
    log = rd.read_daily_log(t.spark, path, "20230101", "20251231", ["txn_id", "card", "event"], "{base}/pdate={day}", checked=True)
    bad = F.col(rd.BAD).isNotNull()
    return log.select(F.when(bad, "bad").otherwise("good").alias("kind"), *[F.when(~bad, F.col(c)).alias(c) for c in ("txn_id", "card", "event")],
                      F.col(rd.BAD).alias("line"), "pdate")


@query(f"""
SELECT strftime(ts, '%Y%m%d') AS pdate, count(*) FILTER (WHERE {PLANT} = 'good') AS good, count(*) FILTER (WHERE {PLANT} <> 'good') AS bad FROM txn GROUP BY 1
""")
def quarantine_counts(t):
    """Good and bad lines of a fraud list per file, added up by the day in the file's path."""
    path = t.scratch("planted-list")
    fields = F.concat_ws("\t", "txn_id", "card", "place", F.date_format("ts", "yyyyMMdd"))
    plant = F.expr(PLANT)
    line = F.when(plant == "short", fields).otherwise(F.concat_ws("\t", fields, "event_type", F.when(plant == "long", F.lit("x"))))
    t.txn.select(F.date_format("ts", "yyyyMMdd").alias("day"), line.alias("value")).write.partitionBy("day").text(path)
    counts = rd.line_counts(rd.read_fraud_list(t.spark, f"{path}/*", checked=True))
    return counts.groupBy(F.regexp_extract("file", r"day=(\d{8})", 1).alias("pdate")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


@query("SELECT txn_id, card, strftime(ts, '%Y%m%d') AS pdate FROM txn WHERE label = 1 AND CAST(ts AS DATE) IN (DATE '2024-01-09', DATE '2024-01-21')")
def fraud_of_listed_days(t):
    """Fraud rows of a log partitioned by day; only the days on the list are opened."""
    path = t.scratch("partitioned-log")
    wr.write_stage(t.txn.withColumn("pdate", F.date_format("ts", "yyyyMMdd")), path, ["pdate"])
    listed = t.txn.withColumn("pdate", F.date_format("ts", "yyyyMMdd")).where("label = 1 AND pdate IN ('20240109', '20240121')")
    return rd.scan_listed_days(t.spark, path, listed, ["txn_id", "card", "pdate"]).select("txn_id", "card", F.col("pdate").cast("string").alias("pdate"))


@query("SELECT txn_id, CASE WHEN label = 1 THEN 1e0 ELSE 0e0 END AS is_fraud FROM txn")
def labels_from_bucketed_tables(t):
    """The label join on two tables bucketed by its keys: no exchange of either."""
    from riskloom.operators import labels

    names = [f"riskloom_{kind}_{uuid.uuid4().hex}" for kind in ("log", "list")]
    wr.write_table(t.txn.select("txn_id", "card"), names[0], ["txn_id", "card"], 8)
    wr.write_table(t.txn.where("label = 1").select("txn_id", "card"), names[1], ["txn_id", "card"], 8)
    log, listed = (t.spark.table(n) for n in names)
    return labels.label_transactions(log, listed, ["txn_id", "card"], "is_fraud").select("txn_id", "is_fraud")
