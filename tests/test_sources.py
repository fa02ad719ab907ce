from pyspark.sql import functions as F

from riskloom.ml import encode
from riskloom.operators import graph as g
from riskloom.sources import readers as rd
from riskloom.sources import writers as wr


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_daily_log(spark, tmp_path):
    write(tmp_path / "log" / "20161001.txt", '"1","01030001"\n"2","0103"\n')
    write(tmp_path / "log" / "20161002.txt", '"3","48336110"\n')
    write(tmp_path / "log" / "20161003.txt", '"4","48336110"\n')
    df = rd.read_daily_log(spark, str(tmp_path / "log"), "20161001", "20161002", ["sys_tra_no", "acq_ins_id_cd"])
    got = sorted((r.sys_tra_no, r.pdate, r.acq_ins_id_cd_BK, r.acq_ins_id_cd_RG) for r in df.collect())
    assert got == [("1", "20161001", "0103", "0001"), ("2", "20161001", "0103", "0103"), ("3", "20161002", "4833", "6110")]


def test_fraud_lists(spark, tmp_path):
    tab = write(tmp_path / "f.txt", "1\tc1\tm1\t20161001\t04\n2\tc2\tm2\t20161105\t04\n")
    assert [r.sys_tra_no for r in rd.read_fraud_list(spark, tab, "20161001", "20161031").collect()] == ["1"]
    ctrl = write(tmp_path / "l.txt", "\u0001".join(["1", "20161001", "1001120000", "c1", "t1", "r", "m1", "04"]) + "\n")
    assert rd.read_fraud_list_long(spark, ctrl).first().term_id == "t1"


def test_ragged(spark, tmp_path):
    path = write(tmp_path / "m.txt", "a,12.5,1001120000,7,4111\nb,3\nc\nd,1.0,t,x,\n")
    rows = rd.read_ragged(spark, path, ["card", "amt", "ts", "ext", "mcc"], ["string", "double", "string", "string", "string"], [None, 0.0, "", "", ""])
    assert sorted(tuple(r) for r in rows.collect()) == [
        ("a", 12.5, "1001120000", "7", "4111"), ("b", 0.0, "", "", ""), ("c", 0.0, "", "", ""), ("d", 0.0, "", "", "")]


def test_edges_and_ids(spark, tmp_path):
    path = write(tmp_path / "e.txt", "1 2 0.5\n2  3 x\nbroken\n3 4\n")
    assert sorted(tuple(r) for r in rd.read_edges(spark, path, indexed=True).collect()) == [(1, 2, 0.5), (2, 3, 1.0), (3, 4, 1.0)]
    assert {r.weight for r in rd.read_edges(spark, path, weighted=False).collect()} == {1.0}
    ids = write(tmp_path / "ids.txt", "alice 0\nbob 1\n")
    assert {(r.name, r.id) for r in rd.read_node_ids(spark, ids).collect()} == {("alice", 0), ("bob", 1)}


def test_date_dim(spark):
    rows = rd.date_dim(spark, "20161230", "20170102").collect()
    assert [(r.pdate, r.day_no) for r in rows] == [("20161230", 0), ("20161231", 1), ("20170101", 2), ("20170102", 3)]
    assert rd.date_dim(spark, "20161230", "20161230").count() == 1


def test_reports_and_stages(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") % 3).cast("string").alias("kind"))
    wr.write_report(df, str(tmp_path / "r"), single=True)
    assert len(list((tmp_path / "r").glob("*.csv"))) == 1
    assert rd.read_csv_typed(spark, str(tmp_path / "r"), "id bigint, kind string").count() == 10
    assert {r.kind for r in rd.read_risk_list(spark, str(tmp_path / "r"), "kind", columns=["id", "kind"]).collect()} == {"0", "1", "2"}
    wr.write_reports_by(df, "kind", str(tmp_path / "by"))
    assert sorted(p.name for p in (tmp_path / "by").glob("kind=*")) == ["kind=0", "kind=1", "kind=2"]
    wr.write_stage(df, str(tmp_path / "s"))
    assert rd.read_stage(spark, str(tmp_path / "s")).count() == 10
    wr.write_stage(df, str(tmp_path / "c"), sep=",")
    assert rd.read_stage(spark, str(tmp_path / "c"), ["id", "kind"]).dtypes == [("id", "string"), ("kind", "string")]


def test_managed_table(spark):
    spark.sql("DROP TABLE IF EXISTS riskloom_txn")
    wr.write_table(spark.range(20).withColumnRenamed("id", "card"), "riskloom_txn", "card", 4)
    assert rd.scan_range(spark, "riskloom_txn", 3, 7, ["card"], "card").count() == 5
    spark.sql("DROP TABLE riskloom_txn")


def test_models_and_walks(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "c string")
    wr.save_model(encode.index_categories(["c"]).fit(df), str(tmp_path / "m"))
    loaded = wr.load_model(str(tmp_path / "m"))
    fresh = spark.createDataFrame([("a",), ("new",)], "c string")
    assert [tuple(r) for r in loaded.transform(fresh).collect()] == [("a", 0.0)]
    walks = spark.createDataFrame([(1, 0, [1, 2, 3])], "start bigint, walk_no int, path array<bigint>")
    wr.save_walks(walks, str(tmp_path / "w"))
    assert spark.read.text(str(tmp_path / "w")).first().value == "1\t2\t3"
    ids = spark.createDataFrame([("n1", 1), ("n2", 2), ("n3", 3)], "name string, id bigint")
    wr.save_embedding(g.node_vectors(g.embed(walks, dim=4, window=2), ids), str(tmp_path / "v"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert sorted(x.split("\t")[0] for x in lines) == ["n1", "n2", "n3"] and all(len(x.split(",")) == 4 for x in lines)


def test_daily_log_with_a_missing_day(spark, tmp_path):
    for day in ("20240101", "20240103"):
        spark.createDataFrame([(day, "x")], "a string, b string").write.csv(str(tmp_path / f"{day}.log"))
    rows = rd.read_daily_log(spark, str(tmp_path), "20240101", "20240104", ["a", "b"]).collect()
    assert sorted((r.a, r.pdate) for r in rows) == [("20240101", "20240101"), ("20240103", "20240103")]


def test_lines_that_do_not_fit_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k1,1.5,2\nk2,x,3\nk3,1\nk4,1,2,3\n\nk5,,7\n")
    checked = rd.read_indexed(spark, str(tmp_path), "k", ["a", "b"], checked=True)
    assert sorted(tuple(r) for r in rd.good_rows(checked).collect()) == [("k1", 1.5, 2.0), ("k5", None, 7.0)]
    assert sorted(r.bad_line for r in rd.bad_lines(checked).collect()) == ["k2,x,3", "k3,1", "k4,1,2,3"]
    assert [(r.good, r.bad) for r in rd.line_counts(checked).collect()] == [(2, 3)]
    # what is selected does not decide what is bad
    assert checked.where("bad_line IS NOT NULL").select("k").count() == 3


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_days_of_the_list_prune_the_log(spark, tmp_path):
    log = spark.range(2000).selectExpr("id", "cast(id % 20 as string) AS pdate")
    log.write.partitionBy("pdate").parquet(str(tmp_path / "log"))
    listed = spark.range(2000).selectExpr("id", "cast(id % 20 as string) AS pdate").where("pdate IN ('3', '7') AND id < 500")
    out = rd.scan_listed_days(spark, str(tmp_path / "log"), listed, ["id", "pdate"])
    assert "dynamicpruningexpression" in plan_of(out)
    assert out.count() == 50
    # Files of other days are never opened: spoiled ones do no harm once the schema is known.
    again = rd.scan_listed_days(spark, str(tmp_path / "log"), listed, ["id", "pdate"])
    for file in (tmp_path / "log").glob("pdate=*/*.parquet"):
        if file.parent.name not in ("pdate=3", "pdate=7"):
            file.write_bytes(b"no parquet")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert again.count() == 50


def test_bucketed_tables_join_without_an_exchange(spark):
    from riskloom.operators import labels
    from riskloom.operators import windows as w

    log = spark.range(3000).selectExpr("id AS txn", "id % 70 AS card", "id AS cents", "timestamp_seconds(id * 5000) AS ts")
    wr.write_table(log, "bucketed_log", ["txn", "card"], 4)
    wr.write_table(log.where("txn % 9 = 0").select("txn", "card"), "bucketed_list", ["txn", "card"], 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = labels.label_transactions(spark.table("bucketed_log"), spark.table("bucketed_list"), ["txn", "card"])
        assert "Exchange" not in plan_of(out) and "SortMergeJoin" in plan_of(out)
        assert out.where("label = 1").count() == 334
        wr.write_table(log, "log_by_card", "card", 4)
        days = w.day_frames(spark.table("log_by_card").withColumn("day", F.unix_date(F.to_date("ts"))), ["card"], "day",
                            [w.Measure("n", "count", F.col("cents"))], [w.DAY3])
        assert "Exchange" not in plan_of(days)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("bucketed_log", "bucketed_list", "log_by_card"):
            spark.sql(f"DROP TABLE {name}")
