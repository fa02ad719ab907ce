import pytest
from pyspark.sql import functions as F

from riskloom import functions as fn
from riskloom.operators import clean


def values(spark, schema, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_amount_digits(spark):
    got = values(spark, "c bigint", [(500,), (123,), (105,), (2000,), (0,)], fn.trailing_nonzero_digits(F.col("c")))
    assert [g[0] for g in got] == [0, 3, 1, 0, 0]


def test_round_amount(spark):
    got = values(spark, "c bigint", [(1000,), (2000,), (2345,), (5000,)], fn.is_round_amount(F.col("c")))
    assert [g[0] for g in got] == [0.0, 1.0, 0.0, 1.0]


def test_lucky_digits_and_units(spark):
    got = values(spark, "s string", [("1889",), ("123",), ("",)], fn.lucky_digit_count(F.col("s")), fn.lucky_digit_ratio(F.col("s")))
    assert got == [(3.0, 0.75), (0.0, 0.0), (0.0, None)]
    assert values(spark, "c string", [("199",), ("50",)], fn.amount_units(F.col("c"))) == [(1,), (0,)]


def test_weekday_and_bad_time(spark):
    days = [("20161001000000",), ("20161002000000",), ("20161003000000",), ("abc",)]
    ts = fn.parse_time(F.col("s"))
    assert [g[0] for g in values(spark, "s string", days, fn.day_of_week(ts))] == [6, 7, 1, None]
    start = fn.parse_time(F.lit("20161001000000"))
    assert [g[0] for g in values(spark, "s string", days, fn.time_delta(ts, start, "hours"))] == [0.0, 24.0, 48.0, None]
    short = fn.parse_time(F.col("s"), "MMddHHmmss", 2016)
    assert values(spark, "s string", [("1001235959",)], fn.hour_of(short), fn.is_night(short)) == [(23, 1.0)]


def test_interval_bucket(spark):
    got = values(spark, "m double", [(1.0,), (2.0,), (5.0,), (10.0,), (60.0,), (61.0,), (None,)], fn.interval_bucket(F.col("m")))
    assert [g[0] for g in got] == [0, 1, 2, 3, 4, 5, None]


def python_hash(text, mask=None):
    h = 0
    for ch in text:
        h = h * 131 + ord(ch)
        h = h & mask if mask else h % (1 << 64)
    return h - (1 << 64) if h >= 1 << 63 else h


def test_string_hash(spark):
    texts = ["S22ab", "", "a", "transaction risk analytics", "été à la carte"]
    got = values(spark, "s string", [(t,) for t in texts], "s", fn.bkdr_hash(F.col("s")), fn.bkdr_hash(F.col("s"), mask=0x7FFFFF, empty=-999))
    assert got[0][2] == 3313232
    for text, wrapped, masked in got:
        assert wrapped == (python_hash(text) if text else -1)
        assert masked == (python_hash(text, 0x7FFFFF) if text else -999)


def test_code_split_and_fill(spark):
    df = spark.createDataFrame([("01030001",), ("48336110",), ("0103",)], "c string")
    got = [tuple(r) for r in clean.split_code(df, ["c"]).select("c_BK", "c_RG").collect()]
    assert got == [("0103", "0001"), ("4833", "6110"), ("0103", "0103")]
    filled = clean.fill_empty(spark.createDataFrame([(None,), ("",), ("x",)], "c string"), ["c"])
    assert [r.c_filled for r in filled.collect()] == ["NULLs", "NANs", "x"]


def test_safe_number_and_flags(spark):
    df = spark.createDataFrame([("12",), ("x",), (None,)], "c string")
    assert [r[0] for r in df.select(fn.safe_number(F.col("c"))).collect()] == [12.0, -1.0, -1.0]
    flagged = clean.flag_in(clean.flag_in(df, "c", ["12"], "yes"), "c", ["12"], "no", negate=True)
    assert [(r.yes, r.no) for r in flagged.collect()] == [(1.0, 0.0), (0.0, 1.0), (0.0, 1.0)]
    assert [r.e for r in clean.flag_expr(df, F.col("c") == "12", "e", -1).collect()] == [1.0, 0.0, -1.0]


def test_qr_marks(spark):
    df = spark.createDataFrame([("x" * 26 + "Yz",), ("x" * 26 + "Y",), ("7abc",), ("",), (None,)], "c string")
    out = clean.qr_flag(clean.qr_flag(df, "c", "by_pos"), "c", "by_digit", None)
    assert [(r.by_pos, r.by_digit) for r in out.collect()] == [(1.0, 0.0), (0.0, 0.0), (0.0, 1.0), (0.0, 0.0), (0.0, 0.0)]


def test_low_cardinality(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("week"))
    assert clean.low_cardinality(df, ["id", "week"]) == ["week"]
    assert clean.low_cardinality(df, ["id", "week"], exact=False) == ["week"]


@pytest.mark.parametrize("value", [-1, 0])
def test_numeric_fill(spark, value):
    df = spark.createDataFrame([(None, 1.0), (2.0, None)], "a double, b double")
    assert [tuple(r) for r in clean.fill_numeric(df, value).collect()] == [(value, 1.0), (2.0, value)]
    assert clean.drop_null(df).count() == 0
