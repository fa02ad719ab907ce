from pyspark.sql import functions as F

from riskloom.operators import sketches as sk
from riskloom.session import stored


def rows_of(spark, n=60_000):
    return spark.range(n).select(
        (F.col("id") % 30).cast("int").alias("day"), (F.pmod(F.xxhash64("id"), F.lit(20_000))).alias("many"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("v"), F.pmod(F.xxhash64("id"), F.lit(50)))).alias("few"))


def test_merged_days_equal_the_rows_within_the_bounds(spark):
    rows = rows_of(spark)
    days = stored(sk.daily_sketches(rows, "day", ["many", "few"]), "days")
    assert days.count() == 60  # days times columns, whatever the rows
    got = stored(sk.merged(days, 3, 17), "merged")
    inside = rows.where("day BETWEEN 3 AND 17")
    exact = inside.agg(F.count_distinct("many").alias("many"), F.count_distinct("few").alias("few"), F.count("few").alias("n")).first()
    distinct = {r.col: r for r in sk.distinct_estimates(got).collect()}
    assert abs(distinct["many"].distinct_cnt / exact.many - 1) < 0.025 and distinct["few"].distinct_cnt == exact.few
    assert distinct["few"].n == exact.n
    for r in sk.quantile_estimates(got, [0.05, 0.5, 0.95]).collect():
        assert r.col == "many"  # texts that are no numbers have no quantiles
        share = inside.agg(F.avg((F.col("many") <= r.value).cast("int"))).first()[0]
        assert abs(share - r.probability) < 0.006
    top = sk.frequent_estimates(got, 0.2).collect()
    hot = inside.where("few = 'hot'").count()
    assert [(r.col, r.value, r.cnt) for r in top] == [("few", "hot", hot)]


def test_merging_merged_rows_is_merging_days(spark):
    days = stored(sk.daily_sketches(rows_of(spark, 9000), "day", ["many", "few"]), "days")
    whole = sk.merged(days)
    halves = sk.merged(days, 0, 14).unionByName(sk.merged(days, 15, 29))
    again = sk.merged(halves)
    for a, b in zip(*(sorted(map(tuple, sk.distinct_estimates(m).collect())) for m in (again, whole))):
        assert a[:2] == b[:2] and abs(a[2] / b[2] - 1) < 0.01  # the estimate of a union depends a little on the way it was merged
    assert sorted(map(tuple, sk.frequent_estimates(again, 0.2).collect())) == sorted(map(tuple, sk.frequent_estimates(whole, 0.2).collect()))


def test_rows_without_a_day_and_no_rows(spark):
    rows = rows_of(spark, 900).withColumn("day", F.when(F.col("day") > 1, F.col("day")))
    days = sk.daily_sketches(rows, "day", ["few"])
    assert days.where("day IS NULL").first().rows == 60
    assert sk.daily_sketches(rows.where("false"), "day", ["few"]).collect() == []
    assert sk.distinct_estimates(sk.merged(days, 100, 200)).collect() == []
