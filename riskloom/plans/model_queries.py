"""Queries over encoding, models and evaluation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.ml import encode, evaluate, models
from riskloom.operators.labels import split
from riskloom.operators.order import union_all
from riskloom.plans.label_queries import bucket_sql
from riskloom.plans.registry import query, rounded
from riskloom.session import stored

NUMBERS = ["l_quantity", "l_discount", "l_tax"]


@query("""
WITH f AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS i FROM txn GROUP BY event_type),
p AS (SELECT CAST(place AS VARCHAR) AS place, row_number() OVER (ORDER BY count(*) DESC, CAST(place AS VARCHAR)) - 1 AS i FROM txn GROUP BY 1)
SELECT txn_id, CAST(f.i AS DOUBLE) AS event_type_idx, CAST(p.i AS DOUBLE) AS place_idx
FROM txn JOIN f USING (event_type) JOIN p ON p.place = CAST(txn.place AS VARCHAR)
""")
def frequency_index(t):
    rows = t.txn.select("txn_id", "event_type", F.col("place").cast("string").alias("place"))
    return encode.fit_categories(rows, ["event_type", "place"]).transform(rows).select("txn_id", "event_type_idx", "place_idx")


NUMBERED_SQL = "SELECT {c}, row_number() OVER (ORDER BY md5(CAST({c} AS VARCHAR)), {c}) - 1 AS {c}_idx FROM (SELECT DISTINCT {c} FROM {t})"


@query("WITH d AS (" + NUMBERED_SQL.format(c="l_partkey", t="lineitem") + ") SELECT l_orderkey, l_linenumber, l_partkey_idx FROM lineitem JOIN d USING (l_partkey)")
def dictionary_index(t):
    return encode.dictionary_index(t.lineitem, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey_idx")


@query("""
SELECT txn_id, CAST(event_type = 'click' AS INTEGER) + CAST(event_type = 'error' AS INTEGER) + CAST(event_type = 'purchase' AS INTEGER) +
  CAST(event_type = 'signup' AS INTEGER) + CAST(event_type = 'view' AS INTEGER) AS ones,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS hot FROM txn
""")
def one_hot_vectors(t):
    rows = t.txn.select("txn_id", "event_type")
    indexed = encode.fit_categories(rows, ["event_type"], order="alphabetAsc").transform(rows)
    encoded = encode.one_hot(["event_type_idx"]).fit(indexed).transform(indexed)
    levels = vector_to_array("event_type_idx_vec")
    return encoded.select("txn_id", F.aggregate(levels, F.lit(0.0), lambda a, b: a + b).cast("int").alias("ones"),
                          (F.array_position(levels, 1.0) - 1).cast("int").alias("hot"))


@query("""
SELECT l_orderkey, l_linenumber, round(l_quantity / n, 6) AS a, round(l_discount / n, 6) AS b, round(l_tax / n, 6) AS c
FROM (SELECT *, sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax) AS n FROM lineitem)
""")
def unit_vectors(t):
    vectors = encode.normalize().transform(encode.assemble(NUMBERS).transform(t.lineitem))
    v = vector_to_array("norm_features")
    return rounded(vectors.select("l_orderkey", "l_linenumber", *[v[i].alias(n) for i, n in enumerate("abc")]))


@query("""
SELECT l_orderkey, l_linenumber, round((l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()), 6) AS a,
  round((l_discount - min(l_discount) OVER ()) / (max(l_discount) OVER () - min(l_discount) OVER ()), 6) AS b FROM lineitem
""")
def min_max_scaled(t):
    rows = encode.assemble(NUMBERS[:2]).transform(t.lineitem.select("l_orderkey", "l_linenumber", *NUMBERS))
    v = vector_to_array("scaled_features")
    out = encode.scale("minmax").fit(rows).transform(rows)
    return rounded(out.select("l_orderkey", "l_linenumber", v[0].alias("a"), v[1].alias("b")))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / (SELECT stddev_samp(l_quantity) FROM lineitem), 5) AS a FROM lineitem")
def standard_scaled(t):
    rows = encode.assemble(NUMBERS[:1]).transform(t.lineitem.select("l_orderkey", "l_linenumber", *NUMBERS))
    out = encode.scale("standard").fit(rows).transform(rows)
    return rounded(out.select("l_orderkey", "l_linenumber", vector_to_array("scaled_features")[0].alias("a")), 5)


@query("""
SELECT txn_id, CASE WHEN cents < 10 THEN 0e0 WHEN cents < 100 THEN 1e0 WHEN cents < 1000 THEN 2e0 WHEN cents < 10000 THEN 3e0 WHEN cents < 100000 THEN 4e0
  ELSE 5e0 END AS bucket FROM txn
""")
def fixed_buckets(t):
    from riskloom.schema import AMOUNT_EDGES

    rows = t.txn.select("txn_id", F.col("cents").cast("double").alias("cents"))
    return encode.bucketize("cents", AMOUNT_EDGES, "bucket").transform(rows).select("txn_id", "bucket")


@query("SELECT txn_id, CAST(least(hour(ts), 11) AS DOUBLE) AS bucket FROM txn")
def hour_buckets(t):
    from riskloom.schema import HOUR_EDGES

    rows = t.txn.select("txn_id", F.hour("ts").cast("double").alias("hour"))
    return encode.bucketize("hour", HOUR_EDGES, "bucket").transform(rows).select("txn_id", "bucket")


@query()
def quantile_buckets(t):
    """(bucket, n, low, high) of fifteen buckets whose edges come from a sketch."""
    rows = t.txn.select("txn_id", F.col("cents").cast("double").alias("cents"))
    out = encode.quantile_buckets("cents", 15, "bucket").fit(rows).transform(rows)
    return out.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("cents").alias("low"), F.max("cents").alias("high"))


# Edges come from a sketch: every bucket holds its 15th within the rank error on both sides, ties at an edge apart.
@query("SELECT count(*) AS rows, 15 AS buckets, true AS balanced, true AS ordered FROM txn")
def quantile_bucket_checks(t):
    ties = t.txn.groupBy("cents").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("ties"))
    sizes = quantile_buckets(t)
    after = F.lead("low").over(Window.orderBy("bucket"))  # one row per bucket
    whole = sizes.withColumn("in_order", F.coalesce(F.col("high") < after, F.lit(True))).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).cast("int").alias("buckets"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.bool_and("in_order").alias("ordered"))
    slack = F.col("rows") * 0.002 + F.col("ties") + 1
    return whole.join(F.broadcast(ties)).select("rows", "buckets", (
        (F.col("most") <= F.col("rows") / 15 + slack) & (F.col("least") >= F.col("rows") / 15 - slack)).alias("balanced"), "ordered")


WOE_COLS = ["l_suppkey", "l_linestatus", "l_linenumber"]
WOE_SQL = """
long AS (SELECT 'l_suppkey' AS col, CAST(l_suppkey AS VARCHAR) AS value, label FROM lines UNION ALL
  SELECT 'l_linestatus', l_linestatus, label FROM lines UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), label FROM lines),
tot AS (SELECT count(*) FILTER (WHERE label = 1) AS b, count(*) FILTER (WHERE label = 0) AS g FROM lines),
cells AS (SELECT col, value, count(*) FILTER (WHERE label = 1) AS bad, count(*) FILTER (WHERE label = 0) AS good FROM long GROUP BY ALL),
woe AS (SELECT col, value, bad, good, greatest(bad, 1) / CAST(b AS DOUBLE) AS p1, greatest(good, 1) / CAST(g AS DOUBLE) AS p0 FROM cells, tot)"""


@query(f"WITH {WOE_SQL.strip()} SELECT col, value, bad, good, round(p1, 8) AS p1, round(p0, 8) AS p0, round(ln(p1 / p0), 6) AS woe FROM woe")
def weight_of_evidence(t):
    out = encode.woe_table(t.lines, WOE_COLS, "label")
    return out.withColumns({"p1": F.round("p1", 8), "p0": F.round("p0", 8), "woe": F.round("woe", 6)})


@query(f"WITH {WOE_SQL.strip()} SELECT col, round(sum((p1 - p0) * ln(p1 / p0)), 8) AS iv, count(value) AS category_cnt FROM woe GROUP BY col")
def information_value(t):
    return rounded(encode.iv_table(t.lines, WOE_COLS, "label"), 8)


@query(f"""WITH {WOE_SQL.strip()}
SELECT l_orderkey, l_linenumber, round(ln(a.p1 / a.p0), 6) AS l_suppkey_woe, round(ln(b.p1 / b.p0), 6) AS l_linestatus_woe
FROM lines l JOIN woe a ON a.col = 'l_suppkey' AND a.value = CAST(l.l_suppkey AS VARCHAR) JOIN woe b ON b.col = 'l_linestatus' AND b.value = l.l_linestatus""")
def weight_of_evidence_on_rows(t):
    lines = t.lines
    table = encode.woe_table(lines, ["l_suppkey", "l_linestatus"], "label")
    out = encode.apply_woe(lines, table, ["l_suppkey", "l_linestatus"])
    return rounded(out.select("l_orderkey", "l_linenumber", "l_suppkey_woe", "l_linestatus_woe"))


@query("""
WITH h AS (SELECT p_partkey,
    CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_brand, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda x, y: (x * 131 + y) % 8388608) AS DOUBLE) AS a,
    CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_type, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda x, y: (x * 131 + y) % 8388608) AS DOUBLE) AS b
  FROM part)
SELECT p_partkey, round(a / sqrt(a * a + b * b), 6) AS x, round(b / sqrt(a * a + b * b), 6) AS y FROM h
""")
def hashed_vectors(t):
    v = vector_to_array("norm_features")
    out = encode.hash_vector(t.part, ["p_brand", "p_type"], mask=0x7FFFFF)
    return rounded(out.select("p_partkey", v[0].alias("x"), v[1].alias("y")))


# The statistic is exact in SQL; the selector's limit is the 5 % point, here by the Wilson-Hilferty formula.
CHI2_SQL = """SELECT CAST({i} AS INTEGER) AS feature, x, y, count(*) AS n FROM (SELECT {x} AS x, cents > 3000 AS y FROM txn) GROUP BY x, y"""
CHI2_PARTS = " UNION ALL ".join(CHI2_SQL.format(i=i, x=x) for i, x in enumerate(["hour(ts)", "floor(log10(cents + 1))", "place"]))


@query(f"""
WITH c AS ({CHI2_PARTS}),
r AS (SELECT feature, x, sum(n) AS nx FROM c GROUP BY ALL), k AS (SELECT feature, y, sum(n) AS ny FROM c GROUP BY ALL), t AS (SELECT count(*) AS n FROM txn),
s AS (SELECT r.feature, sum(pow(coalesce(c.n, 0) - nx * ny / CAST(t.n AS DOUBLE), 2) / (nx * ny / CAST(t.n AS DOUBLE))) AS stat,
    (count(DISTINCT r.x) - 1) * (count(DISTINCT k.y) - 1) AS dof
  FROM r JOIN k ON r.feature = k.feature CROSS JOIN t LEFT JOIN c ON c.feature = r.feature AND c.x = r.x AND c.y = k.y GROUP BY r.feature)
SELECT feature, CAST(dof AS BIGINT) AS dof, round(stat, 4) AS statistic,
  stat > dof * pow(1 - 2 / (9e0 * dof) + 1.6448536 * sqrt(2 / (9e0 * dof)), 3) AS selected FROM s""")
def chi_square_selection(t):
    rows = t.txn.select(F.hour("ts").cast("double").alias("hour"), F.floor(F.log10(F.col("cents") + 1)).cast("double").alias("digits"),
                        F.col("place").cast("double").alias("place"), (F.col("cents") > 3000).cast("double").alias("label"))
    vectors = encode.assemble(["hour", "digits", "place"]).transform(rows)
    chosen = set(encode.select_chi2(vectors, "features", "label").selectedFeatures)
    out = encode.chi2_table(vectors, "features", "label")
    return rounded(out.withColumn("selected", F.col("feature").isin(*chosen) if chosen else F.lit(False)), 4)


WIDE_COLS = ["l_partkey", "l_suppkey", "l_linestatus"]
WIDE_PARTS = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value, l_quantity > 25 AS y, count(*) AS o FROM lineitem GROUP BY ALL" for c in WIDE_COLS)


@query(f"""
WITH c AS ({WIDE_PARTS}),
r AS (SELECT col, value, sum(o) AS r FROM c GROUP BY ALL), k AS (SELECT col, y, sum(o) AS k FROM c GROUP BY ALL), n AS (SELECT count(*) AS n FROM lineitem)
SELECT r.col, any_value(n.n) AS rows, count(DISTINCT r.value) AS categories, (count(DISTINCT r.value) - 1) * (count(DISTINCT k.y) - 1) AS dof,
  round(sum(pow(coalesce(c.o, 0) - r * k / CAST(n.n AS DOUBLE), 2) / (r * k / CAST(n.n AS DOUBLE))), 4) AS statistic
FROM r JOIN k ON k.col = r.col CROSS JOIN n LEFT JOIN c ON c.col = r.col AND c.value = r.value AND c.y = k.y GROUP BY r.col""")
def chi_square_wide(t):
    rows = t.lineitem.withColumn("large", F.col("l_quantity") > 25)
    return rounded(encode.chi2_wide(rows, WIDE_COLS, "large").select("col", "rows", "categories", "dof", "statistic"), 4)


@query()
def chi_square_wide_p_values(t):
    """The p-values of the same tests. SQL has no incomplete gamma function; a test compares them with Spark ML's."""
    return encode.chi2_wide(t.lineitem.withColumn("large", F.col("l_quantity") > 25), WIDE_COLS, "large")


# --- models -----------------------------------------------------------------------------------

def _training(t):
    rows = t.txn.select("txn_id", "ts", F.col("label").cast("double").alias("label"), F.col("cents").cast("double").alias("cents"),
                        F.hour("ts").cast("double").alias("hour"), F.col("place").cast("double").alias("place"))
    return encode.assemble(["cents", "hour", "place"]).transform(rows)


def _telling(t):
    """The rows with a label that the columns tell, but for a tenth of them: large amounts, and middle ones at night."""
    large = (F.col("cents") > 8000) | (F.col("cents") > 4000) & (F.col("hour") < 6)
    noise = F.pmod(F.xxhash64("txn_id"), F.lit(10)) == 0
    return _training(t).withColumn("label", (large != noise).cast("double"))


# Models are trained on four fifths of the rows and score the held-out fifth. Their scores differ between engines, so the queries that return
# them have no SQL twin; tests hold them against floors. The twins compare which rows are held out, their labels and the range of the scores.
HELD_SQL = f"FROM txn WHERE {bucket_sql('txn_id', 7)} >= 800000"
SCORED_SQL = f"SELECT txn_id, CAST(label AS DOUBLE) AS label, true AS is_class, true AS in_range {HELD_SQL}"


def _held_out(t, rows):
    """(training rows, held-out rows). Training rows are dealt to every core and lie in the order of their values, so the histograms of a tree
    are filled from one end to the other; a table of one split would be trained on by one task."""
    train, test = split(rows, "txn_id", [0.8, 0.2], 7)
    tasks = max(t.spark.sparkContext.defaultParallelism, t.events.rdd.getNumPartitions())
    return train.repartition(tasks, "txn_id").sortWithinPartitions("cents", "hour", "place", "txn_id"), test


def _scores(scored):
    p = vector_to_array("probability")
    return scored.select("txn_id", "label", "prediction", p[1].alias("score"))


@query()
def random_forest_scores(t):
    train, test = _held_out(t, _telling(t))
    return _scores(models.train_rf(train, models.FOREST_WIDE).transform(test))


@query()
def deep_forest_scores(t):
    train, test = _held_out(t, _telling(t))
    return _scores(models.train_rf(train, models.FOREST_DEEP).transform(test))


@query(SCORED_SQL)
def random_forest_checks(t):
    train, test = _held_out(t, _training(t))
    return _scores(models.train_rf(train, models.FOREST_SMALL).transform(test)).select(
        "txn_id", "label", F.col("prediction").isin(0.0, 1.0).alias("is_class"), F.col("score").between(0.0, 1.0).alias("in_range"))


@query()
def random_forest_importances(t):
    """(feature, importance), the most telling feature first."""
    train, _ = _held_out(t, _telling(t))
    return evaluate.importances(models.train_rf(train, models.FOREST_COST), ["cents", "hour", "place"], t.spark)


@query()
def boosted_tree_scores(t):
    train, test = _held_out(t, _telling(t))
    return _scores(models.train_gbt(train, iterations=40, step=0.1).transform(test))


@query()
def forest_trained_by_day(t):
    """The confusion row of a forest trained on one day and tested on the next."""
    _, scored = models.train_test_by_day(_telling(t), "ts", "2024-01-10", "2024-01-11", models.FOREST_SMALL)
    return evaluate.confusion(scored)


@query("SELECT count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives FROM txn WHERE CAST(ts AS DATE) = DATE '2024-01-11'")
def forest_trained_by_day_labels(t):
    _, scored = models.train_test_by_day(_training(t), "ts", "2024-01-10", "2024-01-11", models.FOREST_TINY)
    return evaluate.confusion(scored).selectExpr("tp + fn AS positives", "tn + fp AS negatives")


def _points(t):
    from pyspark.ml.functions import array_to_vector

    return t.embeddings.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


@query("SELECT vec_id, 1 AS clusters FROM embeddings")
def k_means_members(t):
    """(vec_id, clusters): the members of each of the ten clusters are kept by themselves; every vector is in exactly one of them."""
    # A row has a number of its own, so a repeated or missing vec_id stays as many rows as it is.
    points = stored(_points(t).withColumn("_row", F.monotonically_increasing_id()), "points")
    model = models.cluster(points, 10, 1)
    members = [models.cluster_members(model, points, k).select("vec_id", "_row") for k in range(10)]
    return union_all(*members).groupBy("vec_id", "_row").agg(F.count(F.lit(1)).cast("int").alias("clusters")).drop("_row")


@query()
def k_means_clusters(t):
    """(vec_id, cluster): the cluster of every vector."""
    points = stored(_points(t), "points")
    return models.cluster(points, 10, 1).transform(points).select("vec_id", F.col("prediction").alias("cluster"))


@query("SELECT vec_id, true AS is_cluster FROM embeddings")
def k_means_checks(t):
    return k_means_clusters(t).select("vec_id", F.col("cluster").between(0, 9).alias("is_cluster"))


@query()
def k_means_cost_scan(t):
    """(k, cost) of a full fit for each k."""
    return models.k_scan(_points(t), [5, 10, 15, 20, 25, 30])


@query()
def k_means_coreset_scan(t):
    """(k, cost): centres fitted on one coreset for all k, costs measured on every vector in one pass."""
    return models.k_scan_coreset(_points(t), [5, 10, 15, 20, 25, 30], "vec_id")


# --- evaluation -------------------------------------------------------------------------------

@query("""
WITH c AS (SELECT count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS tp, count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS tn,
  count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS fp, count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS fn FROM labels)
SELECT tp, tn, fp, fn, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 6) AS precision_1, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS recall_1,
  round(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 6) AS f1_1, round(tn / nullif(CAST(tn + fn AS DOUBLE), 0), 6) AS precision_0,
  round(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 6) AS recall_0, round(2 * tn / nullif(CAST(2 * tn + fp + fn AS DOUBLE), 0), 6) AS f1_0 FROM c
""")
def confusion_matrix(t):
    return rounded(evaluate.confusion(t.labels, "toxic", "quality"))


@query("""
WITH c AS (SELECT cut, count(*) FILTER (WHERE label = 1 AND l_discount < cut) AS tp, count(*) FILTER (WHERE label = 0 AND l_discount >= cut) AS tn,
  count(*) FILTER (WHERE label = 0 AND l_discount < cut) AS fp, count(*) FILTER (WHERE label = 1 AND l_discount >= cut) AS fn
  FROM lines, (SELECT unnest([0.015, 0.025, 0.045, 0.065]::DOUBLE[]) AS cut) GROUP BY cut)
SELECT cut, tp, tn, fp, fn, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 6) AS precision_1, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS recall_1,
  round(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 6) AS f1_1, round(tn / nullif(CAST(tn + fn AS DOUBLE), 0), 6) AS precision_0,
  round(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 6) AS recall_0, round(2 * tn / nullif(CAST(2 * tn + fp + fn AS DOUBLE), 0), 6) AS f1_0 FROM c
""")
def threshold_sweep(t):
    return rounded(evaluate.threshold_report(t.lines, "l_discount", "label", [0.015, 0.025, 0.045, 0.065]))


@query("""
WITH s AS (SELECT l_discount AS s, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM lines GROUP BY l_discount),
c AS (SELECT p, n, sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS below FROM s)
SELECT round(sum(p * (below + n / 2.0)) / (sum(p) * CAST(sum(n) AS DOUBLE)), 6) AS roc FROM c
""")
def roc_area(t):
    rows = t.lines.select(F.col("label").cast("double").alias("label"), F.col("l_discount").alias("rawPrediction"))
    return t.spark.createDataFrame([(round(evaluate.auc(rows), 6),)], "roc double")


EXACT_SQL = """
WITH s AS (SELECT cents AS s, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM txn GROUP BY cents),
c AS (SELECT s, p, n, sum(p) OVER w AS hp, sum(p + n) OVER w AS h, sum(n) OVER (ORDER BY s) - n AS below FROM s WINDOW w AS (ORDER BY s DESC)),
e AS (SELECT *, hp / CAST(h AS DOUBLE) AS q, lag(hp / CAST(h AS DOUBLE)) OVER (ORDER BY s DESC) AS before FROM c)
SELECT round(sum(p * (below + n / 2.0)) / (sum(p) * CAST(sum(n) AS DOUBLE)), 6) AS roc, round(sum(p * (q + coalesce(before, q)) / 2) / sum(p), 6) AS pr,
  CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives FROM e
"""


@query(EXACT_SQL)
def exact_areas(t):
    return rounded(evaluate.exact_areas(t.txn, "cents"))


@query(EXACT_SQL)
def exact_areas_split(t):
    return rounded(evaluate.exact_areas(t.txn, "cents", parts=97))


@query("""
WITH s AS (SELECT cents AS cut, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM txn GROUP BY cents),
c AS (SELECT cut, CAST(sum(p) OVER w - p AS BIGINT) AS tp, CAST(sum(n) OVER w - n AS BIGINT) AS fp, CAST(sum(p) OVER () AS BIGINT) AS ap,
  CAST(sum(n) OVER () AS BIGINT) AS an FROM s WINDOW w AS (ORDER BY cut))
SELECT cut, tp, an - fp AS tn, fp, ap - tp AS fn FROM c
""")
def threshold_at_every_score(t):
    return evaluate.every_threshold(t.txn, "cents").select("cut", "tp", "tn", "fp", "fn")


# Trapezoids over (recall, precision) from the highest score down, starting at recall 0 with the first precision.
@query("""
WITH s AS (SELECT l_discount AS s, count(*) FILTER (WHERE label = 1) AS p, count(*) AS n FROM lines GROUP BY l_discount),
c AS (SELECT s, sum(p) OVER (ORDER BY s DESC) / CAST(sum(p) OVER () AS DOUBLE) AS r, sum(p) OVER (ORDER BY s DESC) / CAST(sum(n) OVER (ORDER BY s DESC) AS DOUBLE) AS q FROM s),
e AS (SELECT r - coalesce(lag(r) OVER (ORDER BY s DESC), 0) AS w, (q + coalesce(lag(q) OVER (ORDER BY s DESC), q)) / 2 AS h FROM c)
SELECT round(sum(w * h), 6) AS pr FROM e
""")
def precision_recall_area(t):
    rows = t.lines.select(F.col("label").cast("double").alias("label"), F.col("l_discount").alias("rawPrediction"))
    return t.spark.createDataFrame([(round(evaluate.auc(rows, "areaUnderPR"), 6),)], "pr double")


@query("""
SELECT round(avg(CASE WHEN toxic = quality THEN 1e0 ELSE 0e0 END), 6) AS accuracy,
  round((SELECT sum(n * coalesce(h / nullif(CAST(g AS DOUBLE), 0), 0)) / sum(n) FROM (
    SELECT c, (SELECT count(*) FROM labels WHERE toxic = c) AS n, (SELECT count(*) FROM labels WHERE quality = c) AS g,
      (SELECT count(*) FROM labels WHERE quality = c AND toxic = c) AS h FROM (SELECT unnest([0, 1]) AS c))), 6) AS weighted_precision FROM labels
""")
def multiclass_metrics(t):
    rows = t.labels.select(F.col("toxic").cast("double").alias("label"), F.col("quality").cast("double").alias("prediction"))
    values = [round(evaluate.multiclass_metric(rows, m), 6) for m in ("accuracy", "weightedPrecision")]
    return t.spark.createDataFrame([tuple(values)], "accuracy double, weighted_precision double")


@query("""
SELECT CAST(c AS DOUBLE) AS cls, (SELECT count(*) FROM labels WHERE quality = c AND toxic = c) AS hits, (SELECT count(*) FROM labels WHERE quality = c) AS guessed,
  (SELECT count(*) FROM labels WHERE toxic = c) AS actual,
  round((SELECT count(*) FROM labels WHERE quality = c AND toxic = c) / nullif(CAST((SELECT count(*) FROM labels WHERE quality = c) AS DOUBLE), 0), 6) AS "precision",
  round((SELECT count(*) FROM labels WHERE quality = c AND toxic = c) / nullif(CAST((SELECT count(*) FROM labels WHERE toxic = c) AS DOUBLE), 0), 6) AS recall
FROM (SELECT unnest([0, 1]) AS c)
""")
def per_class_report(t):
    return rounded(evaluate.per_class_report(t.labels, "toxic", "quality"))
