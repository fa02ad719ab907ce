import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from compare import sorted_rows
from riskloom.operators import labels as lb
from riskloom.operators import order as od
from riskloom.operators import profile as pf
from riskloom.operators.tokens import cooccurrence
from riskloom.ml import encode


def test_mode_tie_takes_larger_value(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("a", "z"), ("a", "z")], "k string, v string")
    r = pf.mode_by(df, "k", "v").first()
    assert (r.mode_v, r.mode_v_cnt) == ("z", 2)


def test_top_n_ties(spark):
    df = spark.createDataFrame([("a", 5), ("b", 2), ("b", 3), ("c", 3)], "k string, v int")
    assert od.top_n_sum(df, "k", "v", 1, "one").count() == 1
    assert od.top_n_sum(df, "k", "v", 1, "all").count() == 2


def test_secondary_sort_golden(spark):
    # Public teaching example, key and subkey descending.
    rows = [("x", 2, 9), ("y", 2, 5), ("x", 1, 3), ("y", 1, 7), ("y", 3, 1), ("x", 3, 6), ("z", 1, 4), ("z", 2, 8), ("z", 3, 7), ("z", 4, 0)]
    got = [tuple(r) for r in od.secondary_sort(spark.createDataFrame(rows, "k string, s int, v int"), ["k"], ["s"]).collect()]
    assert got == [("z", 4, 0), ("z", 3, 7), ("z", 2, 8), ("z", 1, 4), ("y", 3, 1), ("y", 2, 5), ("y", 1, 7), ("x", 3, 6), ("x", 2, 9), ("x", 1, 3)]


def test_pairs_of_tokens_are_made_by_compiled_code(spark):
    """No lambda over the words of a text, and no sort of the pairs for their words' totals."""
    plan = cooccurrence(spark.createDataFrame([("a b a",)], "text string"), "text", 2)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "arrays_zip" in plan
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan


def test_cooccurrence_against_brute_force(spark):
    texts = ["a b a  c", "b b b", "", "one", "x\ty\nz ", None]
    counts = Counter()
    for text in texts:
        if text is None:
            continue
        tokens = text.rstrip().replace("\t", " ").replace("\n", " ").split(" ")
        for i, tok in enumerate(tokens):
            for j in range(max(0, i - 2), min(len(tokens), i + 3)):
                if i != j:
                    counts[tok, tokens[j]] += 1
    totals = Counter()
    for (word, _), n in counts.items():
        totals[word] += n
    out = cooccurrence(spark.createDataFrame([(t,) for t in texts], "text string"), "text", 2).collect()
    assert {(r.word, r.neighbour): r.cnt for r in out} == dict(counts)
    assert all(r.relative_frequency == pytest.approx(r.cnt / totals[r.word]) for r in out)


def test_woe_zero_cell_is_finite(spark):
    df = spark.createDataFrame([("x", 0), ("x", 1), ("y", 0), ("y", 0), (None, 1)], "c string, label int")
    woe = {r.value: r.woe for r in encode.woe_table(df, ["c"], "label").collect()}
    assert woe["y"] == pytest.approx(math.log((1 / 2) / (2 / 3)))
    assert woe[None] == pytest.approx(math.log((1 / 2) / (1 / 3)))
    bare = {r.value: r.woe for r in encode.woe_table(df, ["c"], "label", zero=0).collect()}
    assert bare["y"] is None
    applied = encode.apply_woe(df, encode.woe_table(df, ["c"], "label"), ["c"]).collect()
    assert len(applied) == 5 and all(r.c_woe == pytest.approx(woe[r.c]) for r in applied)


def test_sampling_is_exact_and_repeatable(spark):
    df = spark.range(20_000).withColumnRenamed("id", "card")
    twice = df.unionByName(df)
    a, b = lb.sample_n(twice, "card", 777, 3), lb.sample_n(twice.repartition(11), "card", 777, 3)
    assert a.count() == 777 and sorted_rows(a.collect()) == sorted_rows(b.collect())
    assert lb.sample_n(df, "card", 50_000).count() == 20_000
    assert abs(lb.sample_fraction(df, "card", 0.1, 1).count() - 2000) < 200
    parts = lb.split(df, "card", [0.8, 0.1, 0.1], 2)
    assert sum(p.count() for p in parts) == 20_000 and abs(parts[0].count() - 16_000) < 400


def test_label_and_confusable(spark):
    rows = [(1, "a", 0), (2, "a", 0), (3, "b", 0), (3, "b", 0)]
    txns = spark.createDataFrame(rows, "id int, card string, x int")
    fraud = spark.createDataFrame([(1, "a"), (1, "a"), (9, "z")], "id int, card string")
    labelled = lb.label_transactions(txns, fraud, ["id", "card"])
    assert sorted((r.id, r.label) for r in labelled.collect()) == [(1, 1.0), (2, 0.0), (3, 0.0), (3, 0.0)]
    assert sorted(r.id for r in lb.drop_confusable(labelled, "card", "label").collect()) == [1, 3, 3]
    assert [r.id for r in lb.select_fraud(txns, fraud, ["id"]).collect()] == [1]
    assert lb.cap_activity(txns, "card", 2).count() == 0


def test_risk_lists(spark):
    rows = [("p", "x", 0), ("p", "y", 1), ("q", "y", 0), ("q", "z", 1), ("q", None, 0)]
    df = spark.createDataFrame(rows, "person string, shop string, label int")
    values = pf.learn_risk_values(df, "shop", "label")
    assert {r.shop: r.risk_only for r in values.collect()} == {"x": 1, "y": 0}
    got = {r.person: (r.bad_cnt, r.risk_cnt, r.txn_cnt, r.has_risk) for r in pf.risk_exposure(df, "person", "shop", values).collect()}
    assert got == {"p": (2, 1, 2, 1.0), "q": (1, 0, 3, 0.0)}


def test_dictionary_is_dense(spark):
    df = spark.range(5000).select((F.col("id") % 1234).cast("string").alias("v"))
    ids = [r.v_idx for r in encode.dictionary(df, "v").collect()]
    assert sorted(ids) == list(range(1234))


def test_freq_items_and_moments(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [("c",)], "v string")
    assert {r.value for r in pf.freq_items(df, ["v"], 0.25).collect()} == {"a", "b"}
    r = pf.activity_moments(df, "v").first()
    assert r.avg_cnt == pytest.approx(10 / 3) and r.var_cnt == pytest.approx((36 + 9 + 1) / 3 - (10 / 3) ** 2)


def test_rows_without_a_label_stay(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, "b", 0), (4, "b", None), (5, "a", -1), (6, None, None)], "id int, card string, y int")
    assert sorted(r.id for r in lb.drop_confusable(df, "card", "y").collect()) == [1, 3, 4, 5, 6]
    assert sorted(r.id for r in lb.rebalance(df, "y", "id", {0: 0.0}).collect()) == [1, 4, 5, 6]


def test_hash_vector_keeps_rows_without_a_text(spark):
    df = spark.createDataFrame([(1, "x", "y"), (2, None, "y"), (3, None, None)], "id int, a string, b string")
    rows = {r.id: r.norm_features for r in encode.hash_vector(df, ["a", "b"]).collect()}
    assert sorted(rows) == [1, 2, 3] and list(rows[3]) == pytest.approx([-(0.5 ** 0.5)] * 2)


def test_exact_quantiles_of_awkward_numbers(spark):
    inf = float("inf")
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, "nan", inf, -inf, 4, 1.7e308, -1.7e308)] + [(None,)], "v double")
    got = [r.value for r in pf.quantiles(df, "v", [0.0, 1 / 7, 0.5, 1.0], exact=True).collect()]
    assert got == [-inf, -1.7e308, 2.5, inf]
    only = spark.createDataFrame([(inf,), (inf,), (float("nan"),)], "v double")
    assert [r.value for r in pf.quantiles(only, "v", [0.1, 0.9], exact=True).collect()] == [inf, inf]


def test_one_hot_has_a_slot_for_each_level(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "i double")
    assert {len(r.i_vec) for r in encode.one_hot(["i"]).fit(df).transform(df).collect()} == {3}


def test_too_many_categories_fail_early(spark):
    df = spark.range(5000).withColumn("c", F.col("id").cast("string"))
    with pytest.raises(ValueError):
        encode.check_categories(df, ["c"], 1000)
