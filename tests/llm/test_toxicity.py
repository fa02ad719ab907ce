import numpy as np
import pytest

from riskloom.llm import toxicity as tox

FOLDER = "/root/testdata/sf0.01"


def test_fit_has_ordered_thresholds_and_shared_weights():
    draw = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(600):
        g = int(draw.integers(0, 4))
        rows.append(np.array(sorted(set(draw.choice(10, 2 * g).tolist() if g else []) | set((10 + draw.choice(20, 5)).tolist()))))
        grades.append(g)
    weights, cuts = tox.fit_ordinal(rows, np.array(grades), 30)
    assert (np.diff(cuts) > 0).all() and weights[:10].min() > weights[10:].max()


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 4 <> 0")
    return tox.fit(docs, train), docs, labels.where("doc_id % 4 = 0 AND toxic IS NOT NULL")


def test_held_out(spark, model):
    fitted, docs, held = model
    rows = tox.score(docs, fitted).join(held.withColumnRenamed("toxic", "truth"), "doc_id").collect()
    bad, good = [r for r in rows if r.truth == 1], [r for r in rows if r.truth == 0]
    assert sum(r.toxic for r in good) <= 0.03 * len(good)
    assert np.mean([r.severity for r in bad]) > 5 * np.mean([r.severity for r in good])


def test_scores_against_plain_python(spark, model, awkward, empty):
    fitted = model[0]
    mixed = awkward.unionByName(awkward.limit(1).selectExpr(*[
        "'You IDIOT, pathetic moron.' AS text" if c == "text" else c for c in awkward.columns]))
    rows = tox.score(mixed, fitted).collect()
    assert len(rows) == mixed.count()
    for r in rows:
        x = sum(fitted.weights.get(f, 0.0) for f in tox.text_features(r.text))
        assert r.severity == pytest.approx(sum(1 / (1 + np.exp(-np.clip(x - t, -40, 40))) for t in fitted.thresholds))
        assert isinstance(r.toxic, bool)
    assert [r.toxic for r in rows if r.text and "IDIOT" in r.text] == [True]
    assert tox.score(empty, fitted).collect() == []


def test_no_labels_of_both_kinds(spark, awkward):
    labels = spark.createDataFrame([(6, 0), (7, None), (None, 1)], "doc_id bigint, toxic int")
    assert tox.fit(awkward, labels) is None
    assert {(r.severity, r.grade, r.toxic) for r in tox.score(awkward, None).collect()} == {(0.0, 0, False)}
