from collections import Counter

import pytest

import corpus_pipeline as cp
from riskloom.llm import toxicity
from riskloom.llm.common import written
from test_mixing import fill
from test_near_dups import brute
from test_secrets import brute as spans

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def results(spark):
    out = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for _, stage in cp.STAGES:
        out.append(written(stage(spark, out[-1], FOLDER), "stage"))
    return out


def test_columns(results):
    assert all(x.columns == COLUMNS for x in results[:-1])


def test_toxic_go_and_all_others_stay(spark, results):
    model = toxicity.fit(results[0], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = [tuple(r)[:5] for r in toxicity.score(results[0], model).where("NOT toxic").select(*COLUMNS).collect()]
    assert sorted(map(tuple, results[1].collect())) == sorted(want) and 0 < len(want) < results[0].count()


def test_one_of_each_group_stays(results):
    rows = [(r.doc_id, r.text) for r in results[1].collect()]
    want = {i for i, (_, top) in brute(rows, 5).items() if i == top}
    assert {r.doc_id for r in results[2].collect()} == want and len(want) < len(rows)


def test_secrets_are_gone_and_clean_texts_stay(results):
    before = {r.doc_id: r for r in results[2].collect()}
    after = {r.doc_id: r for r in results[3].collect()}
    assert before.keys() == after.keys()
    for i, r in before.items():
        if spans(r.text):
            assert "[REDACTED]" in after[i].text and not spans(after[i].text) and after[i].n_chars == len(after[i].text)
        else:
            assert tuple(after[i]) == tuple(r)


def test_mix_meets_its_targets(results):
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in results[3].collect():
        n = len((r.text or "").split())
        sizes[r.source] += n
        most[r.source] = max(most[r.source], n)
    copies = Counter()
    for r in results[4].collect():
        taken[r.source] += len((r.text or "").split())
        copies[r.doc_id] += 1
    target = fill(sizes)
    assert max(copies.values()) <= 3
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1 for s in sizes)


def test_last_stage_has_a_row_for_each_row(results):
    assert Counter(r.doc_id for r in results[5].collect()) == Counter(r.doc_id for r in results[4].collect())


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_one_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a, "en", "s", 1), (7, a + " more", "en", "s", 1), (7, b, "en", "s", 1), (7, b, "de", "s", 1), (8, b + " more", "en", "s", 1),
            (9, c, "en", "s", 1), (9, c + " more", "en", "s", 1), (9, "", "en", "s", 1), (None, a, "en", "s", 1)]
    got = sorted(map(tuple, cp.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), FOLDER).collect()), key=str)
    last = [r for r in got if r[0] == 9 and r[1]]
    assert len(last) == 1 and last[0][1] in (c, c + " more")
    assert [r for r in got if r not in last] == sorted([rows[0], rows[3], rows[7], rows[8]], key=str)


def test_equal_rows_are_mixed_one_by_one(spark):
    text = " ".join(["w"] * 10)
    rows = [(1, text, "en", "a", 19)] * 300 + [(None, text, "en", "b", 19)] * 300 + [(i, text, "en", "c", 19) for i in range(300)]
    taken = Counter(r.source for r in cp.mix_sources(spark, spark.createDataFrame(rows, SCHEMA), FOLDER).collect())
    target = fill({s: 3000 for s in "abc"})
    assert all(abs(10 * taken[s] - target[s]) <= 10 for s in "abc")


def test_awkward_rows(spark, awkward, empty):
    for rows in (awkward, empty):
        for _, stage in cp.STAGES:
            rows = written(stage(spark, rows, FOLDER), "stage")
        assert rows.columns[0] == "doc_id"
    assert rows.count() == 0
