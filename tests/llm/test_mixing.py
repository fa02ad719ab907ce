import random
from collections import Counter

import pytest

from riskloom.llm.common import words_of
from riskloom.llm.mixing import mix
from pyspark.sql import functions as F


def fill(sizes, cycle=(5, 2, 1), cap=3):
    """Clamp and share again until nothing is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return {**target, **share}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_taken(spark, seed):
    draw = random.Random(seed)
    rows = []
    for s in ["a", "b", "c", "d", "é", "Z", None]:
        for _ in range(draw.choice([3, 40, 400])):
            rows.append((len(rows), s, draw.choice([0, 1, 20, 100, 100, 300, 5000])))
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint").repartition(5)
    out = mix(docs).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want, taken, most = fill(sizes), Counter(), Counter()
    for r in out:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.times * r.size and 0 <= r.times <= 3
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1
    assert sorted(map(tuple, mix(docs.repartition(2)).collect()), key=repr) == sorted(map(tuple, out), key=repr)


def test_awkward_and_empty(spark, awkward, empty):
    sized = awkward.withColumn("size", F.size(words_of(F.col("text"))).cast("bigint")).withColumn("target", F.lit("x"))
    rows = mix(sized).collect()
    assert len(rows) == awkward.count() and all(isinstance(r.target, float) for r in rows)
    assert mix(empty.withColumn("size", F.lit(1).cast("bigint"))).collect() == []
    zero = spark.createDataFrame([(1, "a", 0), (2, None, 0)], "doc_id bigint, source string, size bigint")
    assert [(r.target, r.taken) for r in mix(zero).collect()] == [(0.0, 0)] * 2
