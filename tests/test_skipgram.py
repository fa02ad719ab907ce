import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import graph as g
from riskloom.operators import skipgram
from riskloom.operators.skipgram import embed_blocks, window_pairs
from riskloom.plans import load_queries
from riskloom.session import ensure_checkpoint_dir, stored


def frame(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "path array<bigint>")


def test_pairs_against_brute_force(spark):
    rng = random.Random(1)
    paths = [[rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(40)] + [[7], [], [3, 3, 3]]
    want = Counter()
    for p in paths:
        for i, word in enumerate(p):
            for j, context in enumerate(p):
                if 0 < abs(i - j) <= 4:
                    want[word, context] += 5 - abs(i - j)
    got = {(r.word, r.context): r.n for r in window_pairs(frame(spark, paths), 4).collect()}
    assert got == want


def test_blocks_find_communities(spark):
    """Three rings joined by a few steps; vectors of a ring lie closest to each other, whatever the partitions, and single nodes have one too."""
    rng = random.Random(2)
    paths = []
    for start in range(60):
        for _ in range(6):
            node, path = start, [start]
            for _ in range(14):
                ring = node // 20 if rng.random() < 0.99 else rng.randrange(3)
                node = ring * 20 + (node + rng.choice([-2, -1, 1, 2])) % 20
                path.append(node)
            paths.append(path)
    walks = frame(spark, paths + [[99]])
    rows = {int(r.word): r.vector for r in embed_blocks(walks, dim=16, window=4, iterations=5, block=31).collect()}
    again = {int(r.word): r.vector for r in embed_blocks(walks.repartition(5), dim=16, window=4, iterations=5, block=31).collect()}
    assert set(rows) == {*range(60), 99} and rows == again
    v = np.array([rows[i] for i in range(60)])
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = v @ v.T - 9 * np.eye(60)
    top = np.argsort(-near, axis=1)[:, :5]
    assert np.isfinite(v).all() and (top // 20 == np.arange(60)[:, None] // 20).mean() > 0.95


def test_node_embedding_counts_pairs_first(spark, monkeypatch):
    """One step for each occurrence of a pair does not end in time; no vocabulary is gathered on the driver either."""
    from pyspark.ml.feature import Word2Vec

    monkeypatch.setattr(Word2Vec, "fit", lambda *a, **k: pytest.fail("trained occurrence by occurrence"))
    rows = load_queries()[0]["node_embedding"](spark, "/root/testdata/sf0.001")
    assert rows.where("dim = 128 AND finite").count() == rows.count() > 0


def test_stored_rows_leave_no_shuffles_and_old_steps_go(spark, monkeypatch):
    """Shuffles of stored steps go with the store, and of the steps of walks and of the trained vectors only the last ones stay."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")

    def shuffles():
        found = blocks.getAllFiles()
        return {name for name in (found.apply(i).getName() for i in range(found.length())) if name.startswith("shuffle_")}

    def kept(name):
        return {x for x in os.listdir(folder) if x.startswith(name)}

    was, setting = shuffles(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    rows = stored(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count(), "grouped")
    assert not shuffles() - was and rows.count() == 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
    edges = spark.createDataFrame([(i, (i + d) % 40, 1.0) for i in range(40) for d in (1, 7)], "src bigint, dst bigint, weight double")
    steps, vectors = kept("walk-steps"), kept("vectors")
    walks = g.random_walks(g.neighbors(edges), length=70, num_walks=2)
    assert len(kept("walk-steps") - steps) == 3  # the pieces of steps 30 and 60, and step 65
    assert all(len(r.path) == 72 for r in walks.collect())
    monkeypatch.setattr(skipgram, "ROUNDS", 2)
    made = skipgram.embed_blocks(walks, dim=8, window=3, iterations=3, block=9)
    assert len(kept("vectors") - vectors) == 1 and made.count() == 40
