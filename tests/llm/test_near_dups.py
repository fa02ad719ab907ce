import random

import numpy as np
import pytest

from riskloom.llm import embeddings, minhash
from riskloom.llm.components import components
from riskloom.llm.embeddings import near_vectors
from riskloom.llm.hnsw import Hnsw, within
from riskloom.llm.minhash import near_duplicates


def reach(nodes, links):
    top = {n: n for n in nodes}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, width):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width):
    sets = {i: shingles(t, width) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in reach(sets, links).items()}


def varied(seed, bases=6, copies=25):
    """Bases with many changed copies, so that copies are often linked to the base but not to each other."""
    draw = random.Random(seed)
    rows = []
    for b in range(bases):
        words = [f"b{b}w{draw.randrange(10 ** 6)}" for _ in range(draw.choice([4, 30, 120]))]
        for _ in range(copies):
            copy = list(words)
            for _ in range(draw.choice([0, 1, 2, 3])):
                copy[draw.randrange(len(copy))] = f"n{draw.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(copy)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [2048, 3])
def test_minhash_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)  # small blocks: pairs of a bucket meet in several tasks
    rows = varied(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(
        spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), width=4).collect()}
    assert got == brute(rows, 4)


def test_minhash_awkward_and_empty(spark, awkward, empty):
    rows = near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    known = {(r.doc_id, t): None for r, t in zip(awkward.collect(), [x.text for x in awkward.collect()])}
    want = brute({i: t for i, t in known if i is not None}.items(), 5)
    for r in rows:
        assert (r.component_id, r.kept) == ((None, True) if r.doc_id is None else (want[r.doc_id][1], want[r.doc_id][1] == r.doc_id))
    assert near_duplicates(empty).collect() == []


def test_components_on_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (200, 199), (199, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*links, (None, 3)], "u bigint, v bigint")).collect()}
    want = reach({x for e in links for x in e}, links)
    assert got == {n: c for n, c in want.items()}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def clustered(seed, n=600, dim=24):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 3 and rows:
            x = rows[draw.integers(len(rows))][1] + draw.normal(0, 0.02, dim)
        else:
            x = draw.normal(0, 1, dim)
        rows.append((i, x))
    return rows


def test_graph_recall():
    x = np.stack([v for _, v in clustered(4, 1500)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Hnsw(x, np.arange(len(x)))
    found, recall = within(graph, x.astype(np.float32), 0.98, 16, np.arange(32), 0.99)[:2]
    truth = x @ x.T >= 0.98
    assert recall >= 0.99 and sum(truth[i, f].sum() for i, f in enumerate(found)) >= 0.99 * truth.sum()
    again = Hnsw.unpack(x, graph.pack())
    assert all((a == b).all() for a, b in zip(graph.links, again.links))


def near(draw, x, size):
    """Unit vectors at a cosine of about 0.99 to ``x``."""
    y = x + draw.normal(0, 0.12 / np.sqrt(x.shape[-1]), (size, x.shape[-1]))
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def unique(draw, n, dim=32):
    x = draw.normal(0, 1, (n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_a_hot_group_does_not_hide_lost_pairs():
    draw = np.random.default_rng(6)
    first = unique(draw, 1000)
    x = np.concatenate([near(draw, unique(draw, 1), 3000), first, near(draw, first, 1000)]).astype(np.float32)
    graph, search = Hnsw(x, np.arange(len(x))), Hnsw.search

    def blind(q, ef):
        """Narrow beams miss the partner in every pair."""
        ids, sims = search(graph, q, ef)
        partner = ef < 256 and (sims >= 0.97) & (ids >= 3000) & (sims < 0.9999)
        return ids, np.where(partner, -2, sims)

    graph.search = blind
    at = draw.permutation(len(x))[:512]
    found, recall = within(graph, x[at], 0.98, 64, np.arange(32), 0.99, own=at)[:2]
    for i, got in zip(at, found):
        want = set(np.flatnonzero(x @ x[i] >= 0.98))
        assert len(want & set(got)) >= 0.99 * len(want) or len(want) == 2 and want == set(got)
    assert recall >= 0.99


@pytest.mark.parametrize("bad", [False, True])
def test_queries_without_neighbours(bad):
    """They are no reason to widen; a graph that misses what is near its own nodes is, whoever asks."""
    draw = np.random.default_rng(7)
    x, q = (np.concatenate([near(draw, centre, 1) for centre in np.repeat(unique(draw, n), 4, 0)[:, None]]).astype(np.float32) for n in (1000, 100))
    graph, search, widths = Hnsw(x, np.arange(len(x))), Hnsw.search, []

    def watched(v, ef):
        widths.append(ef)
        ids, sims = search(graph, v, ef)
        return ids, np.where(bad and ef < 256, -2, sims)

    graph.search = watched
    found, recall = within(graph, q, 0.98, 64, np.arange(32), 0.99)[:2]
    assert len(found) == len(q) and not any(map(len, found)) and recall >= 0.99 and max(widths) == (256 if bad else 64)
    assert len(within(graph, q[:0], 0.98, 64, np.arange(0), 0.99)[0]) == 0


@pytest.mark.parametrize("shard", [16384, 100])
def test_embeddings_against_brute_force(spark, shard):
    rows = [(i, [float(c) for c in v], i % 2) for i, v in clustered(2)]
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 0), (1002, rows[0][1], None), (1003, None, 0), (1004, [0.0] * 24, 0),
             (1005, [float("nan")] * 24, 0), (1006, [None] * 24, 0), (1007, [1.0], 0), (1008, [], 0), (1009, [float("inf")] * 24, 1), (1010, [2.0], 0)]
    df = spark.createDataFrame([(i, v, lab, "x", 9) for i, v, lab in rows], "vec_id bigint, embedding array<double>, label int, kept string, n_links int")
    good = {i: (lab, np.array(v)) for i, v, lab in rows
            if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a in good for b in good if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1])
             and good[a][1] @ good[b][1] / (np.linalg.norm(good[a][1]) * np.linalg.norm(good[b][1])) >= 0.98]
    tops = reach([r[0] for r in rows], links)
    degree = {i: 0 for i in tops}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, shard=shard).collect()}
    assert got == {i: (degree[i], tops[i], tops[i] == i) for i in tops}
    assert near_vectors(df.where("false")).collect() == []


def exact_links(rows, least):
    """(n_links, component) of each row by brute force; rows are (id, vector, label)."""
    n = len(rows)
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    top = list(range(n))
    links = [0] * n

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(n):
        near = np.flatnonzero(x @ x[i] >= least)
        for j in near.tolist():
            if j != i and rows[i][2] == rows[j][2]:
                links[i] += 1
                top[max(root(i), root(j))] = min(root(i), root(j))
    least_id = {}
    for i in range(n):
        least_id[root(i)] = min(least_id.get(root(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], least_id[root(i)]) for i in range(n))


@pytest.mark.parametrize("labels", ["aaaa", "abab", "abaa"])
def test_one_id_with_several_vectors(spark, labels):
    rows = [(i, v, c) for (i, v), c in zip([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.001]), (3, [0.001, 1.0])], labels)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == exact_links(rows, 0.98)


def test_graphs_without_the_small_branch(spark):
    """All links of 5000 vectors of one label over four shards, none of them compared whole at first; the audits say how it went."""
    draw = np.random.default_rng(2)
    base = draw.normal(0, 1, (2200, 24))
    vectors = np.concatenate([base, base[:1600] + draw.normal(0, 0.02, (1600, 24)), base[3] + draw.normal(0, 0.02, (1200, 24))])
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    got, audits = embeddings.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string"), shard=1250, scan_small=False)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == exact_links(rows, 0.98)
    audits = audits.collect()
    assert sum(a.queries for a in audits) == 5000 * len({a.shard for a in audits})
    assert min(a.recall for a in audits) >= 0.99 and sum(a.scanned for a in audits) <= len(audits) // 4
