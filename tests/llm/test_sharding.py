import bisect
import hashlib
import zlib
from collections import Counter, defaultdict

from riskloom.llm.queries import op1_sharding
from riskloom.llm.sharding import ring_points, shard_rows, walk_ring

FOLDER = "/root/testdata/sf0.001"


def place_one_by_one(keys, shards, nodes):
    """Own keys by ring position first, then overflow keys walk clockwise one step at a time."""
    points = ring_points(shards, nodes)
    ends = [p for p, _ in points]
    room = {s: len(keys) // shards + (s < len(keys) % shards) for s in range(shards)}

    def position(k):
        return int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16)

    homes = defaultdict(list)
    for k in keys:
        homes[bisect.bisect_left(ends, position(k)) % len(points)].append(k)
    placed, over = Counter(), {}
    for arc in range(len(points)):
        shard = points[arc][1]
        stay = min(len(homes[arc]), room[shard] - placed[shard])
        placed[shard] += stay
        over[arc] = len(homes[arc]) - stay
    moved = Counter()
    queue = 0
    for step in range(2 * len(points)):
        arc = step % len(points)
        shard = points[arc][1]
        take = min(queue, room[shard] - placed[shard])
        placed[shard] += take
        moved[shard] += take
        queue -= take
        if step < len(points):
            queue += over[arc]
    return placed, sum(moved.values())


def test_walk_against_one_by_one():
    for n, shards, nodes in ((0, 4, 8), (1, 4, 8), (37, 4, 8), (500, 16, 4), (999, 7, 16)):
        keys = list(range(n))
        points = ring_points(shards, nodes)
        ends = [p for p, _ in points]
        counts = Counter(bisect.bisect_left(ends, int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16)) % len(points) for k in keys)
        runs = walk_ring(dict(counts), points, shards)
        want, moved = place_one_by_one(keys, shards, nodes)
        got = Counter()
        for _, low, high, shard, _ in runs:
            got[shard] += high - low
        assert +got == +want
        assert sum(high - low for arc, low, high, shard, _ in runs if points[arc][1] != shard) <= moved
        slots = sorted((shard, slot + k) for _, low, high, shard, slot in runs for k in range(high - low))
        assert slots == [(s, k) for s in sorted(want) for k in range(want[s])]


def test_query_law(spark):
    rows = op1_sharding(spark, FOLDER).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    by_shard = defaultdict(list)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        by_shard[r.shard].append(r.slot)
    sizes = [len(by_shard[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_awkward_and_empty(spark, awkward, empty):
    out = shard_rows(awkward, "doc_id", 5)
    assert set(out.columns) == set(awkward.columns) | {"slot"}
    rows = out.collect()
    assert len(rows) == awkward.count()
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts[s] for s in range(5)) <= 1
    assert sorted((r.doc_id or -1, r.text or "") for r in rows) == sorted((r.doc_id or -1, r.text or "") for r in awkward.collect())
    assert shard_rows(empty, "doc_id", 5).collect() == []


def test_one_hot_key_is_spread(spark):
    df = spark.createDataFrame([(7,)] * 300 + [(i,) for i in range(100)], "k bigint")
    counts = Counter(r.shard for r in shard_rows(df, "k", 8).collect())
    assert sorted(counts.values()) == [50] * 8
