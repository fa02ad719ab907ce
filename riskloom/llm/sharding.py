"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual_nodes`` points of a ring; a key belongs to the first point at or after its own position. A shard
accepts its own keys up to its capacity; the keys beyond it continue clockwise to the next point whose shard still has room.
Capacities add up to the number of rows and differ by at most one, so counts are at most one apart, and only keys of
overfull shards move from their place on the ring.

Only arc totals (at most ``shards * virtual_nodes`` numbers, a parameter) reach the driver, where the walk over the ring is
done; rows meet the resulting intervals in a broadcast join of that bounded table. Row numbers inside an arc come from
fine hash buckets and offsets, so no arc is ranked in one task.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RING = 1 << 32


def ring_points(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node in ring order."""
    return sorted((int(hashlib.md5(f"shard-{s}/{v}".encode()).hexdigest()[:8], 16), s)
                  for s in range(shards) for v in range(virtual_nodes))


def walk_ring(counts: dict[int, int], points: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) for every run of ranks that goes to one shard.

    ``counts`` has the number of keys by arc (index of ``points``). Own keys come first in ring order, then each
    overflow run goes clockwise, first come first served.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, runs, left = [0] * shards, [], {}
    for arc, (_, shard) in enumerate(points):
        n = counts.get(arc, 0)
        stay = min(n, room[shard] - used[shard])
        if stay:
            runs.append((arc, 0, stay, shard, used[shard]))
            used[shard] += stay
        if n > stay:
            left[arc] = [stay, n]
    waiting: list[list[int]] = []
    for step in range(2 * len(points)):
        arc = step % len(points)
        shard = points[arc][1]
        while waiting and used[shard] < room[shard]:
            run = waiting[0]
            take = min(run[2] - run[1], room[shard] - used[shard])
            runs.append((run[0], run[1], run[1] + take, shard, used[shard]))
            used[shard] += take
            run[1] += take
            if run[1] == run[2]:
                waiting.pop(0)
        if step < len(points) and arc in left:
            waiting.append([arc, *left[arc]])
    return runs


def shard_rows(df: DataFrame, key: str, shards: int = 16, virtual_nodes: int = 128) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (gapless from 0 in each shard).

    Any columns may stand in ``df``; ``shard`` and ``slot`` of the input are replaced. Rows with equal content are
    counted as separate rows and get slots of their own. A null key has one fixed position. An empty table gives an empty result.
    """
    spark, columns = df.sparkSession, [c for c in df.columns if c not in ("shard", "slot")]
    points = ring_points(shards, virtual_nodes)
    # Equal rows are one row with a count until the end, so that copies never gather in one ranking task.
    rows = df.select(*[F.col(f"`{c}`") for c in columns]).groupBy(*[F.col(f"`{c}`") for c in columns]).agg(
        F.count(F.lit(1)).alias("__n"))
    digest = F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\u0000")))
    rows = rows.withColumn("__h", digest)
    position = F.conv(F.substring("__h", 1, 8), 16, 10).cast("bigint")
    # The arc of a position, by a fixed lookup over an even grid and at most a few comparisons.
    rows = rows.withColumn("__p", position)
    ends = [p for p, _ in points]
    grid = 4 * len(points)
    cells = []
    for cell in range(grid):
        low, high = cell * RING // grid, (cell + 1) * RING // grid
        cells.append((cell, bisect.bisect_left(ends, low), [e for e in ends if low <= e < high]))
    lookup = spark.createDataFrame(cells, "__cell int, __first int, __ends array<bigint>")
    rows = rows.withColumn("__cell", F.floor(F.col("__p") * grid / RING).cast("int")).join(F.broadcast(lookup), "__cell")
    arc = (F.col("__first") + F.size(F.filter("__ends", lambda e: e < F.col("__p")))) % len(points)
    rows = rows.withColumn("__arc", arc.cast("int")).drop("__cell", "__first", "__ends")
    # Buckets inside an arc: about as many as rows in a bucket.
    counted = rows.groupBy("__arc").agg(F.sum("__n").alias("n")).collect()
    counts = {r["__arc"]: r["n"] for r in counted}
    fine = max(1, int(max(counts.values(), default=1) ** 0.5))
    rows = rows.withColumn("__sub", (F.conv(F.substring("__h", 9, 8), 16, 10).cast("bigint") * fine / RING).cast("bigint"))
    sub_n = rows.groupBy("__arc", "__sub").agg(F.sum("__n").alias("__m"))
    before = Window.partitionBy("__arc").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sub_n.select("__arc", "__sub", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("__arc", "__sub").orderBy("__h", *[F.col(f"`{c}`") for c in columns]).rowsBetween(
        Window.unboundedPreceding, -1)
    ranked = (rows.withColumn("__r", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
              .join(offsets, ["__arc", "__sub"]).withColumn("__r", F.col("__r") + F.col("__off")))
    runs = spark.createDataFrame(walk_ring(counts, points, shards) or [(0, 0, 0, 0, 0)],
                                 "__arc int, __lo bigint, __hi bigint, shard int, __slot bigint")
    met = ranked.join(F.broadcast(runs), "__arc").where(
        (F.col("__r") < F.col("__hi")) & (F.col("__r") + F.col("__n") > F.col("__lo")))
    first = F.greatest("__r", "__lo")
    last = F.least(F.col("__r") + F.col("__n"), F.col("__hi")) - 1
    met = met.withColumn("__rank", F.explode(F.sequence(first, last)))
    return met.select(*[F.col(f"`{c}`") for c in columns], "shard",
                      (F.col("__slot") + F.col("__rank") - F.col("__lo")).alias("slot"))
