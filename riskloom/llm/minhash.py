"""MinHash near-duplicates: universal-hash minima, banding, signature checks, exact checks and connected components.

1. One pass over whole texts gives each document its set size, a digest of the set, band keys and a signature. Equal sets are one class.
2. Buckets of equal band keys that hold two classes or more give candidates. First every member meets only the smallest and the largest
   member of its bucket (stars), filtered by signature, confirmed on full sets, and joined into components.
3. Whatever is left inside a bucket between *different* components is compared in blocks of members, again signature first
   and full sets after, and only confirmed links come out. No pair list of a bucket is ever a table, and no pair of
   one bucket is left out, so a link is lost only if none of the bands meets: (1 - s^rows)^bands, 3e-6 at s = 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import exact_ids, written
from riskloom.llm.components import components
from riskloom.llm.shingles import Minima, digest, shared, shingle_set

BLOCK = 2048  # members of a bucket in one block; two blocks meet in one task


def fingerprints(docs: DataFrame, doc_id: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        minima = Minima(bands, rows)
        for batch in batches:
            out = []
            for value in batch["text"]:
                s = shingle_set(value, width)
                if len(s):
                    low = minima.of(s)
                    out.append((len(s), digest(s), minima.keys(low), minima.bytes(low)))
                else:
                    out.append((0, None, None, None))
            made = pd.DataFrame(out, columns=["n", "digest", "bands", "sig"])
            made.insert(0, "id", exact_ids(batch["id"]))
            yield made

    rows_in = docs.select(F.col(f"`{doc_id}`").cast("bigint").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows_in.mapInPandas(run, "id bigint, n bigint, digest binary, bands array<bigint>, sig binary")


def _similar(a: np.ndarray, b: np.ndarray, n_a, n_b, percent: int, slack: float) -> np.ndarray:
    """Signature check: estimated similarity near the threshold and set sizes that allow it."""
    agree = (a == b).mean(-1)
    return ((agree - 1 / 256) * 256 / 255 >= percent / 100 - slack) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))


def _linked(a: bytes, b: bytes, percent: int) -> bool:
    both = shared(a, b)
    return 100 * both >= percent * ((len(a) + len(b)) // 8 - both)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80,
                    bands: int = 32, rows: int = 5, slack: float = 0.18) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Words are runs of non-blank bytes with A-Z lowered. A text with fewer than ``width`` words is one shingle; a null, empty or blank text has none
    and is linked with nothing. ``component_id`` is the smallest id reachable by links, ``kept`` says whether it is the row's own.
    Repeated rows are equal documents. Rows with one id and different texts get the component of their own text. A row with a
    null id is linked with nothing and kept, with a null component. Other columns are not read. An empty table gives an empty result.
    """
    made = written(fingerprints(docs, doc_id, text, width, bands, rows), "fingerprints")
    real = made.where("n > 0 and id is not null")
    first = written(real.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    uniq = real.join(first, (real["digest"] == first["digest"]) & (real["id"] == first["rep"]), "left_semi").dropDuplicates(["id", "digest"])
    keys = uniq.select("id", F.explode("bands").alias("key")).distinct()
    hubs = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("m")).where("m > 1")
    met = written(keys.join(hubs, "key"), "buckets")
    some = met.select("id").distinct()
    marks = written(uniq.join(some, "id", "left_semi").select("id", "n", "bands", "sig"), "signatures")

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "set": [shingle_set(t, width).tobytes() for t in batch["text"]]})

    texts = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    sets = written(texts.join(some, "id", "left_semi").mapInPandas(to_sets, "id bigint, set binary").distinct(), "sets")

    # Stars.
    star = met.select("id", F.explode(F.array("lo", "hi")).alias("hub")).where("id <> hub").select(
        F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    for side in "ab":
        star = star.join(marks.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}")), side)

    def by_signature(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                ok = _similar(_matrix(batch["sig_a"]), _matrix(batch["sig_b"]), batch["n_a"].values, batch["n_b"].values, percent, slack)
                yield batch.loc[ok, ["a", "b"]]

    def by_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = [_linked(x, y, percent) for x, y in zip(batch["set_a"], batch["set_b"])]
            yield batch.loc[ok, ["a", "b"]].rename(columns={"a": "u", "b": "v"})

    star = star.mapInPandas(by_signature, "a bigint, b bigint")
    for side in "ab":
        star = star.join(sets.select(F.col("id").alias(side), F.col("set").alias(f"set_{side}")), side)
    stars = written(components(star.mapInPandas(by_sets, "u bigint, v bigint")), "stars")

    # What is left between components of one bucket.
    with_comp = met.join(stars.withColumnRenamed("node", "id"), "id", "left").select(
        "key", "id", "m", F.coalesce("component", "id").alias("comp"))
    split = with_comp.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    left = with_comp.join(split, "key", "left_semi").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "comp", "own")
    left = left.join(marks, "id")

    def partners(group: pd.DataFrame) -> pd.DataFrame:
        """Pairs of one bucket whose first common band is this one, of two components, that pass the signature check."""
        sig, band = _matrix(group["sig"]), np.array(group["bands"].tolist())
        n, comp, block, ids = group["n"].values, group["comp"].values, group["own"].values, group["id"].values
        one_block = group["i"].iloc[0] == group["j"].iloc[0]
        place = int((band[0] == group["key"].iloc[0]).argmax())
        found = []
        for i in range(len(ids) - 1):
            j = np.arange(i + 1, len(ids))
            j = j[(comp[j] != comp[i]) & (one_block | (block[j] != block[i]))]
            j = j[_similar(sig[i], sig[j], n[i], n[j], percent, slack)] if len(j) else j
            j = j[~(band[j, :place] == band[i, :place]).any(1)] if len(j) and place else j
            if len(j):
                found.append((i, j))
        used = {i for i, _ in found} | {int(x) for _, j in found for x in j}
        lists = {i: ids[j] for i, j in found}
        return pd.DataFrame([(*group[["key", "i", "j"]].iloc[0], ids[i], comp[i], lists.get(i, ids[:0])) for i in sorted(used)],
                            columns=["key", "i", "j", "id", "comp", "partners"])

    def confirm(group: pd.DataFrame) -> pd.DataFrame:
        """Confirmed links between components; components joined on the way are not compared again."""
        held, above = {}, {}
        for key, comp, packed in zip(group["id"], group["comp"], group["set"]):
            held.setdefault(key, (comp, []))[1].append(packed)

        def root(x):
            while above.get(x, x) != x:
                x = above[x]
            return x

        out = []
        for key, lists in zip(group["id"], group["partners"]):
            for other in lists:
                x, y = root(held[key][0]), root(held[other][0])
                if x != y and any(_linked(p, q, percent) for p in held[key][1] for q in held[other][1]):
                    above[max(x, y)] = min(x, y)
                    out.append((held[key][0], held[other][0]))
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    task = ["key", "i", "j"]
    pairs = left.groupBy(*task).applyInPandas(partners, "key bigint, i int, j int, id bigint, comp bigint, partners array<bigint>")
    late = pairs.join(sets, "id").groupBy(*task).applyInPandas(confirm, "u bigint, v bigint")
    second = components(late)

    found = stars.join(second.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select(
        F.col("node").alias("rep"), F.coalesce("top", "component").alias("top"))
    # A class that only the second step has linked is not in ``stars``.
    found = found.unionByName(second.select(F.col("node").alias("rep"), F.col("component").alias("top"))).distinct()
    top = first.join(found, "rep", "left").select("digest", F.coalesce("top", "rep").alias("top"))
    rows_out = made.select("id", "n", "digest").join(top, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("top", "id"))
    return rows_out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                           F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
