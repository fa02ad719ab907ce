"""Embedding near-duplicates: HNSW graphs per shard, every shard queried, cosine checked, components joined.

Vectors are compared within a label. Equal vectors are one class with a count. The classes of a label are dealt to shards of about
``SHARD``; each shard gets a graph, and the classes of the label, in blocks, query every graph of it. Beams widen until an audit
against brute force passes. Cosine is confirmed in double precision in the same task. A task reports counts and a
spanning forest of its links, so a large group of near copies never becomes a table of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import exact_ids, written
from riskloom.llm.components import components
from riskloom.llm.hnsw import Hnsw, within

SHARD, QUERIES, AUDIT = 16_384, 1024, 32


def _unit(packed: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(packed, "<f8").reshape(-1, dim)
    return raw, raw / np.linalg.norm(raw, axis=1, keepdims=True)


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98,
                 shard: int = SHARD, recall: float = 0.99, ef: int = 64, seed: int = 3, scan_small: bool = True) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    A vector links with nothing if it or its label is null, it is empty, all zero, or holds a null or non-finite component, or no other vector
    of its label has its length. Repeated rows count as vectors of their own, also where one id has several vectors or labels. Other columns
    are not read. An empty table gives an empty result.
    """
    return search(rows, vec_id, vector, label, least, shard, recall, ef, seed, scan_small)[0]


def search(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, shard: int = SHARD,
           recall: float = 0.99, ef: int = 64, seed: int = 3, scan_small: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows of ``near_vectors``, and one row per searched block: (label, shard, from_shard, block, queries, ef, recall, scanned).

    ``recall`` there is that of the block's audit, ``ef`` the beam width it ended with, ``scanned`` whether the block was compared with the whole
    shard instead. Without ``scan_small`` shards of any size are searched through their graph first.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for v in batch["vector"]:
                x = None if v is None else np.array([np.nan if c is None else c for c in v], "<f8")
                out.append(x.tobytes() if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
            yield pd.DataFrame({"id": exact_ids(batch["id"]), "label": batch["label"], "vector": out})

    read = rows.select(F.col(f"`{vec_id}`").cast("bigint").cast("string").alias("id"), F.col(f"`{label}`").cast("string").alias("label"),
                       F.col(f"`{vector}`").alias("vector"))
    packed = written(read.mapInPandas(pack, "id bigint, label string, vector binary"), "vectors")
    valid = packed.where("label is not null and vector is not null and id is not null")
    # A class is a label and a vector; its number is the node, as one id may have several vectors and labels.
    classes = valid.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumns(
        {"dim": (F.octet_length("vector") / 8).cast("int"), "node": F.monotonically_increasing_id()})
    classes = written(classes, "vector-classes")
    many = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    dealt = classes.join(many, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node"), "shards").cast("int"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rep", "node"], kind="stable")
        group = group.iloc[np.random.default_rng(seed).permutation(len(group))]
        data = b"".join(group["vector"])
        graph = Hnsw(_unit(data, int(group["dim"].iloc[0]))[1], group["node"].values)
        return pd.DataFrame({"label": group["label"].iloc[:1].values, "dim": group["dim"].iloc[:1].values, "shard": group["shard"].iloc[:1].values,
                             "ids": [group["node"].values], "copies": [group["copies"].values], "data": [data], "graph": [graph.pack()]})

    fields = "label string, dim int, shard int, ids array<bigint>, copies array<bigint>, data binary, graph binary"
    # Explicit partition numbers: these rows are few and their work is large, so partitions must not be merged by their size.
    number = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    graphs = written(dealt.repartition(number, "label", "dim", "shard").groupBy("label", "dim", "shard").applyInPandas(build, fields), "graphs")
    # The vectors of a shard query every graph of their label, so a graph travels once for each shard of queries, not for each block.
    queries = graphs.select("label", "dim", F.col("shard").alias("from_shard"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    tasks = graphs.join(queries, ["label", "dim"]).repartition(number, "label", "dim", "shard", "from_shard")

    def query(task: pd.DataFrame) -> pd.DataFrame:
        out, audits = [], []
        for t in task.itertuples():
            raw, unit = _unit(t.data, t.dim)
            q_raw, q_unit = _unit(t.q_data, t.dim)
            ids, q_ids, copies = np.asarray(t.ids), np.asarray(t.q_ids), np.asarray(t.copies)
            graph, same = Hnsw.unpack(unit, t.graph), t.from_shard == t.shard
            norm, q_norm = np.sqrt((raw * raw).sum(1)), np.sqrt((q_raw * q_raw).sum(1))
            # Labels of the nodes of the shard and, behind them, of queries from another shard.
            names = ids if same else np.concatenate([ids, q_ids])
            label, above = np.arange(len(names)), {}

            def root(x, above=above):
                while x in above:
                    x = above[x]
                return x

            for at in range(0, len(q_ids), QUERIES):
                block = q_unit[at:at + QUERIES]
                audit = np.random.default_rng(seed).permutation(len(block))[:AUDIT]
                own = at + np.arange(len(block)) if same else None
                found, got, wide, scanned = within(graph, block.astype(np.float32), least - 1e-4, ef, audit, recall, own=own, scan_small=scan_small)
                audits.append((t.label, t.shard, t.from_shard, at // QUERIES, len(block), wide, got, scanned))
                for k, near in enumerate(found, at):
                    near = near[(raw[near] @ q_raw[k]) / (norm[near] * q_norm[k]) >= least]
                    near = near[ids[near] != q_ids[k]]
                    out.append((int(q_ids[k]), int(copies[near].sum()), None, None))
                    group = np.append(near, (0 if same else len(ids)) + k)
                    tops = {root(x) for x in np.unique(label[group]).tolist()}
                    first = min(tops)
                    above.update({x: first for x in tops if x != first})
                    label[group] = first
            for x, y in enumerate(label.tolist()):
                if (top := root(y)) != x:
                    out.append((None, None, int(names[x]), int(names[top])))
        links = pd.DataFrame(out, columns=["node", "n", "u", "v"]).astype("Int64")
        names = ["label", "shard", "from_shard", "block", "queries", "ef", "recall", "scanned"]
        return pd.concat([links, pd.DataFrame(audits, columns=names)]).astype({c: "Int64" for c in names[1:6]})

    schema = ("node bigint, n bigint, u bigint, v bigint, label string, shard int, from_shard int, block int, queries int, ef int, recall double, "
              "scanned boolean")
    answers = written(tasks.groupBy("label", "dim", "shard", "from_shard").applyInPandas(query, schema), "vector-links")
    linked = answers.where("node is not null").groupBy("node").agg(F.sum("n").alias("n"))
    top = components(answers.where("u is not null").select("u", "v"))
    joined = classes.join(top, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = joined.groupBy("component").agg(F.min("rep").alias("smallest"))
    per_class = joined.join(smallest, "component").join(linked, "node", "left").select(
        F.col("label").alias("c_label"), F.col("vector").alias("c_vector"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "smallest")
    met = packed.join(per_class, (F.col("label") == F.col("c_label")) & (F.col("vector") == F.col("c_vector"))
                      & F.col("id").isNotNull(), "left")
    component = F.coalesce("smallest", "id")
    result = met.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
    audits = answers.where("queries is not null").select("label", "shard", "from_shard", "block", "queries", "ef", "recall", "scanned")
    return result, audits
