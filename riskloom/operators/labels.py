"""Labelling against a fraud list, sampling and splitting. Choices depend on row ids, so reruns agree."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import hash_bucket
from riskloom.operators.order import union_all
from riskloom.operators.skew import join_unique

BUCKETS = 1_000_000


def select_fraud(txns: DataFrame, fraud: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Transactions on the fraud list, each once."""
    return txns.join(fraud.select(*keys), list(keys), "left_semi")


def select_normal(txns: DataFrame, fraud: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Transactions not on the fraud list."""
    return txns.join(fraud.select(*keys), list(keys), "left_anti")


def semi_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a table of ids, which never visits the driver."""
    return join_unique(df, ids.select(key).distinct(), [key], "left_semi")


def anti_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return join_unique(df, ids.select(key).distinct(), [key], "left_anti")


def related_rows(df: DataFrame, condition: Column, key: str) -> DataFrame:
    """All rows of the keys that have at least one row meeting the condition."""
    return semi_by_ids(df, df.where(condition), key)


def with_dimension(df: DataFrame, dim: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Left join of a dimension with unique keys. Spark broadcasts it if its measured size allows."""
    return df.join(dim, list(keys), "left")


def with_fraud_history(txns: DataFrame, history: DataFrame, id_col: str, ts: str) -> DataFrame:
    """Add the fraud counts of the days before each transaction, from ``windows.entity_fraud_history`` over the same transactions.

    A transaction without an entity or a time has no history and counts 0.
    """
    counts = [c for c in history.columns if c not in (id_col, "_day")]
    joined = join_unique(txns.withColumn("_day", F.unix_date(F.to_date(ts))), history, [id_col, "_day"])
    return joined.fillna(0, subset=counts).drop("_day")


def label_transactions(txns: DataFrame, fraud: DataFrame, keys: Iterable[str], out: str = "label") -> DataFrame:
    """1.0 for transactions on the fraud list, 0.0 for all others."""
    keys = list(keys)
    marks = fraud.select(*keys).distinct().withColumn(out, F.lit(1.0))
    return txns.join(marks, keys, "left").fillna(0.0, subset=[out])


def with_division(df: DataFrame, label: str, is_train: Column, out: str = "division") -> DataFrame:
    """``normal_train``, ``normal_test``, ``fraud_train`` or ``fraud_test``."""
    return df.withColumn(out, F.concat_ws(
        "_", F.when(F.col(label) == 1, "fraud").otherwise("normal"), F.when(is_train, "train").otherwise("test")))


def sample_fraction(df: DataFrame, id_col: str, fraction: float, seed: int = 0) -> DataFrame:
    """About ``fraction`` of the ids, always the same ones for a seed."""
    return df.where(hash_bucket(F.col(id_col), seed, BUCKETS) < round(fraction * BUCKETS))


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` of the distinct ids (all, if fewer): the first in digest order.

    Ids are counted by the first 16 bits of their digest. Whole prefixes are taken as long as they
    fit, and only the one prefix where ``n`` falls is sorted.
    """
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    ids = df.select(id_col).distinct().withColumn("_digest", digest).withColumn("_part", F.substring("_digest", 1, 4))
    # At most 65 536 rows, so one ordered pass over them is safe.
    sizes = ids.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    upto = F.sum("_size").over(Window.partitionBy(F.lit(1)).orderBy("_part"))
    bounds = sizes.select("_part", upto.alias("_upto"), (upto - F.col("_size")).alias("_before"))
    placed = ids.join(F.broadcast(bounds), "_part").where(F.col("_before") < n)
    whole = placed.where(F.col("_upto") <= n).select(id_col)
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_digest", id_col))
    cut = placed.where(F.col("_upto") > n).withColumn("_rank", rank)
    return whole.unionByName(cut.where(F.col("_rank") <= n - F.col("_before")).select(id_col))


def sample_cards(txns: DataFrame, fraud_cards: DataFrame, card: str, txn_id: str, ratio: float, rate_cap: float,
                 seed: int = 0, population: float = 80_000_000) -> DataFrame:
    """All rows of the fraud cards and of ``ratio`` sampled cards per fraud card.

    Candidates are cards with a row in a row sample of rate min(fraud rows / population, cap).
    """
    fraud_rows = fraud_cards.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(card).alias("cards")).first()
    rate = min(fraud_rows["rows"] / population, rate_cap)
    candidates = sample_fraction(txns, txn_id, rate, seed).select(card)
    chosen = sample_n(candidates, card, int(fraud_rows["cards"] * ratio), seed)
    return semi_by_ids(txns, chosen.unionByName(fraud_cards.select(card)), card)


def cap_activity(df: DataFrame, key: str, max_rows: int,
                 counted_in: DataFrame | None = None) -> DataFrame:
    """Drop all rows of keys with ``max_rows`` rows or more, counted in ``counted_in`` (default: the rows given)."""
    source = df if counted_in is None else counted_in
    busy = source.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= max_rows).select(key)
    return join_unique(df, busy, [key], "left_anti")


def drop_confusable(df: DataFrame, key: str, label: str) -> DataFrame:
    """Drop rows labelled 0 of keys that ever had a fraud; all other rows stay, those with another or no label included."""
    normal = F.col(label).eqNullSafe(0)
    fraud = df.where(F.col(label) == 1)
    return anti_by_ids(df.where(normal), fraud, key).unionByName(df.where(~normal))


def rebalance(df: DataFrame, label: str, id_col: str, fractions: Mapping[float, float], seed: int = 0) -> DataFrame:
    """Keep the given fraction of each class; classes not named and rows without a label are kept whole."""
    bucket = hash_bucket(F.col(id_col), seed, BUCKETS)
    keep = F.lit(False)
    for value, fraction in fractions.items():
        keep |= (F.col(label) == value) & (bucket < round(fraction * BUCKETS))
    named = F.coalesce(F.col(label).isin(*fractions), F.lit(False))
    return df.where(F.coalesce(keep, F.lit(False)) | ~named)


def assign_split(df: DataFrame, id_col: str, weights: Iterable[float], seed: int = 0, out: str = "part") -> DataFrame:
    """Part number by the hash of the row id, parts in proportion to the weights."""
    weights = list(weights)
    bucket, edge, total = hash_bucket(F.col(id_col), seed, BUCKETS), 0.0, sum(weights)
    part = None
    for i, w in enumerate(weights[:-1]):
        edge += w
        condition = bucket < round(edge / total * BUCKETS)
        part = F.when(condition, F.lit(i)) if part is None else part.when(condition, F.lit(i))
    last = F.lit(len(weights) - 1)
    return df.withColumn(out, last if part is None else part.otherwise(last))


def split(df: DataFrame, id_col: str, weights: Iterable[float], seed: int = 0) -> list[DataFrame]:
    """The parts of ``assign_split`` as separate frames."""
    weights = list(weights)
    marked = assign_split(df, id_col, weights, seed, "_part")
    return [marked.where(F.col("_part") == i).drop("_part") for i in range(len(weights))]


def day_slice(df: DataFrame, ts: str, day: str) -> DataFrame:
    """Rows of one day, as a range on the column itself so that it reaches the scan."""
    start = F.lit(day).cast("date")
    return df.where((F.col(ts) >= start) & (F.col(ts) < F.date_add(start, 1)))


def fraud_only(label: str, *parts: DataFrame) -> DataFrame:
    """The fraud rows of several labelled sets."""
    return union_all(*[p.where(F.col(label) == 1) for p in parts])
