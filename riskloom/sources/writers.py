"""Sinks and fitted-model storage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, single: bool = False) -> None:
    """Headered CSV, overwriting. ``single`` is for small reports: it writes one file from one task."""
    (df.coalesce(1) if single else df).write.csv(path, header=True, mode="overwrite")


def write_reports_by(df: DataFrame, col: str, path: str) -> None:
    """One report folder per value of ``col``, in one job."""
    df.write.partitionBy(col).csv(path, header=True, mode="overwrite")


def write_stage(df: DataFrame, path: str, partition_by: Iterable[str] = (), sep: str | None = None) -> None:
    """A stage for the next job: Parquet, or with ``sep`` delimited text for export."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if sep is None:
        writer.parquet(path)
    else:
        writer.csv(path, sep=sep)


def write_table(df: DataFrame, name: str, bucket_by: str | Iterable[str] | None = None, buckets: int = 0) -> None:
    """Managed table, optionally bucketed and sorted by the keys that later joins, groupings and windows use.

    Two tables with the same keys and number of buckets join without an exchange; so do groupings and windows by those keys, or by those
    and more. Rows go to their buckets in one shuffle, so each bucket is one file.
    """
    keys = [bucket_by] if isinstance(bucket_by, str) else list(bucket_by or ())
    if not keys:
        df.write.mode("overwrite").saveAsTable(name)
        return
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def save_walks(walks: DataFrame, path: str) -> None:
    """One tab-joined path per line."""
    walks.select(F.array_join(F.transform("path", lambda n: n.cast("string")), "\t").alias("value")).write.mode(
        "overwrite").text(path)


def save_embedding(vectors: DataFrame, path: str) -> None:
    """``name<TAB>v1,v2,...`` per node, from (name, vector)."""
    from pyspark.ml.functions import vector_to_array

    numbers = F.array_join(F.transform(vector_to_array("vector"), lambda v: v.cast("string")), ",")
    vectors.select(F.concat_ws("\t", F.col("name").cast("string"), numbers).alias("value")).write.mode("overwrite").text(path)
