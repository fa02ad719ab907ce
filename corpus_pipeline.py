"""The corpus pipeline: each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame.

All stages but the last return the columns of ``documents``. A caller may write the rows between stages; ``run`` does so too, in the shared
checkpoint folder, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import minhash, mixing, pieces, secret_scan, toxicity
from riskloom.llm.common import table, words_of, written
from riskloom.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go; all others stay as they are."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where("NOT toxic").select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key``: one number for each id and text, in the order of the ids and, within one, of the hashes of the texts."""
    docs = docs.withColumn("t", F.xxhash64("text"))
    keys = docs.select("doc_id", "t").distinct().orderBy("doc_id", "t").withColumn("key", F.monotonically_increasing_id())
    return written(docs.join(written(keys, "keys"), ["doc_id", "t"]).drop("t"), "keyed")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group (five-word shingles, similarity 0.8) stays.

    Repeated rows of one id and text are one document and stay once, with the smallest language, source and length. Rows of one id with
    different texts are documents of their own; in one group, the one with the smaller hash stays. A row with a null id is in no group and stays.
    """
    docs = docs.select(*COLUMNS)
    rows, key = docs.where("doc_id IS NOT NULL"), "doc_id"
    texts = rows.select("doc_id", F.xxhash64("text").alias("t")).groupBy("doc_id").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    # An id with several texts does not tell its documents apart; numbering all costs a written copy of the rows.
    if not texts.where("low <> high").isEmpty():
        rows, key = numbered(rows), "key"
    unique = rows.groupBy(F.col(key).alias("key")).agg(F.min(F.struct("doc_id", "lang", "source", "n_chars")).alias("s"), F.first("text").alias("text"))
    gone = minhash.near_duplicates(rows, key).where("NOT kept").select(F.col("doc_id").alias("key")).distinct()
    left = unique.join(gone, "key", "left_anti").select("s.*", "text").select(*COLUMNS)
    return left.unionByName(docs.where("doc_id IS NULL"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found becomes a mark; documents without one keep their text. ``n_chars`` follows the text."""
    docs = docs.select(*COLUMNS)
    _, ledger = secret_scan.scan_versions(docs)
    found = secret_scan.findings_by_blob(ledger).withColumnRenamed("blob", "found_blob")
    rows = docs.withColumn("blob", secret_scan.blob_of(F.col("text"))).join(found, F.col("blob") == F.col("found_blob"), "left")
    clean = secret_scan.redacted(F.col("text"), F.coalesce("findings", F.expr(secret_scan.NO_FINDINGS)))
    chars = F.when(F.col("findings").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return rows.withColumn("text", clean).withColumn("n_chars", chars).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once, or repeated up to three times."""
    # Equal rows are documents of their own, so rows go by a stored number.
    docs = written(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    sizes = written(docs.select("row", "doc_id", "source", F.size(words_of(F.col("text"))).cast("bigint").alias("size")), "mix-sizes")
    rows = docs.join(mixing.mix(sizes).where("times > 0").select("row", "times"), "row")
    return rows.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row with begin and end ids, checked by decoding; one row per row of ``docs``."""
    return pieces.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("toxicity", reject_toxic), ("minhash near-dedup", drop_near_duplicates), ("secret scan", redact_secrets),
          ("mixing", mix_sources), ("sentencepiece", encode)]

# A fitted model and a tokenizer take part, so SQL cannot express the rows of run(); tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
