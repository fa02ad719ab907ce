"""The registered queries of this subpackage and their SQL twins. Each reads whole tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (alignment, collocations, embeddings, html_text, minhash, mixing, pieces, quality, secret_scan, sharding, token_files,
                          toxicity, warc)
from riskloom.llm.common import shared_path, table, words_of, written
from riskloom.llm.twins import TWINS


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards by the bounded ring; row counts are at most one apart, so the law is ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.shard_rows(written(rows, "shard-rows"), "doc_id", 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op2_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """A first scan of all documents (nothing is in the ledger yet) and its findings on every document."""
    paths, ledger = secret_scan.scan_versions(table(spark, folder, "documents"))
    rows = secret_scan.findings_on_paths(paths, ledger)

    def count(kind: str):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def digest(found):
        return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    base = F.filter("findings", lambda f: f["kind"].isin([r.name for r in secret_scan.BASE_RULES]))
    return rows.select("doc_id", count("assign"), count("access"), count("hex"),
                       F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(F.col("findings")).alias("spans"))


def op3_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents over four-word shingles at a similarity of 0.8."""
    return minhash.near_duplicates(table(spark, folder, "documents"), width=4, percent=80)


def op4_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings compared within their label at a cosine of 0.98 through the graphs of every shard."""
    return embeddings.near_vectors(table(spark, folder, "embeddings"), least=0.98)


def tokenizer_path(name: str) -> str:
    """The installed vocabulary file; the operators themselves take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded with begin and end ids, and decoded again."""
    return pieces.encode_decode(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1 of their sources, none above three times its source's size."""
    rows = table(spark, folder, "documents").select("doc_id", "source", F.size(words_of(F.col("text"))).cast("bigint").alias("size"))
    return mixing.mix(written(rows, "mix-sizes")).select("doc_id", "size", "source_size", "target", "taken")


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document written to grammar-compressed token files in id order and read back from them."""
    path = shared_path(spark, "token-files")
    token_files.write(table(spark, folder, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2, base=49_408)
    return token_files.read(spark, path)


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Expected severity of every document under a model of the labelled sample."""
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", "severity", "grade", "toxic")


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page, with token weights counted on pages that mark their content."""
    pages = table(spark, folder, "pages")
    return html_text.extract(pages.select("page_id", "url", "html"), html_text.fit_weights(pages))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts, the base verdict and the verdict of the rule table for every document."""
    rows = quality.judge(quality.measure(table(spark, folder, "documents").select("doc_id", "text")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 strongest phrases of each language of all documents."""
    return collocations.top_phrases(table(spark, folder, "documents"), least=30, top=2000)


def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to WARC archives and its record read back from them."""
    path = shared_path(spark, "warc")
    warc.write(table(spark, folder, "pages"), path)
    return warc.read(spark, path, contents=False).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document under two tokenizers, aligned over its bytes."""
    return alignment.align(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_sharding, op2_secret_scans, op3_minhash, op4_embeddings, op5_sentencepiece, op6_mixing, op7_token_files, op8_toxicity,
        op9_html_extraction, op10_quality_rules, op11_collocations, op12_warc, op13_alignment)}
ORACLES = {k: v for k, v in TWINS.items() if k in QUERIES}
