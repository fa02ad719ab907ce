"""Secret scans with an incremental blob ledger.

Every version of a document is content-addressed by the SHA-256 of its text. The ledger says which (blob, rule version) pairs have
been scanned and what was found; a scan takes each distinct unseen blob once, runs only the rules it has not seen, and joins
findings back to every path that holds the blob. Spans are code points, end exclusive.

All of it is DataFrame work: a text is split at the matches of a rule, and the lengths of pieces and matches add up to the
positions. The running sum is a window over the matches of one blob and rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    pattern: str
    group: int = 0  # the part whose length counts
    least: int = 0  # code points it must have; shorter matches are dropped after matching

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# The three base kinds and their lengths. ``hex`` and ``access`` match whole runs, so the length is in the pattern.
BASE_RULES = (
    Rule("assign", 1, r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
# Added by this operator: public token formats with a fixed prefix.
EXTRA_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hosted", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + EXTRA_RULES
LEDGER = "blob binary, rule string, start bigint, end bigint"
NO_FINDINGS = "cast(array() as array<struct<start:bigint,`order`:int,kind:string,end:bigint>>)"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _long_enough(parts: Column, least: int) -> Column:
    return F.transform(parts, lambda x: F.length(x) >= least)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows of ``blobs`` (blob, text, seen array of rule keys).

    One row per finding, and one with null positions for each pair that was scanned, so a clean blob is not scanned again.
    """
    text, none = F.col("text"), F.expr("cast(array() as array<string>)")
    hits = {r.name: F.when(~F.array_contains("seen", r.key), F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))).otherwise(none)
            for r in rules}
    found = blobs.select("blob", "text", "seen", *[h.alias(f"hit_{name}") for name, h in hits.items()])
    parts = []
    for r in rules:
        some = F.size(f"hit_{r.name}") > 0
        measured = F.transform(f"hit_{r.name}", lambda x: F.length(x))
        kept = _long_enough(F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group)), r.least)
        gaps = F.transform(F.split(text, r.pattern, -1), lambda x: F.length(x))
        parts.append(F.struct(
            F.lit(r.key).alias("rule"), (~F.array_contains("seen", r.key)).alias("new"),
            F.when(some, F.slice(gaps, 1, F.size(measured))).alias("gap"), F.when(some, measured).alias("len"),
            F.when(some, kept).alias("keep")))
    per_rule = found.select("blob", F.explode(F.array(*parts)).alias("r")).where("r.new").select("blob", "r.*")
    rows = per_rule.select("blob", "rule", F.posexplode_outer(F.arrays_zip("gap", "len", "keep")).alias("k", "m"))
    rows = rows.select("blob", "rule", "k", F.col("m.gap").alias("gap"), F.col("m.len").alias("len"), F.col("m.keep").alias("keep"))
    marks = rows.where(F.coalesce("k", F.lit(0)) == 0).select(
        "blob", "rule", F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"))
    upto = Window.partitionBy("blob", "rule").orderBy("k")
    spans = (rows.where("k is not null").withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto))
             .where("keep").select("blob", "rule", (F.col("end") - F.col("len")).cast("bigint").alias("start"),
                                   F.col("end").cast("bigint").alias("end")))
    return marks.unionByName(spans)


def scan_versions(docs: DataFrame, path: str = "doc_id", text: str = "text", ledger: DataFrame | None = None,
                  rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(paths, new ledger rows). ``paths`` has (path column, blob) for every row of ``docs``; repeated rows stay repeated.

    A null text is the empty text. Only pairs of blob and rule version that are not in ``ledger`` are scanned; append the new rows to it.
    Other columns of ``docs`` are not touched. An empty table gives two empty results.
    """
    rows = docs.select(F.col(f"`{path}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text")).withColumn(
        "__blob", blob_of(F.col("__text")))
    paths = rows.select(F.col(f"`{path}`"), F.col("__blob").alias("blob"))
    blobs = rows.groupBy("__blob").agg(F.first("__text").alias("text")).withColumnRenamed("__blob", "blob")
    if ledger is None:
        blobs = blobs.withColumn("seen", F.expr("cast(array() as array<string>)"))
    else:
        done = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(done, "blob", "left").withColumn("seen", F.coalesce("seen", F.expr("cast(array() as array<string>)")))
        blobs = blobs.where(F.size(F.array_except(F.array(*[F.lit(r.key) for r in rules]), F.col("seen"))) > 0)
    return paths, scan_blobs(blobs, rules)


def findings_by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, findings) with the findings of the current rule versions by start, then rule order."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)])
    named = ledger.where(F.col("start").isNotNull() & F.col("rule").isin([r.key for r in rules]))
    item = F.struct("start", order[F.col("rule")].alias("order"), F.substring_index("rule", "@", 1).alias("kind"), "end")
    return named.groupBy("blob").agg(F.sort_array(F.collect_list(item)).alias("findings"))


def findings_on_paths(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``paths`` with ``findings`` (an empty array where there are none)."""
    found = findings_by_blob(ledger, rules)
    return paths.join(found, "blob", "left").withColumn("findings", F.coalesce("findings", F.expr(NO_FINDINGS)))


def redacted(text: Column, findings: Column, mark: str = "[REDACTED]") -> Column:
    """``text`` with every finding replaced by ``mark``; overlapping and nested findings become one mark."""
    state = "struct<at:bigint,parts:array<string>>"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<string>)").alias("parts")).cast(state)

    def step(acc: Column, f: Column) -> Column:
        gap = F.when(f["start"] >= acc["at"], F.concat(
            acc["parts"], F.array(F.substring(text, (acc["at"] + 1).cast("int"), (f["start"] - acc["at"]).cast("int")), F.lit(mark))))
        return F.struct(F.greatest(acc["at"], f["end"]).alias("at"), F.coalesce(gap, acc["parts"]).alias("parts")).cast(state)

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(findings) > 0, F.aggregate(findings, start, step, finish)).otherwise(text)
