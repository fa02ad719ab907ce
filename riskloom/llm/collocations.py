"""Phrase collocation mining over a weighted de Bruijn graph.

Nodes are word sequences of three, edges the sequences of four words that join two overlapping nodes; an edge weighs as many as it has occurrences
within pieces. At the last three positions of a piece no edge starts; what starts there (three, two or one words up to the end of the
piece) is the piece-end correction. So each word of the corpus starts exactly one *longest gram*, and nothing but these is counted:

    f(phrase) = flow of all edges that begin with it + all piece ends that begin with it.

Counting is one shuffle: a task counts the longest grams of its texts and sends them as sorted, compressed runs, one for each bucket of the first two
words; a bucket adds up its runs in order, so all grams with one beginning are neighbours and their flows are running sums. Where the whole
flow of a node goes on along one edge, the node lies on a unary path; the path is stored once, as its longest gram and the number of
words from which the flow is the same. Flows below the threshold never leave a bucket. The flow of single words is summed over buckets.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import written

ORDER = 4
HELD = 600_000  # distinct grams a task holds before it sends them
BUCKET_CHARS = 6 << 20  # characters of text for which there is one bucket
SALTS = 64
_ENDS, _BLANK = b".,;:!?\n\v\f\r", b" \t"
LOW = re.compile(b"[\0-\x1f]")
SPACE_FIRST = bytes(0 if b == 32 else b + 1 if b < 32 else b for b in range(256))
# One pass over the bytes: A-Z become a-z, piece ends become line feeds, tabs become spaces.
FOLD = bytes(10 if b in _ENDS else 32 if b in _BLANK else b + 32 if 65 <= b <= 90 else b for b in range(256))


def longest_grams(text: str) -> Iterator[bytes]:
    """The longest gram that starts at each word: ``ORDER`` words, or those up to the end of its piece."""
    for piece in text.encode("utf-8", "surrogatepass").translate(FOLD).split(b"\n"):
        words = piece.split()
        yield from map(b" ".join, zip(*(islice(words, k, None) for k in range(ORDER))))
        for k in range(min(ORDER - 1, len(words)), 0, -1):
            yield b" ".join(words[-k:])


def runs_of(lang: str, counts: Counter, buckets: int) -> list[tuple]:
    """(lang, bucket, grams, counts) of one task: for each bucket a sorted, compressed run."""
    press = zstandard.ZstdCompressor(level=1).compress
    parts: dict[int, list[bytes]] = {}
    more, add = b"\n", None  # no gram has a line feed
    for gram in sorted(counts):
        if not gram.startswith(more):
            words = gram.split(b" ", 2)[:2]
            first = b" ".join(words)
            more, add = first + b" " if len(words) > 1 else b"\n", parts.setdefault(zlib.crc32(first) % buckets, []).append
        add(gram)
    return [(lang, b, press(b"\n".join(grams)), press(np.array([counts[g] for g in grams], "<u8").tobytes()))
            for b, grams in parts.items()]


def flows(grams: list[bytes], counts: list[int], least: int) -> tuple[list[tuple], dict[bytes, int]]:
    """Unary paths (gram, flow, words from which it holds) of at least ``least``, for grams in ``ordered``; and the flow of first words.

    All grams that begin with the same two words are there. Where those two words flow less than ``least``, so does everything behind them.
    """
    paths: list[tuple] = []
    first_words: dict[bytes, int] = {}
    words, more, at, flow = [], b"\n", 0, 0
    for k, (gram, n) in enumerate(zip(grams, counts)):
        if not gram.startswith(more):
            if words:
                first_words[words[0]] = first_words.get(words[0], 0) + flow
                if flow >= least:
                    _unary(grams[at:k], counts[at:k], least, paths)
            words = gram.split(b" ", 2)[:2]
            more, at, flow = b" ".join(words) + b" " if len(words) > 1 else b"\n", k, 0
        flow += n
    if words:
        first_words[words[0]] = first_words.get(words[0], 0) + flow
        if flow >= least:
            _unary(grams[at:], counts[at:], least, paths)
    return paths, first_words


def ordered(grams: dict[bytes, int]) -> list[bytes]:
    """Grams in the order of their words, so those that begin with the same words are neighbours: the space counts as the lowest byte."""
    if LOW.search(b"".join(grams)):
        return sorted(grams, key=lambda g: g.translate(SPACE_FIRST))
    return sorted(grams)


def _unary(grams: list[bytes], counts: list[int], least: int, paths: list[tuple]) -> None:
    """Add the paths of grams that share their first two words; a gram of one word is only a piece end and has no path."""
    # open nodes of two and three words: [words, flow, flow of the heaviest way out, path of that way]
    stack: list[list] = []

    def leave(node: list, flow: int, path: tuple) -> None:
        """One way out may carry the whole flow of its node; the others are paths of their own."""
        if node[3] is None:
            node[2], node[3] = flow, path
        elif node[2] < flow:
            paths.append(node[3])
            node[2], node[3] = flow, path
        else:
            paths.append(path)

    def close(depth: int) -> None:
        while len(stack) > depth:
            words, flow, top, path = stack.pop()
            size = len(stack) + 2
            if stack:
                stack[-1][1] += flow
            if flow < least:
                continue
            if path is not None and top < flow:
                paths.append(path)
            whole = (path[0], flow, size) if path is not None and top == flow else (words, flow, size)
            if stack:
                leave(stack[-1], flow, whole)
            else:
                paths.append(whole)

    for gram, n in zip(grams, counts):
        words = gram.split(b" ")
        if len(words) < 2:
            continue
        deep = [b" ".join(words[:k]) for k in range(2, min(len(words), ORDER - 1) + 1)]
        shared = 0
        while shared < min(len(stack), len(deep)) and stack[shared][0] == deep[shared]:
            shared += 1
        close(shared)
        stack += [[w, 0, 0, None] for w in deep[shared:]]
        stack[-1][1] += n  # an edge flows through its node; a piece end stays in the node it spells
        if len(words) == ORDER and n >= least:
            leave(stack[-1], n, (gram, n, ORDER))
    close(0)


def phrase_counts(docs: DataFrame, least: int = 30, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, phrase, words, f) of every phrase of one to ``ORDER`` words with f >= ``least``, and (lang, null, 0, n) with all words of a language.

    A null language is ``und``; a null or blank text has no words. Only the two columns are read; repeated rows count as often as they occur;
    an empty table gives an empty result.
    """
    read = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    chars = read.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(8, -(-chars // BUCKET_CHARS))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}

        def flush() -> pd.DataFrame:
            rows = [r for code, counts in held.items() for r in runs_of(code, counts, buckets)]
            held.clear()
            return pd.DataFrame(rows, columns=["lang", "bucket", "grams", "counts"])

        for batch in batches:
            for code, body in zip(batch["lang"], batch["text"]):
                counts = held.get(code)
                if counts is None:
                    counts = held[code] = Counter()
                counts.update(longest_grams(body))
                if len(counts) > HELD or len(held) > 1 and sum(map(len, held.values())) > HELD:
                    yield flush()
        if held:
            yield flush()

    def add_up(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total: dict[bytes, int] = {}
        expand = zstandard.ZstdDecompressor().decompress
        for grams, counts in zip(group["grams"], group["counts"]):
            n = np.frombuffer(expand(counts), "<u8").tolist()
            for gram, k in zip(expand(grams).split(b"\n"), n):
                total[gram] = total.get(gram, 0) + k
        order = ordered(total)
        paths, words = flows(order, [total[g] for g in order], least)
        rows = [(key[0], gram.decode("utf-8", "replace"), n, low) for gram, n, low in paths]
        rows += [(key[0], word.decode("utf-8", "replace"), n, 0) for word, n in words.items()]
        return pd.DataFrame(rows, columns=["lang", "gram", "n", "low"])

    runs = read.mapInPandas(count, "lang string, bucket int, grams binary, counts binary")
    # As many partitions as buckets: the runs are small but their work is not, so partitions must not be merged by their size.
    dealt = runs.repartition(int(buckets), "lang", "bucket")
    paths = written(dealt.groupBy("lang", "bucket").applyInPandas(add_up, "lang string, gram string, n bigint, low int"), "gram-paths")
    singles = paths.where("low = 0").groupBy("lang", F.col("gram").alias("phrase")).agg(F.sum("n").alias("f"))
    words = F.split("gram", " ")
    longer = paths.where("low > 0").withColumn("words", F.explode(F.sequence(F.col("low"), F.size(words)))).select(
        "lang", F.array_join(F.slice(words, F.lit(1), F.col("words")), " ").alias("phrase"), "words", F.col("n").alias("f"))
    total = singles.groupBy("lang").agg(F.sum("f").alias("f"))
    return longer.unionByName(singles.where(F.col("f") >= least).withColumn("words", F.lit(1))).unionByName(
        total.select("lang", F.lit(None).cast("string").alias("phrase"), F.lit(0).alias("words"), "f"))


def top_phrases(docs: DataFrame, least: int = 30, top: int = 2000, percent: int = 80, scale: int = 2_000_000, lang: str = "lang",
                text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two words and more of each language.

    score is the smallest floor(scale * a / (l + r)) over the cuts of a phrase, the first such cut giving l and r; a phrase within a longer one that
    occurs at least ``percent`` of its times is left out. Products are decimals, so they are exact beyond 64 bits. Ties go by the bytes of
    the phrase, so each rank is taken once.
    """
    counts = written(phrase_counts(docs, least, lang, text), "phrase-counts")
    flow = counts.where("words > 0").select(F.col("lang").alias("g_lang"), F.col("phrase").alias("g_phrase"), F.col("f").alias("g"))
    many = counts.where("words > 1").select("lang", "phrase", F.split("phrase", " ").alias("ws"), F.col("f").alias("a"))

    def flow_of(rows: DataFrame, part: str, name: str) -> DataFrame:
        return rows.join(flow, (F.col("lang") == F.col("g_lang")) & (F.col(part) == F.col("g_phrase"))).withColumnRenamed("g", name).drop(
            "g_lang", "g_phrase")

    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ws") - 1))).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("ws", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("ws", F.col("k") + 1, F.size("ws") - F.col("k")), " ").alias("right"))
    cuts = flow_of(flow_of(cuts, "left", "l"), "right", "r")
    score = F.expr(f"CAST({scale} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) + r)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    # Of the longer candidates around a phrase the most frequent one decides.
    inner = many.where(F.size("ws") > 2).withColumn("size", F.explode(F.sequence(F.lit(2), F.size("ws") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("size") + 1))).groupBy(
        F.col("lang").alias("i_lang"), F.array_join(F.slice("ws", F.col("at"), F.col("size")), " ").alias("i_phrase")).agg(F.max("a").alias("around"))
    kept = scored.join(inner, (F.col("lang") == F.col("i_lang")) & (F.col("phrase") == F.col("i_phrase")), "left").where(
        F.col("around").isNull() | (F.col("around").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * percent))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    kept = kept.select("lang", "phrase", "a", "s.l", "s.r", "s.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    # One language may hold most phrases: the best of each part of it first, so the last ranking sees SALTS * top rows at most.
    best = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
