"""Alignment of the tokens of two tokenizers over the bytes of whole texts.

Every token covers a range of bytes. The end offsets that both token lists share cut a text into groups: ``gallop`` finds the shorter list of ends
in the longer one by exponential and then binary search, common ends slice the groups, and differences of their ranks in the two lists are the
token ranges of each group. Tokens that end together are linked.

Two tokens can only be linked if the bytes of one are a suffix of the bytes of the other, because they end at the same byte of the same text. The
pairs of two vocabularies that meet this are listed by ``PairIndex``: each token has at most as many suffixes as bytes, so the list is
bounded by the vocabularies (about half a million pairs for the given ones), whatever the corpus. Corpus-wide counts of linked pairs are
therefore one vector of that length: tasks add up their own, Spark sums them, and the sums may be broadcast.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import written

GROUP_BYTES = 1 << 18
# The word pattern of the byte-level vocabulary, and its bytes that are not visible in Latin-1 and stand at 256 and above.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_OF = {**{chr(b): b for b in _VISIBLE}, **{chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}}


class ByteLevel:
    """A byte-level BPE vocabulary file of the tokenizers library; special tokens in a text are plain text.

    The file's merges are in the order of the ids they make, so a merge's rank is the id; ``tiktoken`` applies such ranks several times faster than
    the library that wrote the file. A file of any other kind is refused.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"] for t in spec.get("added_tokens", [])}
        vocab, step = spec["model"]["vocab"], spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without normalisation is needed")
        self.bytes = {i: bytes(BYTE_OF[c] for c in t) for t, i in vocab.items() if i not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        if any(x >= y for x, y in zip(made, made[1:])):
            raise ValueError("merges are not in the order of their ids")
        self.encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """A SentencePiece model; it puts the space before a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes[i] = bytes([int(re.fullmatch("<0x(..)>", piece)[1], 16)])
            elif not self.model.is_control(i) and not self.model.is_unknown(i):
                self.bytes[i] = piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def table_of(tokens: dict[int, bytes]) -> list[bytes]:
    """Bytes by id; ids without bytes of their own (control pieces) have none, so a text with one never equals its bytes."""
    return [tokens.get(i, b"") for i in range(max(tokens) + 1)]


class PairIndex:
    """Numbers for all (a, b) of which one is a suffix of the other, ascending by (a, b)."""

    def __init__(self, a: dict[int, bytes], b: dict[int, bytes]):
        by_bytes: tuple[dict, dict] = ({}, {})
        for tokens, ids in zip((a, b), by_bytes):
            for i, t in tokens.items():
                ids.setdefault(t, []).append(i)
        keys = set()
        for i, t in a.items():
            for k in range(len(t)):
                keys.update((i << 32) | j for j in by_bytes[1].get(t[k:], ()))
        for j, t in b.items():
            for k in range(len(t)):
                keys.update((i << 32) | j for i in by_bytes[0].get(t[k:], ()))
        self.keys = np.array(sorted(keys), np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, (a << 32) | b).astype(np.int32)

    def __len__(self) -> int:
        return len(self.keys)


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of ``short`` its place in ``long``, or -1. Both ascend strictly.

    All searches run side by side: each starts where its value would stand if ``long`` were even, doubles its step until the value is
    bracketed, and halves the bracket.
    """
    n = len(long)
    if not n or not len(short):
        return np.full(len(short), -1, np.int64)
    spread = (short - long[0]) / max(1, int(long[-1] - long[0]))
    low = np.clip((spread * (n - 1)).astype(np.int64), 0, n - 1)
    high, step = low.copy(), 1
    while len(todo := np.flatnonzero((long[low] > short) & (low > 0))):
        low[todo] = np.maximum(low[todo] - step, 0)
        step *= 2
    step = 1
    while len(todo := np.flatnonzero((long[high] < short) & (high < n - 1))):
        high[todo] = np.minimum(high[todo] + step, n - 1)
        step *= 2
    while len(todo := np.flatnonzero(low < high)):
        mid = (low[todo] + high[todo]) >> 1
        right = long[mid] < short[todo]
        low[todo], high[todo] = np.where(right, mid + 1, low[todo]), np.where(right, high[todo], mid)
    return np.where(long[low] == short, low, -1)


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the values both hold."""
    swap = len(a) > len(b)
    short, long = (b, a) if swap else (a, b)
    at = gallop(short, long)
    hit = np.flatnonzero(at >= 0)
    return (at[hit], hit) if swap else (hit, at[hit])


class Aligner:
    """Aligns texts of one worker; ``pairs`` numbers the linked pairs."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self.a_bytes, self.b_bytes = table_of(a.bytes), table_of(b.bytes)
        self.a_len, self.b_len = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.pairs = PairIndex(a.bytes, b.bytes)
        # The written form of a token is its id with the mark that follows it, by kind: A inside or at the end of its side, B the same.
        na, nb = len(self.a_bytes), len(self.b_bytes)
        self.words = [b"%d%c" % (i, c) for n, inside, last in ((na, 44, 124), (nb, 44, 59)) for c in (inside, last) for i in range(n)]
        self.offset = {"a": (0, na), "b": (2 * na, 2 * na + nb)}

    def align(self, texts: list[str]) -> list[tuple]:
        """Per text (ids of A, ids of B, common places in A, in B, pair numbers); empty where there are no tokens or bytes differ."""
        empty = np.zeros(0, np.int64)
        out: list = [(empty,) * 5] * len(texts)
        todo = [i for i, t in enumerate(texts) if t]
        some = [texts[i] for i in todo]
        lists = []
        for i, t, x, y in zip(todo, some, self.a.encode(some) if some else [], self.b.encode(some) if some else []):
            raw = b" " + t.encode()
            if b"".join(map(self.a_bytes.__getitem__, x)) == raw and b"".join(map(self.b_bytes.__getitem__, y)) == raw:
                lists.append((i, np.array(x, np.int64), np.array(y, np.int64)))
        if not lists:
            return out
        # All texts of the group stand behind each other, so one search serves them all; a text's end is common to both.
        a, b = np.concatenate([x for _, x, _ in lists]), np.concatenate([y for _, _, y in lists])
        at_a, at_b = common_ends(np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b]))
        numbers = self.pairs.find(a[at_a], b[at_b])
        before_a = before_b = done = 0
        for i, x, y in lists:
            end = int(np.searchsorted(at_a, before_a + len(x)))
            out[i] = (x, y, at_a[done:end] - before_a, at_b[done:end] - before_b, numbers[done:end])
            before_a, before_b, done = before_a + len(x), before_b + len(y), end
        return out

    def written(self, x: np.ndarray, y: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the groups in order."""
        if not len(at_a):
            return b""
        la, lb = (np.zeros(len(v), bool) for v in (x, y))
        la[at_a], lb[at_b] = True, True
        ga, gb = np.cumsum(la) - la, np.cumsum(lb) - lb  # group of each token
        n_b, n_a = np.bincount(gb), np.bincount(ga)
        order = np.empty(len(x) + len(y), np.int64)
        order[np.arange(len(x)) + np.append(0, np.cumsum(n_b))[ga]] = x + np.where(la, self.offset["a"][1], self.offset["a"][0])
        order[np.arange(len(y)) + np.cumsum(n_a)[gb]] = y + np.where(lb, self.offset["b"][1], self.offset["b"][0])
        return b"".join(map(self.words.__getitem__, order.tolist()))[:-1]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """One per worker and pair of files, kept between tasks."""
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(ByteLevel(a), Pieces(b))
    return _aligners[a, b]


def _grouped(keys, texts) -> Iterator[tuple[list, list[str]]]:
    """Rows in groups of about ``GROUP_BYTES`` characters."""
    k, t, size = [], [], 0
    for key, text in zip(keys, texts):
        k.append(key)
        t.append(text or "")
        size += len(t[-1])
        if size >= GROUP_BYTES:
            yield k, t
            k, t, size = [], [], 0
    yield k, t


def align(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", contents: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row; with ``contents`` also ``groups``.

    ``a`` is a byte-level vocabulary file, ``b`` a SentencePiece model; every executor must be able to open both. ``n_links`` counts the token
    pairs that end together; a pair's count is the number of its links in all rows; ``n_best`` counts the links whose count is the highest of their
    B id, ties included; ``count_sum`` adds up the counts of the links. A text that is null or empty, or whose tokens do not spell it (a marker
    character in it, for example), has zeros and an empty ``groups_sha256``. Only the two named columns are read; repeated rows are rows of their own
    and count as such; an empty table gives an empty result. Texts are encoded once: pair numbers are kept in a table in the shared folder.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = aligner(a, b)
        totals = np.zeros(len(tool.pairs), np.int64)
        for batch in batches:
            for keys, texts in _grouped(batch["key"], batch["text"]):
                rows, aligned = [], tool.align(texts)
                totals += np.bincount(np.concatenate([r[4] for r in aligned] + [np.zeros(0, np.int64)]), minlength=len(totals))
                for key, (x, y, at_a, at_b, numbers) in zip(keys, aligned):
                    groups = tool.written(x, y, at_a, at_b)
                    row = (key, len(x), len(y), len(at_a), hashlib.sha256(groups).hexdigest() if groups else "", numbers.astype("<u4").tobytes(), None)
                    rows.append((*row, groups.decode()) if contents else row)
                if rows:
                    yield pd.DataFrame(rows, columns=names)
        if len(met := np.flatnonzero(totals)):
            packed = np.stack([met, totals[met]]).astype("<i8").tobytes()
            yield pd.DataFrame([(None, 0, 0, 0, "", b"", packed, *([""] if contents else []))], columns=names)

    names = ["key", "n_a", "n_b", "n_groups", "groups_sha256", "links", "totals"] + (["groups"] if contents else [])
    schema = "key string, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary, totals binary"
    schema += ", groups string" if contents else ""
    read = docs.selectExpr(f"CAST(`{doc_id}` AS STRING) AS key", f"`{text}` AS text")
    rows = written(read.mapInPandas(encode, schema), "token-links")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for packed in batch["totals"]:
                pair, n = np.frombuffer(packed, "<i8").reshape(2, -1)
                yield pd.DataFrame({"pair": pair, "n": n})

    counted = rows.where("totals IS NOT NULL").select("totals").mapInPandas(unpack, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    # One row for each pair of the two vocabularies at most, so this is bounded; so is what is broadcast.
    sums = counted.toPandas()
    spark = docs.sparkSession
    packed = spark.sparkContext.broadcast((sums["pair"].to_numpy(np.int64), sums["n"].to_numpy(np.int64)))

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = aligner(a, b)
        total = np.zeros(len(tool.pairs), np.int64)
        total[packed.value[0]] = packed.value[1]
        b_of = tool.pairs.keys & 0xFFFFFFFF
        highest = np.zeros(len(tool.b_bytes), np.int64)
        np.maximum.at(highest, b_of, total)
        best = total == highest[b_of]
        for batch in batches:
            links = [np.frombuffer(x, "<u4") for x in batch["links"]]
            yield pd.DataFrame({
                "key": batch["key"], **{c: batch[c] for c in ("n_a", "n_b", "n_groups")}, "n_links": [len(x) for x in links],
                "n_best": [int(best[x].sum()) for x in links], "count_sum": [int(total[x].sum()) for x in links],
                "groups_sha256": batch["groups_sha256"], **({"groups": batch["groups"]} if contents else {})})

    out = "key string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    rated = rows.where("totals IS NULL").drop("totals").mapInPandas(rate, out + (", groups string" if contents else ""))
    return rated.select(F.col("key").cast(docs.schema[doc_id].dataType).alias("doc_id"), *rated.columns[1:])
