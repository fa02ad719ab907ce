"""Token-id files with Re-Pair grammar compression.

Documents are put in ascending id order by range partitions; each partition is a shard, written as blocks of about ``BLOCK`` ids. In a
block, frequent pairs of neighbouring symbols are replaced by nonterminals, round after round; pairs never cross a document, so every
document keeps a place of its own in the compressed sequence. A block holds the rules, the expansion length of each symbol
made, the sequence and the table of documents, so one document can be expanded without the others.

Block layout (little-endian): magic ``RPB1``, then eight uint32: base symbol, rounds, rules, symbols, documents, bytes per symbol, ids, 0;
rules per round (uint32), rules (uint32 pairs), expansion lengths (uint32), symbol start of each document and its end (uint32, documents + 1),
the sequence. Blocks are rows of a Parquet table (shard, block, start in shard, document ids, payload), so Spark commits, retries and
prunes them.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.alignment import BYTE_OF
from riskloom.llm.common import exact_ids

BLOCK = 1 << 20
GROUP_CHARS = 1 << 18
RULES_PER_ROUND = 2048
GAIN = 32
RULE_BYTES = 12  # a rule's two symbols and its expansion length
SYMBOLS = 1 << 21  # two symbols and their signs share 64 bits
BINS = 18
WORD = re.compile(r"[^ \t\n\r\f\v]+")
PLAIN = re.compile("[!-~\xa1-\u024f]+")
PLAIN_LINE = re.compile("[ -~\xa1-\u024f]+")
CONTROL = re.compile("[\x1c-\x1f]")


def word_encoder(vocab: dict[str, int], merges: list, special: set[int], suffix: str):
    """The BPE model of a byte-level vocabulary with word ends as an encoder of pieces that end with a zero byte, with the id of a space between them;
    or None if its merges are not in the order of their ids.

    The word end is written as a zero byte. Its pairs come right behind the single bytes in such a vocabulary, so it joins the last byte of
    a word before anything else is merged, as the model wants it; other words with a zero byte are not for this encoder.
    """
    import tiktoken

    def raw(token: str) -> bytes:
        body = token.removesuffix(suffix)
        return bytes(BYTE_OF[c] for c in body) + (b"\0" if len(body) < len(token) else b"")

    ranks = {raw(t): i for t, i in vocab.items() if i not in special}
    made = [vocab[a + b] for a, b in (m.split(" ") if isinstance(m, str) else m for m in merges)]
    ends = [i for t, i in ranks.items() if len(t) == 2 and t[1:] == b"\0"]
    singles = [i for t, i in ranks.items() if len(t) == 1]
    if len(singles) != 256 or len(ends) != 256 or any(x >= y for x, y in zip(made, made[1:])) or max(ends) >= made[0]:
        return None
    encode = tiktoken.Encoding("words", pat_str=r"[^\x00 ]+\x00| ", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return encode, ranks[b" "]


class WordTable:
    """white-space-free word -> its ids as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and none of its steps looks across it (``check_words``), so each distinct word is encoded once: a Python
    worker keeps its table between tasks, and the words of a group of texts that it lacks are encoded together. Two generations of ``most``
    words bound it; words above ``longest`` characters are not kept. A word that was dropped is encoded again, with the same ids.
    """

    most, longest = 400_000, 48

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young, self.old = {}, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.model = spec["model"], None
        special = {t["id"] for t in spec.get("added_tokens", [])}
        split = next((s for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if s["type"] == "Split"), None)
        if split and split.get("invert") and model.get("end_of_word_suffix"):
            self.pieces = regex.compile(f"(?:{split['pattern']['Regex']})| ")
            self.model = word_encoder(model["vocab"], model["merges"], special, model["end_of_word_suffix"])

    def segment(self, words: list[str], table: dict[str, bytes]) -> None:
        """Put the ids of each word into ``table``."""
        # Visible characters below U+0250 are normal already, so lowering is all the normaliser does; one call encodes all such words.
        plain = words if self.model else []
        line = " ".join(plain)
        if not PLAIN_LINE.fullmatch(line) or "<|" in line:
            plain = [w for w in plain if PLAIN.fullmatch(w) and "<|" not in w]
            line = " ".join(plain)
        if plain:
            encode, space = self.model
            # A zero byte behind each piece; the spaces between words stay as they are.
            ids = np.array(encode("\0".join(self.pieces.findall(line.lower())).replace(" \0", " ") + "\0"), "<u4")
            cuts = np.flatnonzero(ids == space)
            packed, starts, ends = ids.tobytes(), (4 * np.append(0, cuts + 1)).tolist(), (4 * np.append(cuts, len(ids))).tolist()
            for word, start, end in zip(plain, starts, ends):
                table[word] = packed[start:end]
        for word in set(words).difference(plain) if len(plain) < len(words) else ():
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            table[word] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        group, chars = [], 0
        for text in texts:
            # str.split() also takes four control characters for white space that the tokenizer does not.
            group.append(WORD.findall(text) if CONTROL.search(text) else text.split())
            chars += len(text)
            if chars >= GROUP_CHARS:
                yield from self._group(group)
                group, chars = [], 0
        yield from self._group(group)

    def _group(self, lists: list[list[str]]) -> Iterator[bytes]:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing: dict[str, None] = {}
        found: list[tuple] = []
        for words in lists:
            ids = list(map(young.get, words))
            try:
                found.append((b"".join(ids), ()))
            except TypeError:  # a word is missing
                holes = [i for i, known in enumerate(ids) if known is None]
                missing.update((words[i], None) for i in holes)
                found.append((ids, holes))
        new = [w for w in missing if w not in old]
        young.update((w, old[w]) for w in missing if w in old)
        self.segment(new, young)
        for words, (ids, holes) in zip(lists, found):
            for i in holes:
                ids[i] = young[words[i]]
            yield b"".join(ids) if holes else ids
        for word in new:
            if len(word) > self.longest:
                del young[word]


def check_words(path: str, base: int) -> None:
    """Raise unless this tokenizer encodes words one by one and all its ids are below ``base``."""
    table, sample = WordTable(path), "A word, another\tWORD's\n\n\u00e9\u00df \u65e5\u672c 12 34.5 -- <b> x"
    if table.tokenizer.encode(sample, add_special_tokens=False).ids != np.frombuffer(next(table.encode([sample])), "<u4").tolist():
        raise ValueError("this tokenizer looks across white space; its texts need whole-text encoding")
    if max(table.tokenizer.get_vocab().values()) >= base or base > SYMBOLS // 2:
        raise ValueError(f"base must be above every id of the tokenizer and at most {SYMBOLS // 2}")


_tables: dict[str, WordTable] = {}


def table_of(path: str) -> WordTable:
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


def compress(ids: np.ndarray, starts: np.ndarray, base: int) -> bytes:
    """One block. ``starts``: first id of each document, and the end; every document has at least one id.

    A rule is made if the symbols it saves weigh more than its own ``RULE_BYTES``. Rounds go on while they pay: until two in a row make the block
    smaller by less than one part in ``GAIN`` (a pair that shares its bin with another one gets a different bin in the next round).
    """
    # Two bytes a symbol while all symbols fit; a grammar is not made larger than that.
    wide, room = (2, 1 << 16) if base < 1 << 16 else (4, SYMBOLS)
    # Two symbols share a word of 32 bits if each takes two bytes, else one of 64.
    kind, half, odd = (np.uint32, 16, 2654435769) if wide == 2 else (np.uint64, 21, 11400714819323198485)
    seq = ids.astype(kind)
    places = starts.astype(np.int64)  # first symbol of each document, and the end
    made, per_round, symbol, turn, idle = [], [], base, 0, 0
    while idle < 2 and len(seq) > 1 and symbol < room:
        turn += 1
        key = (seq[:-1] << kind(half)) | seq[1:]
        slot = ((key * kind(odd + 2 * turn)) >> kind(8 * kind().itemsize - BINS)).astype(np.intp)
        cut = places[1:-1] - 1
        slot[cut] = 1 << BINS  # pairs across documents have a bin of their own, which is not looked at
        owner = np.zeros((1 << BINS) + 1, kind)
        owner[slot] = key  # one pair speaks for a bin; others get another bin in the next round
        match = owner[slot] == key
        match[cut] = False
        count = np.bincount(slot[match], minlength=1 << BINS)
        best = np.flatnonzero(count * wide > RULE_BYTES)
        best = best[np.argsort(-count[best], kind="stable")][:min(RULES_PER_ROUND, room - symbol)]
        rank = np.full((1 << BINS) + 1, len(best), np.int16)
        rank[best] = np.arange(len(best))
        r = rank[slot]
        np.putmask(r, ~match, len(best))
        chosen = r < len(best)
        chosen[1:] &= r[1:] < r[:-1]
        chosen[:-1] &= r[:-1] <= r[1:]
        # A run of one symbol ties with itself; the strict side keeps its leftmost pair, so chosen pairs never overlap.
        take = np.flatnonzero(chosen)
        rule = r[take].astype(np.intp)
        pays = np.bincount(rule, minlength=len(best)) * wide > RULE_BYTES
        paid = pays[rule]
        take, rule, best, number = take[paid], rule[paid], best[pays], np.cumsum(pays) - 1
        idle = idle + 1 if (len(take) * wide - len(best) * RULE_BYTES) * GAIN < len(seq) * wide else 0
        if not len(best):
            continue
        seq[take] = (symbol + number[rule]).astype(kind)
        keep = np.ones(len(seq), bool)
        keep[take + 1] = False
        seq, places = seq[keep], places - np.searchsorted(take + 1, places)
        pair = owner[best].astype(np.int64)
        made.append(np.stack([pair >> half, pair & ((1 << half) - 1)], 1))
        per_round.append(len(best))
        symbol += len(best)
    rules = np.concatenate(made) if made else np.zeros((0, 2), np.int64)
    lengths = np.ones(symbol, np.int64)
    at = base
    for part in made:
        lengths[at:at + len(part)] = lengths[part[:, 0]] + lengths[part[:, 1]]
        at += len(part)
    header = np.array([base, len(per_round), len(rules), len(seq), len(places) - 1, wide, len(ids), 0], "<u4")
    return b"".join([b"RPB1", header.tobytes(), np.array(per_round, "<u4").tobytes(), rules.astype("<u4").tobytes(),
                     lengths[base:].astype("<u4").tobytes(), places.astype("<u4").tobytes(), seq.astype(f"<u{wide}").tobytes()])


class Block:
    """Reads one block; ``document(k)`` expands only that document."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"RPB1":
            raise ValueError("not a token block")
        base, rounds, rules, symbols, docs, wide, self.ids, _ = np.frombuffer(payload, "<u4", 8, 4).tolist()
        at = 36
        per_round = np.frombuffer(payload, "<u4", rounds, at)
        at += 4 * rounds
        self.rules = np.frombuffer(payload, "<u4", 2 * rules, at).reshape(-1, 2).astype(np.int64)
        at += 8 * rules
        self.lengths = np.frombuffer(payload, "<u4", rules, at).astype(np.int64)
        at += 4 * rules
        self.places = np.frombuffer(payload, "<u4", docs + 1, at).astype(np.int64)
        at += 4 * (docs + 1)
        self.sequence = np.frombuffer(payload, f"<u{wide}", symbols, at)
        self.base, self.levels = base, [base + int(x) for x in np.append(0, np.cumsum(per_round))]

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """Undo the rounds from the last to the first."""
        seq, rules = seq.astype("<u4"), self.rules.astype("<u4")
        for low in reversed(self.levels[:-1]):
            at = np.flatnonzero(seq >= low)
            to = at + np.arange(len(at))
            pair = rules[seq[at] - self.base]
            own = np.ones(len(seq) + len(at), bool)
            own[to + 1] = False
            out = np.empty(len(own), "<u4")
            out[own] = seq
            out[to], out[to + 1] = pair[:, 0], pair[:, 1]
            seq = out
        return seq

    def counts(self) -> np.ndarray:
        """Ids of each document, from the expansion lengths alone."""
        seq = self.sequence.astype(np.int64)
        size = np.ones(len(seq), np.int64)
        made = seq >= self.base
        size[made] = self.lengths[seq[made] - self.base]
        total = np.append(0, np.cumsum(size))
        return total[self.places[1:]] - total[self.places[:-1]]

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.sequence[self.places[k]:self.places[k + 1]])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, base: int = 1 << 16, partitions: int | None = None,
          doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every document and write the blocks to ``path``.

    A null text is empty and holds the end id only. Rows with one id are neighbours, ordered by the hash of their text; a null id comes
    first. ``base`` is above every id of the tokenizer. Other columns are not read. An empty table writes no block.
    """
    check_words(tokenizer, base)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, shard, block, before = table_of(tokenizer), TaskContext.get().partitionId(), 0, 0
        keys: list = []
        parts: list[bytes] = []
        held = 0

        def flush() -> pd.DataFrame:
            starts = np.append(0, np.cumsum([len(p) // 4 for p in parts]))
            payload = compress(np.frombuffer(b"".join(parts), "<u4"), starts, base)
            return pd.DataFrame({"shard": [shard], "block": [block], "start": [before], "ids": [held], "keys": [keys], "payload": [payload]})

        for batch in batches:
            for key, packed in zip(batch["key"], words.encode(t or "" for t in batch["text"])):
                packed += end
                keys.append(key)
                parts.append(packed)
                held += len(packed) // 4
                if held >= BLOCK:
                    yield flush()
                    block, before = block + 1, before + held
                    keys, parts, held = [], [], 0
        if parts:
            yield flush()

    rows = docs.selectExpr(f"CAST(`{doc_id}` AS BIGINT) AS key", f"`{text}` AS text")
    number = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    placed = rows.repartitionByRange(number, *order).sortWithinPartitions(*order)
    placed = placed.select(F.col("key").cast("string").alias("key"), "text")
    placed.mapInPandas(run, "shard int, block int, start bigint, ids bigint, keys array<string>, payload binary").write.parquet(path)


def read(spark: SparkSession, path: str, contents: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files at ``path``; with ``contents`` also ``ids``."""
    blocks = spark.read.parquet(path)
    # One row per shard (a partition of the writing job), so this table and its running sum stay small.
    shards = blocks.groupBy("shard").agg(F.sum("ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, start, keys, payload in zip(batch["shard"], batch["start"], batch["keys"], batch["payload"]):
                block = Block(payload)
                counts = block.counts()
                ends = np.cumsum(counts)
                ids = block.expand(block.sequence)
                docs = [ids[e - n:e] for e, n in zip(ends, counts)]
                out = {"shard": shard, "doc_id": exact_ids(keys), "start": start + ends - counts, "n_tokens": counts,
                       "ids_crc32": [zlib.crc32(d.tobytes()) for d in docs]}
                yield pd.DataFrame({**out, "ids": [d.tolist() for d in docs]} if contents else out)

    schema = "shard int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if contents else "")
    rows = blocks.select("shard", "start", "keys", "payload").mapInPandas(run, schema)
    return rows.join(F.broadcast(shards), "shard").select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if contents else []))
