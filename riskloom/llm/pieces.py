"""SentencePiece encoding and decoding through a table of distinct chunks.

In the given model no piece holds a white-space marker after another character, and none holds a line feed, so no merge
crosses the start of a marked word or a line feed. A text therefore falls into chunks (a run of markers with the word after it, or one
line feed) that are segmented independently. ``ChunkTable`` segments each distinct chunk once in a worker and the ids are joined
back by position. ``check_model`` verifies the property, so another model cannot give wrong ids silently. A table of the whole
corpus would have to shuffle every word of it by position; a worker's table needs no shuffle.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.distinct import DistinctTable

MARK = "▁"
CHUNK = re.compile(f"\n|[ {MARK}]*[^ {MARK}\n]+|[ {MARK}]+")


def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_model(path: str) -> None:
    """Raise unless chunks of this model are independent."""
    sp = load(path)
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if re.search(f"[^{MARK}]{MARK}|\n| ", piece):
            raise ValueError(f"piece {piece!r} crosses a chunk; this model needs whole-text segmentation")
    if sp.encode("a b  c\n d") != [i for ids in ChunkTable(sp).ids(CHUNK.findall(" a b  c\n d")) for i in ids]:
        raise ValueError("this model changes white space; it needs whole-text segmentation")


class ChunkTable(DistinctTable):
    """chunk -> its ids as little-endian unsigned 32-bit integers; ``encode_texts`` adds begin and end ids."""

    def __init__(self, sp):
        self.sp = sp
        self.mark = sp.piece_to_id(MARK)
        # The library puts a marker before every text; a chunk without one is encoded behind a line feed.
        self.lead = len(sp.encode("\n"))
        super().__init__(lambda text: CHUNK.findall(" " + text) if text else [], self.pack)

    def ids(self, chunks: list[str]) -> Iterator[list[int]]:
        marked = [c[0] in (" ", MARK) for c in chunks]
        found = self.sp.encode([c[1:] if m else "\n" + c for c, m in zip(chunks, marked)], num_threads=1) if chunks else []
        for chunk, m, ids in zip(chunks, marked, found):
            yield ids[self.lead:] if not m else ids if len(chunk) > 1 else [self.mark]

    def pack(self, chunks: list[str]) -> Iterator[bytes]:
        return (struct.pack(f"<{len(ids)}I", *ids) for ids in self.ids(chunks))

    def encode_texts(self, texts: Iterable[str]) -> Iterator[bytes]:
        begin, end = (struct.pack("<I", i) for i in (self.sp.bos_id(), self.sp.eos_id()))
        return (begin + inner + end for inner in self.encode(texts))


def encode_decode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", contents: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; with ``contents`` also ``ids`` and ``decoded``.

    A null text is the empty text. Only the two named columns are read; repeated rows stay repeated; an empty table gives an
    empty result. ``model`` must be a path that every executor can open.
    """
    check_model(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp = load(model)
        chunks = ChunkTable(sp)
        for batch in batches:
            rows = []
            for key, packed in zip(batch["key"], chunks.encode_texts(t or "" for t in batch["text"])):
                ids = memoryview(packed).cast("I").tolist()
                decoded = sp.decode(ids)
                row = (key, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append((*row, ids, decoded) if contents else row)
            yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if contents else [])
    schema = f"doc_id string, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<bigint>, decoded string" if contents else ""
    out = docs.selectExpr(f"CAST(`{doc_id}` AS STRING) AS key", f"`{text}` AS text").mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))
