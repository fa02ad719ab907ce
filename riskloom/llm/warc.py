"""WARC archives through a chunked record table.

``write`` turns pages into records, ``read`` turns archives into rows of (record identifier, chunk number). On both ways a payload travels as
chunks of at most ``CHUNK`` bytes and its digest is carried from chunk to chunk, so no task holds a whole record beyond the cell it was given.

Archives are ordinary ``.warc.gz`` files: one gzip member for each record, WARC/1.1, ``response`` records with an HTTP block and ``revisit`` records
of the identical-payload-digest profile with the HTTP header only. Each task attempt writes files of its own name; the manifest, a Parquet
table that Spark commits, names those of the attempts that succeeded. A lost or repeated attempt leaves files that no manifest names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import exact_ids

CHUNK = 1 << 20
ROLL = 1 << 30  # bytes after which a task opens its next file
LEAST = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time; a fixed one keeps reruns equal
END = b"\r\n\r\n"


def record_id(page_id: str | None, url: str | None, digest: str, copy: int) -> str:
    """A name that only depends on the page, so reruns agree."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((page_id, url, digest, copy)))}>"


def plan(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """One row per page: (page_id, url, payload, payload_bytes, payload_digest, copies, shared, first, refers_to, refers_url).

    Of the records with equal payloads of at least ``least`` bytes, one with the largest page id (a null id is the smallest, then the
    largest url) is the response, all others revisit it. Rows that agree in id, url and payload are ``copies`` of one row; only one copy can be the
    response. The choice is made on digests alone; payloads are shuffled once, by page.
    """
    payload = F.encode(F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{page_id}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload"))
    # The digest has a fixed length and an id no letters, so the name tells id, url and digest apart, nulls included.
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("name", F.concat(
        "payload_digest", F.coalesce(F.col("page_id").cast("string"), F.lit("n")), F.coalesce(F.concat(F.lit("u"), "url"), F.lit("n"))))
    keyed = rows.select("page_id", "url", "name", "payload_digest", F.octet_length("payload").cast("bigint").alias("payload_bytes"))
    large = keyed.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct(F.col("page_id").isNotNull(), "page_id", F.col("url").isNotNull(), "url")).alias("top"))
    # Payloads that occur once need no look-up; the digests of the others are joined to small rows, and those to the payloads by name.
    again = large.where("n > 1").select("payload_digest", F.col("top.page_id").alias("refers_to"), F.col("top.url").alias("refers_url"))
    named = keyed.select("name", "payload_digest").distinct().join(again, "payload_digest").drop("payload_digest")
    whole = rows.groupBy("name").agg(*[F.first(c).alias(c) for c in ("page_id", "url", "payload", "payload_digest")], F.count(F.lit(1)).alias("copies"))
    met = whole.join(named.withColumn("again", F.lit(True)), "name", "left")
    shared = F.coalesce("again", F.lit(False))
    own = F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("url").eqNullSafe(F.col("refers_url"))
    return met.select("page_id", "url", "payload", F.octet_length("payload").cast("bigint").alias("payload_bytes"), "payload_digest", "copies",
                      shared.alias("shared"), (shared & own).alias("first"), "refers_to", "refers_url")


def chunked(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk table of planned records: (page_id, url, ..., copy, type, chunk, chunks, data), chunks of a record in order.

    A revisit is one row without data. The rows of a record are neighbours in one partition.
    """
    copies = records.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
    revisit = F.col("shared") & ~(F.col("first") & (F.col("copy") == 0))
    copies = copies.withColumn("type", F.when(revisit, "revisit").otherwise("response"))
    chunks = F.when(F.col("type") == "revisit", 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / size)).cast("int"))
    rows = copies.withColumn("chunks", chunks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    data = F.when(F.col("type") == "revisit", F.lit(b"")).otherwise(F.substring("payload", F.col("chunk") * size + 1, F.lit(size)))
    return rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload_bytes", "payload_digest", "copy", "type",
                       F.col("refers_to").cast("string").alias("refers_to"), "refers_url", "chunk", "chunks", data.alias("data"))


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _b32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def _clean(text: str | None) -> str:
    """A header value on one line; percent signs and line ends are escaped, so it reads back as it was."""
    return "" if text is None else text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _restore(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def header(row) -> bytes:
    """The WARC and HTTP headers of a record; the block length is known from the payload length alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.payload_bytes}\r\n\r\n".encode()
    own = record_id(row.page_id, row.url, row.payload_digest, row.copy)
    body = len(http) + (row.payload_bytes if row.type == "response" else 0)
    lines = ["WARC/1.1", f"WARC-Type: {row.type}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response",
             f"WARC-Payload-Digest: sha1:{_b32(row.payload_digest)}", f"Content-Length: {body}"]
    lines += [f"WARC-Target-URI: {_clean(row.url)}"] if row.url is not None else []
    lines += [f"X-Page-ID: {row.page_id}"] if row.page_id is not None else []
    if row.type == "revisit":
        # The response is the first copy of the row it names, so its identifier follows from that row.
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(row.refers_to, row.refers_url, row.payload_digest, 0)}"]
        lines += [f"X-Refers-To-Page-ID: {row.refers_to}"] if row.refers_to is not None else []
    return "\r\n".join(lines).encode() + END + http


class ArchiveWriter:
    """Streams chunk rows to files; one gzip member a record, one buffer of compressed bytes at a time."""

    def __init__(self, path: str, name: str, level: int = 4, roll: int = ROLL):
        self.fs, self.base = _file_system(path)
        self.name, self.level, self.roll = name, level, roll
        self.out, self.done = None, []

    def put(self, row) -> None:
        if row.chunk == 0:
            if self.out is None:
                self.file = f"{self.name}-{len(self.done):05d}.warc.gz"
                self.out, self.records, self.size = self.fs.open_output_stream(f"{self.base}/{self.file}", compression=None), 0, 0
            self.member = zlib.compressobj(self.level, zlib.DEFLATED, 31)
            self.digest = hashlib.sha1()
            self._send(self.member.compress(header(row)))
        self.digest.update(row.data)
        self._send(self.member.compress(row.data))
        if row.chunk + 1 == row.chunks:
            if row.type == "response" and self.digest.hexdigest() != row.payload_digest:
                raise ValueError(f"chunks of page {row.page_id} do not give its digest")
            self._send(self.member.compress(END) + self.member.flush())
            self.records += 1
            if self.size >= self.roll:
                self.close()

    def _send(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.file, self.records, self.size))
            self.out = None


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, chunk: int = CHUNK,
          roll: int = ROLL) -> None:
    """Write archives below ``path`` and their manifest to ``path/manifest``.

    A null html is the empty payload; a null id or url is left out of the header; equal rows are records of their own; other columns are not
    read; an empty table writes a manifest without files. ``path`` is a folder that all executors reach (a local path or a URI pyarrow
    knows).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        files = ArchiveWriter(path, f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}", roll=roll)
        for batch in batches:
            for row in batch.itertuples(index=False):
                files.put(row)
        files.close()
        yield pd.DataFrame(files.done, columns=["file", "records", "bytes"])

    system, base = _file_system(path)
    system.create_dir(base, recursive=True)
    table = chunked(plan(pages, page_id, url, html, least), chunk)
    table.mapInPandas(run, "file string, records bigint, bytes bigint").write.parquet(f"{path}/manifest")


class Inflate:
    """The bytes of a file of gzip members, read and inflated in pieces."""

    def __init__(self, stream, piece: int = 1 << 16):
        self.stream, self.piece = stream, piece
        self.raw, self.z, self.held = b"", zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        while True:
            if self.z.eof:
                self.raw, self.z = self.z.unused_data, zlib.decompressobj(31)
            got = self.z.decompress(self.raw, self.piece)
            self.raw = b"" if self.z.eof else self.z.unconsumed_tail
            if got:
                self.held += got
                return True
            if not self.z.eof and not self.raw:
                self.raw = self.stream.read(self.piece)
                if not self.raw:
                    return False

    def until(self, mark: bytes) -> bytes | None:
        """The bytes up to and with ``mark``; None at the end of the file."""
        at = 0
        while (end := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if self.held:
                    raise ValueError("a record ends within its header")
                return None
        return self._cut(end + len(mark))

    def take(self, count: int) -> bytes:
        """``count`` bytes; the caller asks for no more than a chunk."""
        while len(self.held) < count and self.more():
            pass
        if len(self.held) < count:
            raise ValueError("a record is shorter than its length")
        return self._cut(count)

    def _cut(self, count: int) -> bytes:
        out = bytes(self.held[:count])
        del self.held[:count]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if line)


def records_of(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """The chunk rows of one archive. ``digest`` is that of the payload up to and with the chunk, so the last chunk has the whole one."""
    source = Inflate(stream)
    while (head := source.until(END)) is not None:
        f = _fields(head)
        http = source.until(END)
        payload = int(_fields(http)["Content-Length"])
        row = {"record_id": f["WARC-Record-ID"], "record_type": f["WARC-Type"], "page_id": f.get("X-Page-ID"), "refers_to": f.get("X-Refers-To-Page-ID"),
               "refers_record": f.get("WARC-Refers-To"), "url": _restore(f["WARC-Target-URI"]) if "WARC-Target-URI" in f else None,
               "payload_bytes": payload}
        stored = base64.b32decode(f["WARC-Payload-Digest"].split(":", 1)[1]).hex()
        left, digest, number = int(f["Content-Length"]) - len(http), hashlib.sha1(), 0
        if f["WARC-Type"] == "revisit":
            yield {**row, "chunk": 0, "last": True, "digest": stored, "data": b""}
        else:
            while number == 0 or left:
                data = source.take(min(chunk, left))
                left -= len(data)
                digest.update(data)
                if not left and digest.hexdigest() != stored:
                    raise ValueError(f"payload of {row['record_id']} does not have its digest")
                yield {**row, "chunk": number, "last": not left, "digest": digest.hexdigest(), "data": data}
                number += 1
        if source.take(4) != END:
            raise ValueError(f"record {row['record_id']} does not end where its length says")


READ_SCHEMA = ("record_id string, record_type string, page_id bigint, refers_to bigint, refers_record string, url string, payload_bytes bigint, "
               "chunk int, last boolean, digest string, data binary")
ROWS = 512
BATCH_BYTES = 8 << 20


def read(spark: SparkSession, path: str, contents: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of all archives that the manifest of ``path`` names; without ``contents`` only the last row of each record, without data.

    Files are dealt out by name, one archive to a task at most; a file that does not hold the number of records of its manifest row is an error.
    """
    manifest = spark.read.schema("file string, records bigint, bytes bigint").parquet(f"{path}/manifest")
    # The manifest has one row per file: a bounded count, needed to give each file a task.
    number = max(1, manifest.count())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _file_system(path)
        for batch in batches:
            for file, records in zip(batch["file"], batch["records"]):
                rows, size, seen = [], 0, 0
                with system.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    for row in records_of(stream, chunk):
                        seen += row["last"]
                        if not contents:
                            if not row["last"]:
                                continue
                            row["data"] = None
                        rows.append(row)
                        size += len(row["data"] or b"")
                        if len(rows) >= ROWS or size >= BATCH_BYTES:
                            yield frame(rows)
                            rows, size = [], 0
                if seen != records:
                    raise ValueError(f"{file} holds {seen} records, its manifest says {records}")
                yield frame(rows)

    def frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in READ_SCHEMA.split(", ")])
        return out.assign(**{c: exact_ids(out[c]) for c in ("page_id", "refers_to")})

    files = manifest.select("file", "records").repartitionByRange(number, "file")
    return files.mapInPandas(run, READ_SCHEMA)


def payloads(chunks: DataFrame) -> DataFrame:
    """(record_id, payload) with the chunks of each record put together again. For callers whose records fit into memory."""
    parts = chunks.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "data"))).alias("parts"))
    whole = F.aggregate("parts", F.lit(b""), lambda out, p: F.concat(out, p["data"]))
    return parts.select("record_id", whole.alias("payload"))
