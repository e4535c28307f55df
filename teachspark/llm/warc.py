"""Operator 10: WARC archives, written and read back record by record.

Each record is a gzip member of its own. The reader goes through an archive front to back: it feeds
bounded chunks to zlib, starts the next member where the last ended, takes the record's header
block, then exactly as many bytes as ``Content-Length`` says, and checks block and payload digests.
Nothing but one chunk and one record is held.

A record's payload is a page's HTML. Of pages with equal payloads of at least ``REVISIT_BYTES``, the
one with the smallest id is stored as ``response``; the others become ``revisit`` records, which
hold HTTP headers only and name the stored record in ``WARC-Refers-To``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch

#: Smaller payloads are stored each time: a revisit record would be no shorter.
REVISIT_BYTES = 100
#: Bytes read from an archive at a time, and bytes that zlib may give out at a time.
CHUNK = 1 << 16
#: Uncompressed bytes after which a writer starts another archive.
ARCHIVE_BYTES = 64 << 20

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESULT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, ok boolean"


def open_path(path: str, mode: str):
    """A binary stream on a file of a shared file system (``file:``, ``hdfs:`` or what else Arrow opens)."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")
    return system.open_input_stream(name, compression=None) if mode == "r" else system.open_output_stream(name, compression=None)


def rename(old: str, new: str) -> None:
    from pyarrow import fs

    system, a = fs.FileSystem.from_uri(old if re.match(r"\w+:", old) else f"file://{old}")
    system.move(a, fs.FileSystem.from_uri(new if re.match(r"\w+:", new) else f"file://{new}")[1])


def make_folder(path: str) -> None:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")
    system.create_dir(name, recursive=True)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, not yet compressed. A null id is written as ``null``, a null url left out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=-._~%"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write rows ``(page_id, url, html, digest, refers_to)`` as ``.warc.gz`` files in ``folder``.

    Returns one row an archive: ``(archive, records)``. A file gets its final name when it is
    whole, under a name no other attempt uses, and only files that the returned rows name count: a
    task that dies or runs twice leaves at most a file that nothing reads.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, path, size, records = None, "", 0, 0
        for batch in batches:
            for page_id, url, html, digest, refers in zip(*(batch[c] for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None:
                    path, size, records = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = open_path(f"{path}.part", "w")
                data = record(
                    None if pd.isna(page_id) else int(page_id),
                    url if isinstance(url, str) else None,
                    html.encode("utf-8", "surrogatepass") if isinstance(html, str) else b"",
                    digest,
                    None if pd.isna(refers) else int(refers),
                )
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(member.compress(data) + member.flush())
                size, records = size + len(data), records + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    rename(f"{path}.part", path)
                    yield pd.DataFrame({"archive": [path], "records": [records]})
                    out = None
        if out is not None:
            out.close()
            rename(f"{path}.part", path)
            yield pd.DataFrame({"archive": [path], "records": [records]})

    # Ids as strings of digits: pandas would turn a column of ids with nulls into doubles.
    text_ids = pages.select(F.col("page_id").cast("string"), "url", "html", "digest", F.col("refers_to").cast("string"))
    return text_ids.mapInPandas(write, "archive string, records long")


class Members:
    """The bytes of an archive of gzip members, inflated chunk by chunk; ``member_end`` tells whether one just ended."""

    def __init__(self, stream, chunk: int = CHUNK) -> None:
        self.stream, self.chunk, self.raw, self.buffer = stream, chunk, b"", bytearray()
        self.inflate, self.offset, self.read = None, 0, 0

    def next_member(self) -> bool:
        """Start the next member; False at the end of the archive."""
        if self.inflate is not None and not self.inflate.eof:
            raise ValueError("the next member was asked for inside a member")
        if self.inflate is not None:
            self.raw = self.inflate.unused_data
        if not self.raw:
            self.raw = self.stream.read(self.chunk)
            self.read += len(self.raw)
        if not self.raw:
            return False
        self.offset = self.read - len(self.raw)
        self.inflate, self.buffer = zlib.decompressobj(31), bytearray()
        return True

    def more(self) -> bool:
        """Inflate one more chunk into the buffer; False when the member has ended."""
        if self.inflate.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(self.chunk)
            self.read += len(self.raw)
            if not self.raw:
                raise ValueError("the archive ends inside a member")
        self.buffer += self.inflate.decompress(self.raw, self.chunk)
        self.raw = self.inflate.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        start = 0
        while (at := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark) + 1)
            if not self.more():
                raise ValueError(f"no {mark!r} in the member")
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """Exactly ``n`` bytes, in pieces."""
        while n:
            if not self.buffer and not self.more():
                raise ValueError("the member is shorter than its Content-Length")
            piece = bytes(self.buffer[:n])
            del self.buffer[: len(piece)]
            n -= len(piece)
            if piece:
                yield piece

    def finish(self, mark: bytes) -> None:
        """Nothing but ``mark`` may follow in the member."""
        while self.more():
            if len(self.buffer) > len(mark):
                break
        if bytes(self.buffer) != mark:
            raise ValueError("the member does not end after its record")


def fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def read_records(stream, chunk: int = CHUNK, payloads: bool = False) -> Iterator[dict]:
    """The records of an archive in order: ``offset``, ``headers``, ``http``, ``payload_bytes``, ``payload_sha256``, ``ok``.

    ``ok`` tells whether every digest that the record states is right (for a revisit, the payload is
    elsewhere, so only its block is checked). Broken framing raises ValueError. The payload itself
    is kept only on request.
    """
    members = Members(stream, chunk)
    while members.next_member():
        version, headers = fields(members.until(b"\r\n\r\n"))
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        block, payload, kept = hashlib.sha256(), hashlib.sha256(), bytearray()
        size, head, http = 0, bytearray(), None
        for piece in members.take(int(headers["content-length"])):
            block.update(piece)
            if http is None:
                head += piece
                if (at := head.find(b"\r\n\r\n")) < 0:
                    continue
                http, piece = fields(bytes(head[:at]))[1], bytes(head[at + 4 :])
            payload.update(piece)
            size += len(piece)
            if payloads:
                kept += piece
        members.finish(b"\r\n\r\n")
        ok = headers.get("warc-block-digest") in (None, f"sha256:{block.hexdigest()}")
        if headers["warc-type"] != "revisit":
            ok = ok and headers.get("warc-payload-digest") in (None, f"sha256:{payload.hexdigest()}")
        yield {"offset": members.offset, "headers": headers, "http": http or {}, "payload_bytes": size, "payload_sha256": payload.hexdigest(), "ok": ok} | ({"payload": bytes(kept)} if payloads else {})


def page_of(uri: str | None) -> int | None:
    digits = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if re.fullmatch(r"-?\d+", digits) else None


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the archives that ``archives`` names in its column ``archive``, as rows of ``RESULT``.

    A revisit's payload size comes from the ``Content-Length`` of the HTTP headers that it repeats.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split(" ")[0] for x in RESULT.split(", ")]
        for batch in batches:
            for path in batch["archive"]:
                rows = []
                with open_path(path, "r") as stream:
                    for r in read_records(stream):
                        h, kind = r["headers"], r["headers"]["warc-type"]
                        size = int(r["http"]["content-length"]) if kind == "revisit" else r["payload_bytes"]
                        digest = h["warc-payload-digest"].removeprefix("sha256:") if kind == "revisit" else r["payload_sha256"]
                        rows.append((page_of(h["warc-record-id"]), h.get("warc-target-uri"), size, digest, kind, page_of(h.get("warc-refers-to")), path, r["offset"], r["ok"]))
                        if len(rows) >= 5000:
                            yield _frame(rows, names)
                            rows = []
                if rows:
                    yield _frame(rows, names)

    return archives.select("archive").mapInPandas(read, RESULT)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all ``pages`` (page_id, url, html) to archives and read the archives back, as rows of ``RESULT``.

    Null HTML is an empty payload. Of pages with equal payloads of at least ``REVISIT_BYTES`` bytes
    the smallest id is the response; rows that repeat that id are responses too, and so are rows of
    a group without any id. An empty table gives an empty result. Other columns are ignored.
    Digests are grouped with map-side combine and only those that occur twice are joined back, so
    a payload that a third of the pages share is one row on the small side.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    big = pages.where(F.octet_length("html") >= REVISIT_BYTES)
    first = big.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    refers = cut(
        big.select("page_id", "digest").join(first, "digest").where("page_id is null or page_id <> first").select("page_id", F.col("first").alias("refers_to"), "digest").distinct(), "warc-revisits"
    )
    joined = pages.join(refers.withColumnRenamed("digest", "__digest").withColumnRenamed("page_id", "__page"), F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest")), "left")
    folder = scratch(spark, "warc")
    make_folder(folder)
    archives = cut(write_archives(joined.select("page_id", "url", "html", "digest", "refers_to"), folder), "warc-manifest")
    return read_archives(archives.repartition(spark.sparkContext.defaultParallelism * 4, "archive"))
