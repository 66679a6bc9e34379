"""WARC archives: one gzip member per record, written in bulk and read back sequentially.

An archive is the concatenation of gzip members. Executors share only what Spark's writers and readers reach, so
archives are kept as binary chunks in Parquet (``archive``, ``content``); ``read_warc_files`` reads ordinary
``.warc.gz`` files by any path that Spark can open.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

READ_BYTES = 64 * 1024
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class WarcError(ValueError):
    """A record that breaks the format or its digest."""


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{kind}')}>"


def record(kind: str, uri: str, payload: bytes, page_id: int | None, full_digest: str, full_bytes: int, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. A revisit carries the HTTP head only, the digest being that of the full payload."""
    block = HTTP_HEAD + (payload if kind == "response" else b"")
    uri = "".join(c if c.isprintable() else "%" + c.encode("utf-8", "replace").hex() for c in uri)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, kind) if page_id is not None else f'<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, full_digest + uri)}>'}",
        "WARC-Date: 2020-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: {sha1_base32(block)}",
        f"WARC-Payload-Digest: {full_digest}",
        f"X-Payload-Length: {full_bytes}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head += [f"WARC-Refers-To: {record_id(refers_to, 'response')}", f"X-Refers-To-Page: {refers_to}"]
    raw = ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Reader:
    """Reads one record from the pieces of its gzip member: headers first, then the block, whose digests are kept up piece by piece.

    Nothing but the headers (and, with ``keep``, the payload) stays in memory. ``finish`` checks framing and digests.
    """

    MOST_HEAD = 1 << 20

    def __init__(self, keep: bool = False):
        self.keep, self.head, self.headers, self.left = keep, b"", None, 0
        self.block, self.payload, self.size = hashlib.sha1(), hashlib.sha1(), 0
        self.inner, self.tail, self.parts = b"", b"", []

    def feed(self, data: bytes) -> None:
        if self.headers is None:
            self.head += data
            head, gap, data = self.head.partition(b"\r\n\r\n")
            if not gap:
                if len(self.head) > self.MOST_HEAD:
                    raise WarcError("no end of the headers")
                return
            self._begin(head)
        part, rest = data[: self.left], data[self.left :]
        self.left -= len(part)
        self.block.update(part)
        if self.inner is not None:  # still in the HTTP headers
            self.inner += part
            _, gap, part = self.inner.partition(b"\r\n\r\n")
            if gap:
                self.inner = None
        if self.inner is None:
            self.payload.update(part)
            self.size += len(part)
            if self.keep:
                self.parts.append(part)
        self.tail += rest
        if len(self.tail) > 4:
            raise WarcError("content length and record don't agree")

    def _begin(self, head: bytes) -> None:
        try:
            lines = head.decode("utf-8").split("\r\n")
        except UnicodeDecodeError as e:
            raise WarcError("headers are not UTF-8") from e
        if not lines[0].startswith("WARC/"):
            raise WarcError("not a WARC record")
        h, self.head = {}, b""
        for line in lines[1:]:
            name, colon, value = line.partition(":")
            if not colon:
                raise WarcError(f"bad header line: {line[:80]}")
            h[name.strip().lower()] = value.strip()
        try:
            self.left = int(h["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError("no usable content length") from e
        self.headers = h
        if not h.get("content-type", "").lower().startswith("application/http"):
            self.inner = None  # the block is the payload

    def finish(self) -> tuple[dict[str, str], int, str, bytes]:
        """Headers, length and hex SHA-1 of the payload that the record holds, and the payload itself if kept."""
        if self.headers is None or self.left or self.tail != b"\r\n\r\n":
            raise WarcError("content length and record don't agree")
        h = self.headers
        if known(h.get("warc-block-digest", self.block.hexdigest())) not in (None, self.block.hexdigest()):
            raise WarcError("block digest differs")
        if h.get("warc-type") == "response" and known(h.get("warc-payload-digest", "")) not in (None, self.payload.hexdigest()):
            raise WarcError("payload digest differs")
        return h, self.size, self.payload.hexdigest(), b"".join(self.parts)


def known(digest: str) -> str | None:
    """A SHA-1 digest header (base 32 or hex) as bare hex; None for other algorithms."""
    name, _, value = digest.rpartition(":")
    if name.lower() not in ("", "sha1"):
        return None
    if len(value) == 40:
        return value.lower()
    try:
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else None
    except ValueError:
        return None


def read_archive(chunks: Iterable[bytes], keep: bool = False) -> Iterator[tuple[dict[str, str], int, str, bytes]]:
    """Each gzip member of a stream as a record (see ``Reader.finish``), decompressed piece by piece as the bytes arrive."""
    z, reader, begun = zlib.decompressobj(31), Reader(keep), False
    for chunk in chunks:
        data = chunk
        while data:
            try:
                plain = z.decompress(data, READ_BYTES)
            except zlib.error as e:
                raise WarcError(f"broken gzip member: {e}") from e
            reader.feed(plain)
            begun, data = True, z.unconsumed_tail
            if z.eof:
                yield reader.finish()
                data, begun = z.unused_data, False
                z, reader = zlib.decompressobj(31), Reader(keep)
    if begun:
        raise WarcError("the archive ends inside a gzip member")


def _written(chunk_bytes: int):
    def write(batches):
        parts, held = [], 0
        for b in batches:
            for page_id, url, html, digest, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first_id")), strict=True):
                payload = (html or "").encode()
                kind = "response" if first is None or first == page_id else "revisit"
                full = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
                parts.append(record(kind, url or "", payload, page_id, full, len(payload), first))
                held += len(parts[-1])
                if held >= chunk_bytes:
                    yield _chunk(parts)
                    parts, held = [], 0
        if parts:
            yield _chunk(parts)

    return write


def _chunk(parts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([len(parts)], pa.int64()), pa.array([b"".join(parts)], pa.binary())], ["archive", "n_records", "content"])


def write_warc(pages: DataFrame, least_bytes: int = 1000, chunk_bytes: int = 4 << 20) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html): rows archive, n_records, content of about ``chunk_bytes`` each.

    Of the records with equal payloads of ``least_bytes`` or more, that with the largest page_id is the response and
    the others are revisits of it; smaller ones are all responses. A null html is an empty payload, a null url an empty
    one. Rows without a page_id are responses, as are rows that repeat the page_id of the response.
    """
    common.ship_code(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.coalesce("html", F.lit(""))))
    groups = rows.filter(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 and first_id is not null")
    groups = common.durable(groups.select("digest", "first_id"))
    big = (F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes) & F.col("page_id").isNotNull()
    marked = rows.join(common.small(groups), "digest", "left").withColumn("first_id", F.when(big, F.col("first_id")))
    return marked.mapInArrow(_written(chunk_bytes), "archive string, n_records long, content binary")


_SEEN = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _number(x: str | None) -> int | None:
    """A whole number of 64 bits; anything else in such a header is no number."""
    if x is None or not re.fullmatch("-?[0-9]{1,19}", x):
        return None
    return int(x) if -(2**63) <= int(x) < 2**63 else None


def _rows(records) -> pa.RecordBatch:
    out = [[], [], [], [], [], []]
    for h, n, sha, _ in records:
        kind = h.get("warc-type", "")
        if kind == "revisit":  # the payload lies elsewhere: its digest is the header's, its length only known if told
            n, sha = _number(h.get("x-payload-length")), known(h.get("warc-payload-digest", ""))
        for col, v in zip(out, (_number(h.get("x-page-id")), n, sha, kind, _number(h.get("x-refers-to-page")), h.get("warc-target-uri")), strict=True):
            col.append(v)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [x.split()[0] for x in _SEEN.split(", ")])


def _read(batches):
    for b in batches:
        for content in b.column("content"):
            view = content.as_buffer() if content.is_valid else None
            held = []
            for x in read_archive(bytes(view[i : i + READ_BYTES]) for i in range(0, view.size, READ_BYTES)) if view is not None else ():
                held.append(x)
                if len(held) >= 256:
                    yield _rows(held)
                    held = []
            if held:
                yield _rows(held)


def read_warc(archives: DataFrame) -> DataFrame:
    """One row per record of ``archives`` (content: binary): page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    page_id and refers_to are numbers that ``write_warc`` leaves in headers of its own (beside the standard WARC-Refers-To);
    records of other writers have null there, and null payload_bytes if they are revisits. Any record type is read.
    A null or empty content has no records; an empty table gives no rows; other columns are ignored; repeated archives
    give repeated rows. Broken members, framing or SHA-1 digests raise ``WarcError``.
    """
    common.ship_code(archives.sparkSession)
    return archives.select("content").mapInArrow(_read, _SEEN)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """Like ``read_warc`` for ``.warc.gz`` files (each below 2 GB, the limit of Spark's binary reader)."""
    return read_warc(spark.read.format("binaryFile").load(path))


#: The same rows in SQL (page ids are unique).
SQL = """
SELECT page_id, octet_length(encode(p)) AS payload_bytes, sha1(p) AS payload_digest,
       CASE WHEN octet_length(encode(p)) >= 1000 AND page_id < first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(p)) >= 1000 AND page_id < first_id THEN first_id END AS refers_to
FROM (SELECT page_id, p, max(page_id) OVER (PARTITION BY p) AS first_id FROM (SELECT page_id, coalesce(html, '') AS p FROM pages))
"""
