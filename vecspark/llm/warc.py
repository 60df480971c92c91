"""WARC archives of web pages: one gzip member per record, written and read as Spark jobs.

Writing goes through Spark's text writer, so a lost task is written again and only committed
files count. A gzip member ends with the highest byte of its length, which is 0 below 16 MiB:
that byte serves as the line separator, and the file is an unbroken row of members. A record of
16 MiB or more is followed by a small metadata record, so that its line ends in 0 as well.

Reading goes through Spark's text reader with the header of a member as line separator: a file of
any size is cut at members and read by several tasks, on every file system that Spark reads.
Within a task the reader is sequential: it inflates a member piece by piece, frames the record by
its Content-Length and checks both digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from vecspark.llm.support import BROADCAST_IDS, write_step

#: Payloads from this size on are written once; later ones revisit it.
SMALLEST_SHARED = 1000
#: Start of a gzip member: deflate, no flags, no time, unknown system.
MEMBER = bytes.fromhex("1f8b08000000000000ff")
#: Pages of one digest from which on the digest is heavy: broadcast, even where the others are shuffled.
HEAVY = 10_000
#: Bytes that are inflated at once, and payload bytes in one result batch.
PIECE = 64 << 10
BATCH_BYTES = 8 << 20
TALL = 1 << 24
#: Longest head of a record or of the HTTP part that the reader accepts.
HEAD_BYTES = 1 << 20
DATE = "2000-01-01T00:00:00Z"

FIELDS = (
    "record_id string, record_type string, target_uri string, refers_to string, "
    "payload_bytes long, payload_digest string, payload binary"
)


# ---------------------------------------------------------------- writing


def member(record: bytes, level: int = 6) -> bytes:
    """One gzip member holding ``record``."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    return MEMBER + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def labelled(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _head(fields: list[tuple[str, str | None]]) -> bytes:
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields if v is not None), "\r\n"]).encode()


def _clean(uri: str | None) -> str | None:
    """A URI that cannot end its header line: blanks and control characters are percent-encoded."""
    return None if uri is None else re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", uri)


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """The member(s) of one page: a response, or a revisit of page ``refers_to`` without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    revisit = refers_to is not None
    head = _head([
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", page_urn(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", page_urn(refers_to) if revisit else None),
        ("WARC-Payload-Digest", labelled(hashlib.sha1(payload).digest())),
        ("WARC-Block-Digest", labelled(hashlib.sha1(block).digest())),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ])
    record = head + block + b"\r\n\r\n"
    written = member(record, level)
    if len(record) >= TALL:
        note = b"length: %d\r\n" % len(record)
        about = page_urn(page_id)
        head = _head([
            ("WARC-Type", "metadata"), ("WARC-Record-ID", f"<{about[1:-1]}:note>"), ("WARC-Date", DATE),
            ("WARC-Refers-To", about), ("WARC-Block-Digest", labelled(hashlib.sha1(note).digest())),
            ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(note))),
        ])
        written += member(head + note + b"\r\n\r\n", level)
    return written


def _members(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, refers = (batch.column(i) for i in (0, 1, 3))
            lines, held = [], 0
            for i in range(batch.num_rows):
                html = batch.column(2)[i].as_py() or ""
                line = page_record(ids[i].as_py(), urls[i].as_py(), html.encode(), refers[i].as_py(), level)
                lines.append(line[:-1])
                held += len(line)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], names=["line"])
                    lines, held = [], 0
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], names=["line"])

    return run


def revisited(pages: DataFrame) -> DataFrame:
    """``(same, n, target)``: payloads of at least 1000 bytes that several rows hold, and the largest page_id.

    Equality is that of the SHA-256. Only digests and ids are shuffled, counted before they are.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    found = pages.where(F.octet_length("html") >= SMALLEST_SHARED).select("page_id", F.unhex(F.sha2(payload, 256)).alias("same"))
    shared = found.groupBy("same").agg(F.count("*").alias("n"), F.max("page_id").alias("target"))
    return write_step(shared.where("n > 1 AND target IS NOT NULL"), "revisited")


def _with_targets(pages: DataFrame, shared: DataFrame) -> DataFrame:
    """Add ``refers_to``. Pages stay in their scan if the shared digests can be broadcast.

    Else the digests of many pages are broadcast and only the rest of the pages is shuffled, so
    that no digest fills a task.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html").withColumn(
        "same", F.when(F.octet_length(html) >= SMALLEST_SHARED, F.unhex(F.sha2(F.encode(html, "UTF-8"), 256)))
    )
    other = F.when(F.col("target") != F.col("page_id"), F.col("target"))
    other = F.when(F.col("page_id").isNull(), F.col("target")).otherwise(other).alias("refers_to")

    def joined(part: DataFrame, digests: DataFrame) -> DataFrame:
        return part.join(digests.select("same", "target"), "same", "left").select("page_id", "url", "html", other)

    if shared.count() <= BROADCAST_IDS:
        return joined(rows, F.broadcast(shared))
    heavy = shared.where(F.col("n") >= HEAVY)
    if heavy.count() <= BROADCAST_IDS:
        heavy = F.broadcast(heavy)
    first = rows.join(heavy.select("same", F.col("target").alias("most")), "same", "left")
    hot = first.where("most IS NOT NULL").withColumnRenamed("most", "target").select("page_id", "url", "html", other)
    rest = first.where("most IS NULL").drop("most")
    return hot.unionByName(joined(rest, shared.where(F.col("n") < HEAVY)))


def write_archives(pages: DataFrame, folder: str, level: int = 6) -> None:
    """Write one record per row of ``pages (page_id, url, html)`` into archives below ``folder``.

    The payload is the html in UTF-8, empty for a null. Of rows with equal payloads of at least
    1000 bytes those with the largest page_id are responses, the others revisits of it; smaller
    payloads are always responses. A null page_id is smaller than all others; where all ids of a
    payload are null, all are responses. Rows that repeat a page_id each get a record. A null url
    leaves the URI out. Other columns are ignored; an empty table gives an empty folder.
    """
    rows = _with_targets(pages, revisited(pages))
    lines = rows.select("page_id", "url", "html", "refers_to").mapInArrow(_members(level), "line binary")
    lines.select(F.col("line").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(folder)


# ---------------------------------------------------------------- reading


class Broken(ValueError):
    """A record that does not keep the format or whose digest does not match."""


class Inflater:
    """The bytes of one gzip member, inflated in pieces as they are asked for."""

    def __init__(self):
        self._inflate = zlib.decompressobj(31)
        self._raw: list[memoryview] = []
        self.ready = bytearray()

    def feed(self, raw: bytes) -> None:
        self._raw.append(memoryview(raw))

    def more(self) -> bool:
        """Inflate one more piece; False if the member or what was fed of it has ended."""
        while not self._inflate.eof:
            raw = self._inflate.unconsumed_tail
            if not raw:
                if not self._raw:
                    return False
                raw = self._raw[0][:PIECE]
                self._raw[0] = self._raw[0][PIECE:]
                if not self._raw[0]:
                    del self._raw[0]
            piece = self._inflate.decompress(raw, PIECE)
            if piece:
                self.ready += piece
                return True
        return False

    def finished(self) -> bool:
        while self.more():
            pass
        return self._inflate.eof

    def leftover(self) -> bool:
        return bool(self._inflate.unused_data or self._raw)

    def until(self, mark: bytes) -> bytes:
        """Everything up to and with ``mark``."""
        at = 0
        while True:
            found = self.ready.find(mark, max(0, at - len(mark)))
            if found >= 0:
                end = found + len(mark)
                taken = bytes(self.ready[:end])
                del self.ready[:end]
                return taken
            at = len(self.ready)
            if at > HEAD_BYTES or not self.more():
                raise Broken("the head of a record does not end")

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, in pieces."""
        while n:
            if not self.ready and not self.more():
                raise Broken(f"{n} bytes are missing from a record")
            piece = bytes(self.ready[:n])
            del self.ready[: len(piece)]
            n -= len(piece)
            yield piece


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise Broken("a record does not begin with WARC/")
    pairs = (line.partition(":") for line in lines[1:] if line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _matches(label: str | None, digest) -> bool:
    """Does the computed SHA-1 match a header? Other algorithms and absent headers prove nothing."""
    if label is None or not label.lower().startswith("sha1:"):
        return True
    value = label[5:]
    return value.upper() == base64.b32encode(digest.digest()).decode() or value.lower() == digest.hexdigest()


def _hex(label: str | None) -> str | None:
    if label is None or not label.lower().startswith("sha1:"):
        return None
    value = label[5:]
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def read_record(source: Inflater, payloads: bool) -> tuple:
    """One record as the values of FIELDS. The payload is kept only if asked for."""
    head = _fields(source.until(b"\r\n\r\n"))
    name = head.get("warc-record-id")
    if not re.fullmatch(r"\d+", head.get("content-length", "")):
        raise Broken(f"{name}: no content length")
    size, kind = int(head["content-length"]), head.get("warc-type")
    block, payload, kept = hashlib.sha1(), hashlib.sha1(), bytearray()
    is_http = head.get("content-type", "").replace(" ", "").lower().startswith("application/http")
    http, n_payload = bytearray(), 0
    in_payload = not is_http
    for piece in source.take(size):
        block.update(piece)
        if not in_payload:
            http += piece
            end = http.find(b"\r\n\r\n")
            if end < 0:
                if len(http) > HEAD_BYTES:
                    raise Broken(f"{name}: the HTTP head does not end")
                continue
            in_payload, piece = True, bytes(http[end + 4 :])
            del http[end + 4 :]
        payload.update(piece)
        n_payload += len(piece)
        if payloads:
            kept += piece
    if b"".join(source.take(4)) != b"\r\n\r\n" or source.ready or source.more():
        raise Broken(f"{name}: the record does not end where its length says")
    if not _matches(head.get("warc-block-digest"), block):
        raise Broken(f"{name}: the block does not match its digest")
    stated = head.get("warc-payload-digest")
    if kind == "revisit":
        told = re.search(rb"(?im)^content-length:\s*(\d+)", bytes(http))
        n_payload, digest, whole = int(told[1]) if told else None, _hex(stated), None
    elif not _matches(stated, payload):
        raise Broken(f"{name}: the payload does not match its digest")
    else:
        digest, whole = payload.hexdigest(), bytes(kept) if payloads else None
    return name, kind, head.get("warc-target-uri"), head.get("warc-refers-to"), n_payload, digest, whole


def _records(start: bytes, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload"]
        types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            rows, held = [], 0
            for line in batch.column(0):
                source = Inflater()
                source.feed(start)
                source.feed(line.as_py())
                try:
                    row = read_record(source, payloads)
                except zlib.error as wrong:
                    raise Broken(f"a member cannot be inflated: {wrong}") from wrong
                if not source.finished() or source.leftover():
                    raise Broken(f"{row[0]}: the member does not end with its record")
                rows.append(row)
                held += len(row[-1] or b"") + 200
                if held >= BATCH_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return run


def read_archives(spark: SparkSession, paths: str | list[str], start: bytes = MEMBER, payloads: bool = False) -> DataFrame:
    """All records of archives with one gzip member per record, as rows of FIELDS.

    ``start`` is the header that every member begins with (10 bytes; archives of one writer share
    it). ``payload`` is null unless ``payloads`` is set, and for revisits. For revisits
    ``payload_bytes`` and ``payload_digest`` are those that the record states for the full payload.
    A damaged member, a wrong length or a digest that does not match is an error.
    The suffix of a file must not be one that Spark decompresses itself (as ``.gz``).
    """
    if len(start) < 10:
        raise ValueError("a member's header has 10 bytes")
    lines = spark.read.option("lineSep", start.decode("latin-1")).option("encoding", "ISO-8859-1").text(paths)
    raw = lines.select(F.col("value").cast("binary").alias("line")).where(F.length("line") > 0)
    return raw.mapInArrow(_records(start, payloads), FIELDS)


def page_id(urn: str) -> F.Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def page_records(records: DataFrame) -> DataFrame:
    """The responses and revisits of ``write_archives`` by page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return records.where(F.col("record_type").isin("response", "revisit")).select(
        page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_id("refers_to").alias("refers_to"),
    )


def unresolved(records: DataFrame) -> DataFrame:
    """``(refers_to, payload_digest)`` of revisits whose response is not there or has another payload."""
    asked = records.where("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    held = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_digest").distinct()
    return asked.join(held, ["refers_to", "payload_digest"], "left_anti")
