"""WARC archives of pages: writing with revisits and segments, reading with segment reassembly.

Every page becomes a record whose block is an HTTP message with a chunked body. Blocks longer than SEGMENT bytes are cut:
the first segment keeps the record's type, the rest are continuation records that name the first one's id as
their origin, count up, and state the total length on the last. Archives hold one gzip member per record and are closed
at ARCHIVE bytes, so segments of a record may lie in different archives. The reader parses archives in
parallel, groups continuation segments by origin id, orders them by number, verifies the total
length, and only then undoes the chunked framing. Whole records never leave the task that read them.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bound_batches, materialize, maybe_broadcast, n_parts
from ._files import AtomicFile, open_input

#: Bytes of a record's block beyond which it is segmented, of an HTTP chunk, and of an archive.
SEGMENT, CHUNK, ARCHIVE = 65_536, 16_384, 64 << 20

_CRLF = b"\r\n"
_DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c := payload[i : i + size]), c) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped. ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(_CRLF, at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            if not body.endswith(_CRLF):
                raise ValueError("last chunk isn't closed")
            return b"".join(out)
        if body[at + size : at + size + 2] != _CRLF:
            raise ValueError("chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def http_block(payload: bytes, revisit: bool) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:  # the headers alone, with the length that the payload had
        return head + b"Content-Length: %d\r\n\r\n" % len(payload)
    return head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)


def http_payload(block: bytes) -> tuple[bytes | None, int]:
    """(payload, its length) of an HTTP message; payload None where the message has headers only."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict(line.lower().split(b":", 1) for line in head.split(_CRLF)[1:])
    if fields.get(b"transfer-encoding", b"").strip() == b"chunked":
        payload = unchunked(body)
        return payload, len(payload)
    length = int(fields.get(b"content-length", b"%d" % len(body)))
    return (body if len(body) == length else None), length


class ArchiveWriter:
    """Writes records to numbered archives with a common prefix."""

    def __init__(self, prefix: str, segment: int = SEGMENT, archive: int = ARCHIVE):
        self.prefix, self.segment, self.archive = prefix, segment, archive
        self.file, self.n, self.done = None, 0, []

    def _member(self, fields: list[tuple[str, object]], block: bytes) -> None:
        if self.file is None:
            self.file, self.records = AtomicFile(f"{self.prefix}-{len(self.done):04d}.warc.gz"), 0
        head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
        z = zlib.compressobj(5, zlib.DEFLATED, 31)
        self.file.write(z.compress(b"WARC/1.1\r\n" + head.encode() + _CRLF + block + _CRLF + _CRLF) + z.flush())
        self.records += 1
        if self.file.size >= self.archive:
            self._end()

    def _end(self) -> None:
        if self.file is not None:
            self.file.close()
            self.done.append((f"{self.prefix}-{len(self.done):04d}.warc.gz", self.records, self.file.size))
            self.file = None

    def add(self, page_id: int | None, unique: str, url: str | None, payload: bytes, refers_to: int | None) -> None:
        revisit = refers_to is not None
        block, rid = http_block(payload, revisit), f"<urn:page:{'' if page_id is None else page_id}:{unique}>"
        fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", rid), ("WARC-Date", _DATE), ("WARC-Target-URI", None if url is None else _clean(url)), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
        if revisit:
            fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        if len(block) <= self.segment:
            return self._member(fields, block)
        cuts = range(0, len(block), self.segment)
        for k, at in enumerate(cuts, 1):
            part = block[at : at + self.segment]
            if k == 1:
                self._member([*fields, ("WARC-Segment-Number", 1)], part)
            else:
                last = ("WARC-Segment-Total-Length", len(block) if k == len(cuts) else None)
                self._member([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{rid[:-1]}:s{k}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", k), last], part)
        return None

    def close(self) -> list[tuple[str, int, int]]:
        self._end()
        return self.done


def records(uri: str, piece: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record, streaming; plain and gzip archives."""
    with open_input(uri) as file:
        data, z, packed = bytearray(), None, None
        while True:
            raw = file.read(piece)
            if packed is None:
                packed = raw[:2] == b"\x1f\x8b"
            if packed:
                while raw:
                    z = z or zlib.decompressobj(31)
                    data += z.decompress(raw)
                    raw, z = (z.unused_data, None) if z.eof else (b"", z)
            else:
                data += raw
            at = 0
            while (end := data.find(b"\r\n\r\n", at)) >= 0:
                lines = data[at:end].decode().split("\r\n")
                fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
                size = int(fields["content-length"])
                if len(data) < end + 4 + size + 4:
                    break
                yield fields, bytes(data[end + 4 : end + 4 + size])
                at = end + 4 + size + 4
            del data[:at]
            if not file.tell() < file.size():
                if data.strip():
                    raise ValueError(f"{uri} ends within a record")
                return


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, sha1, refers_to) of the pages that repeat the payload of a page with a smaller id.

    Digests are grouped with a combine before the shuffle; only ids and digests move. Null page_ids never refer and never are
    referred to, unless all pages of a payload have none.
    """
    d = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha1"))
    first = d.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("most")).where("refers_to < most")
    return d.join(first.drop("most"), "sha1").where("page_id <> refers_to").distinct()


def write_archives(pages: DataFrame, out_dir: str, segment: int = SEGMENT, archive: int = ARCHIVE) -> DataFrame:
    """Archives pages (page_id, url, html) below out_dir; returns the manifest (path, n_records, n_bytes).

    Null html is an empty payload. Of equal payloads, empty ones included, the page with the smallest id is a response (every row
    that has that id) and the others revisit it. Other columns are ignored. An empty table writes no archives.
    """
    bound_batches(pages.sparkSession)
    again = materialize(revisits(pages), "revisits")
    n = again.count()
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    # few revisits are sent to all tasks (their number is checked); many meet the pages in a shuffle join
    p = p.join(maybe_broadcast(again, n), ["page_id", "sha1"], "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        out = ArchiveWriter(f"{out_dir}/pages-{part:06d}", segment, archive)
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch[c] for c in ("page_id", "url", "html", "refers_to")), strict=True):
                out.add(page_id.as_py(), f"{part}.{k}", url.as_py(), (html.as_py() or "").encode(), refers_to.as_py())
                k += 1
        if done := out.close():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["path", "n_records", "n_bytes"])

    return materialize(p.mapInArrow(write, "path string, n_records long, n_bytes long"), "archives")


_FIELDS = (
    ("origin", "string", pa.string()), ("number", "int", pa.int32()), ("total", "long", pa.int64()), ("page_id", "long", pa.int64()),
    ("url", "string", pa.string()), ("record_type", "string", pa.string()), ("refers_to", "long", pa.int64()), ("payload_digest", "string", pa.string()),
    ("payload_bytes", "long", pa.int64()), ("payload", "binary", pa.binary()), ("error", "string", pa.string()), ("block", "binary", pa.binary()),
)
_PAGE = ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload", "error")


def _schema(names: tuple[str, ...]) -> str:
    return ", ".join(f"{n} {kind}" for n, kind, _ in _FIELDS if n in names)


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kept = [(n, t) for n, _, t in _FIELDS if n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kept, strict=True)], [n for n, _ in kept])


def _page_number(uri: str | None) -> int | None:
    found = (uri or "").strip("<>").split(":")
    return int(found[2]) if len(found) > 2 and found[2] else None


def _opened(block: bytes, digest: str | None, with_payload: bool) -> tuple[int | None, bytes | None, str | None]:
    """(payload_bytes, payload, error) of a whole block."""
    try:
        payload, size = http_payload(block)
    except ValueError as x:
        return None, None, str(x)
    if payload is not None and digest and payload_digest(payload) != digest:
        return None, None, "payload digest differs"
    return size, payload if with_payload else None, None


def _records_of(with_payload: bool):
    """Rows of _FIELDS: records that are whole are decoded on the spot, segments keep their block."""
    names = tuple(n for n, _, _ in _FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path in batch["path"].to_pylist():
                for f, block in records(path):
                    kind = f.get("warc-type")
                    if kind not in ("response", "revisit", "continuation", "resource"):
                        continue
                    number, total = int(f.get("warc-segment-number", 0)), f.get("warc-segment-total-length")
                    rid = f.get("warc-segment-origin-id", f["warc-record-id"])
                    digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    opened = (None, None, None, block) if number else (*_opened(block, digest, with_payload), None)
                    rows.append((rid, number, None if total is None else int(total), _page_number(rid), f.get("warc-target-uri"), kind, _page_number(f.get("warc-refers-to")), digest, *opened))
                    held += len(block) if number or with_payload else 100
                    if held > 4 << 20:
                        yield _batch(rows, names)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, names)

    return run


def _decode(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, kind, refers_to, digest, error, block in zip(*(batch[c] for c in ("page_id", "url", "record_type", "refers_to", "payload_digest", "error", "block")), strict=True):
                opened = (None, None, error.as_py()) if error.is_valid else _opened(block.as_py(), digest.as_py(), with_payload)
                rows.append((page_id.as_py(), url.as_py(), kind.as_py(), refers_to.as_py(), digest.as_py(), *opened))
            if rows:
                yield _batch(rows, _PAGE)

    return run


def read_archives(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """Pages of the archives whose paths are given, a row per record: page_id, url, record_type, refers_to,
    payload_digest (of the full payload, as recorded), payload_bytes, payload (null for revisits), error.

    Segments are grouped by origin id and put in order of number; a number that occurs twice counts once. A missing first or inner
    segment, a total length that isn't stated or met, broken chunk framing and a digest that doesn't fit give a row whose
    error says so and whose payload is null. An origin's segments meet in one row, which is the record's own size.
    """
    every = tuple(n for n, _, _ in _FIELDS)
    s = materialize(paths.select("path").repartition(n_parts(paths), "path").mapInArrow(_records_of(with_payload), _schema(every)), "records")
    whole = s.where("number = 0").select(*_PAGE)
    cut = s.where("number > 0").groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("number", "total", "page_id", "url", "record_type", "refers_to", "payload_digest", "block"))).alias("all")
    )
    numbers = F.transform("all", lambda x: x["number"])
    kept = F.filter("all", lambda x, i: (i == 0) | (F.element_at(numbers, F.greatest(i, F.lit(1))) != x["number"]))
    cut = cut.withColumn("all", kept).withColumn("first", F.element_at("all", 1))
    block = F.aggregate("all", F.lit(b""), lambda a, x: F.concat(a, x["block"]))
    cut = cut.withColumn("block", block).withColumn("last", F.element_at("all", -1))
    error = (
        F.when((F.col("first.number") != 1) | (F.col("last.number") != F.size("all")), F.lit("a segment is missing"))
        .when(F.col("last.total").isNull(), F.lit("the last segment is missing"))
        .when(F.col("last.total") != F.length("block"), F.lit("total length differs"))
    )
    cut = cut.select("first.page_id", "first.url", "first.record_type", "first.refers_to", "first.payload_digest", error.alias("error"), "block")
    return whole.unionByName(cut.mapInArrow(_decode(with_payload), _schema(_PAGE)))


def round_trip(spark: SparkSession, pages: DataFrame, out_dir: str) -> DataFrame:
    """Archives pages and returns what the archives hold, without payloads; fails on a record that can't be read."""
    read = read_archives(write_archives(pages, out_dir), with_payload=False)
    sound = F.when(F.col("error").isNull(), F.col("payload_bytes")).otherwise(F.raise_error(F.coalesce("error", F.lit(""))).cast("long"))
    return read.select("page_id", sound.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
