"""WARC archives: one gzip member per record, written and read record by record in tasks.

Reading is sequential: a member is inflated piece by piece, its header parsed, its block framed by
Content-Length and checked against the digests in the header. Neither a file nor a record has to
fit into memory. A file counts only when the manifest, which Spark commits, names it: what a lost or
repeated task leaves behind is never read.
"""

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from podium.llm.common import filesystem, in_tasks, mapped, stored, utf8
from podium.session import scratch

CHUNK = 1 << 16
FILE_BYTES = 1 << 30
HTTP = "application/http;msgtype=response"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = (
    "record_id string, record_type string, url string, refers_to string, payload_bytes long, "
    "payload_digest string, path string, offset long, length long"
)
MANIFEST = "path string, records long, bytes long"


# --- writing -------------------------------------------------------------------------------


def _plain(value):
    """A header value without line breaks or other controls."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(record_id, url, payload, payload_bytes, digest, refers_to, date):
    """The bytes of one record. With ``refers_to`` it is a revisit, which holds no payload."""
    block = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {payload_bytes}\r\n\r\n"
    ).encode()
    if refers_to is None:
        block += payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{record_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": _plain(url or ""),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": SAME_PAYLOAD}
    head |= {"Content-Type": HTTP, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _member(data, level):
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _writer(folder, date, level, file_bytes):
    def write(batches):
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        out, name, records, size = None, None, 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pylist([{"path": name, "records": records, "bytes": size}])

        for batch in batches:
            names = batch.schema.names
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(names, row, strict=True))
                if out is None:
                    name, records, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    place = f"{base}/{name.rpartition('/')[2]}"
                    out = store.open_output_stream(place, compression=None)
                data = _member(
                    record(
                        row["record_id"], row["url"], utf8(row["payload"]), row["payload_bytes"],
                        row["payload_digest"], row["refers_to"], date,
                    ),
                    level,
                )
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return write


def write(records, folder, date="1970-01-01T00:00:00Z", level=3, file_bytes=FILE_BYTES):
    """Write ``records`` as archives of about ``file_bytes`` under ``folder``; return the manifest.

    Columns: record_id, url, payload (text), payload_bytes, payload_digest (SHA-256 in hex) and
    refers_to (record id, null for a response).
    """
    rows = mapped(records, _writer(folder, date, level, file_bytes), MANIFEST)
    return stored(rows, "manifest")


# --- reading -------------------------------------------------------------------------------


class Bad(ValueError):
    """An archive that breaks the format or does not have the digest it names."""


class _Members:
    """The inflated bytes of a stream of gzip members, a bounded piece at a time."""

    def __init__(self, stream, chunk=CHUNK):
        self.stream, self.chunk = stream, chunk
        self.data, self.used = stream.read(chunk), 0

    def __iter__(self):
        """(offset of the member, iterator over its pieces); take the pieces before the next."""
        while self.data:
            yield self.used, self._pieces()

    def _pieces(self):
        inflate = zlib.decompressobj(31)
        while True:
            before = len(self.data)
            try:
                piece = inflate.decompress(self.data, self.chunk)
            except zlib.error as error:
                raise Bad(f"broken gzip member: {error}") from None
            self.data = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            self.used += before - len(self.data)
            if piece:
                yield piece
            if not self.data:
                self.data = self.stream.read(self.chunk)
                if not self.data and not inflate.eof:
                    raise Bad("the last gzip member is cut off")
            if inflate.eof:
                return


def _head(pieces, end, limit=1 << 20):
    """Split the stream after the first ``end``: (what stands before it, rest of the piece)."""
    data = bytearray()
    for piece in pieces:
        data += piece
        if (at := data.find(end)) >= 0:
            return bytes(data[:at]), bytes(data[at + len(end):])
        if len(data) > limit:
            break
    raise Bad("a header without end")


def _fields(head):
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = (line.partition(":") for line in lines)
    return first, {k.strip().lower(): v.strip() for k, _, v in pairs}


def _digest(fields, name):
    kind, _, value = fields.get(name, "").partition(":")
    return value if kind == "sha256" else None


def _framed(pieces, rest, length):
    """Exactly ``length`` bytes, then the two line ends that close a record."""
    left = length
    for piece in _chain(rest, pieces):
        if left > 0:
            yield piece[:left]
        tail = piece[max(left, 0):] if left < len(piece) else b""
        left -= len(piece)
        if left < 0 and tail.strip(b"\r\n"):
            raise Bad("bytes after the end of a record")
    if left != -4:
        raise Bad("a record that does not end where its Content-Length says")


def _chain(first, rest):
    if first:
        yield first
    yield from rest


def read_archive(stream, chunk=CHUNK):
    """A dict for each record of one archive, with the digests verified."""
    members = _Members(stream, chunk)
    for offset, pieces in members:
        head, rest = _head(pieces, b"\r\n\r\n")
        version, fields = _fields(head)
        if not version.startswith("WARC/") or not fields.get("content-length", "").isdigit():
            raise Bad("not a WARC record")
        block, payload = hashlib.sha256(), hashlib.sha256()
        size, inner, opening = 0, None, bytearray()
        for piece in _framed(pieces, rest, int(fields["content-length"])):
            block.update(piece)
            if inner is None:
                opening += piece
                if (at := opening.find(b"\r\n\r\n")) < 0:
                    continue
                inner = _fields(bytes(opening[:at]))[1]
                piece = bytes(opening[at + 4:])
            payload.update(piece)
            size += len(piece)
        named = _digest(fields, "warc-payload-digest")
        if _digest(fields, "warc-block-digest") not in (None, block.hexdigest()):
            raise Bad(f"block digest differs at byte {offset}")
        kind = fields.get("warc-type")
        if kind == "response" and named not in (None, payload.hexdigest()):
            raise Bad(f"payload digest differs at byte {offset}")
        stands = (inner or {}).get("content-length", "")
        if kind == "response" and stands.isdigit() and int(stands) != size:
            raise Bad(f"payload of {size} bytes, {stands} named, at byte {offset}")
        yield {
            "record_id": fields.get("warc-record-id", "").strip("<>"),
            "record_type": kind,
            "url": fields.get("warc-target-uri"),
            "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
            "payload_bytes": size if kind == "response" else int(stands or 0),
            "payload_digest": payload.hexdigest() if kind == "response" else named,
            "offset": offset,
            "length": members.used - offset,
        }


def _reader(chunk, batch_rows):
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], RECORD_SCHEMA)

    def read(batches):
        rows = []
        for files in batches:
            for path in files.column("path").to_pylist():
                store, place = filesystem(path)
                with store.open_input_stream(place, compression=None) as stream:
                    for row in read_archive(stream, chunk):
                        rows.append(row | {"path": path})
                        if len(rows) == batch_rows:
                            yield batch(rows)
                            rows = []
        if rows:
            yield batch(rows)

    return read


RECORD_SCHEMA = pa.schema(
    [
        (f.split()[0], pa.int64() if f.endswith("long") else pa.string())
        for f in RECORDS.split(", ")
    ]
)


def read(manifest, chunk=CHUNK, batch_rows=4096):
    """Read the archives a manifest names, one file per task: a row per record.

    A file that is cut off, badly framed or does not match a digest stops the job with ``Bad``.
    """
    return mapped(in_tasks(manifest.select("path")), _reader(chunk, batch_rows), RECORDS)


# --- pages ---------------------------------------------------------------------------------


def page_records(pages, least=100):
    """The records of ``pages`` (page_id, url, html), payload the UTF-8 html (null: empty).

    Of equal payloads of at least ``least`` bytes the smallest page_id is the response and the
    others revisit it. Rows that repeat the smallest page_id are responses too. Rows without
    page_id refer to the response if there is one. An empty table gives no records.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        "page_id",
        "url",
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
    )
    signs = rows.filter(F.col("payload_bytes") >= least).select("page_id", "payload_digest")
    firsts = signs.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"))
    # Only narrow rows meet on the digest, which may be shared by a third of all pages; the html
    # is joined by page.
    revisits = (
        signs.distinct()
        .join(firsts, "payload_digest")
        .filter(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull())
        .select(
            F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), "refers_to"
        )
    )
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest"))
    known = rows.join(revisits, same, "left")
    return known.select(
        page_urn(F.col("page_id")).alias("record_id"),
        "url",
        F.when(F.col("_digest").isNull(), F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.when(F.col("refers_to").isNotNull(), page_urn(F.col("refers_to"))).alias("refers_to"),
    )


def page_urn(page_id):
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")))


def page_of(urn):
    return F.expr(f"try_cast(substring({urn}, 10) as bigint)")


def archived_pages(pages, folder=None):
    """Write a record per page, read the archives back, and return a row per record."""
    folder = folder or scratch(pages.sparkSession, "warc")
    records = read(write(page_records(pages), folder))
    return records.select(
        page_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_of("refers_to").alias("refers_to"),
    )
