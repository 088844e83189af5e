"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a run of frames of at most ``FRAME_IDS`` little-endian uint32 ids, a skippable frame with
the directory of its documents, and a skippable frame with the seek table: size packed, size
unpacked and checksum (low 32 bits of XXH64) of every frame. That is the public seekable format,
which any zstandard reader can also read from front to back. Frames know nothing of documents: a
long one runs over several, and a reader unpacks the frames its ids are in and no others.

Files count only if the manifest, which Spark commits, names them; what a lost or repeated task
leaves behind is never read.
"""

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from podium.llm.common import filesystem, in_tasks, mapped, stored
from podium.llm.tokens import encoder
from podium.session import scratch

FRAME_IDS = 1 << 16
FILE_IDS = 1 << 28
LEVEL = 3

# Fixed values of the seekable zstandard format.
SKIPPABLE_DIRECTORY = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80

MANIFEST = "path string, partition long, part long, documents long, ids long, bytes long"


def checksum(data):
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def _skippable(magic, data):
    return struct.pack("<II", magic, len(data)) + data


class Writer:
    """Writes one file to a binary stream: add() documents, then close()."""

    def __init__(self, out, frame_ids=FRAME_IDS, level=LEVEL):
        self.out, self.frame_bytes = out, frame_ids * 4
        self.packer = zstandard.ZstdCompressor(level=level)
        self.held, self.entries, self.size = bytearray(), [], 0
        self.doc_ids, self.counts = [], []

    def add(self, doc_id, ids):
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.held += ids.astype("<u4").tobytes()
        while len(self.held) >= self.frame_bytes:
            self._frame(bytes(self.held[: self.frame_bytes]))
            del self.held[: self.frame_bytes]

    def _frame(self, data):
        self._put(self.packer.compress(data), len(data), checksum(data))

    def _put(self, packed, size, check):
        self.out.write(packed)
        self.entries.append((len(packed), size, check))
        self.size += len(packed)

    def close(self):
        if self.held:
            self._frame(bytes(self.held))
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        names = np.array([0 if d is None else d for d in self.doc_ids], "<i8")
        counts = np.array(self.counts, "<i8")
        listed = struct.pack("<Q", len(counts)) + known.tobytes() + names.tobytes() + counts.tobytes()
        data = self.packer.compress(listed)
        packed = _skippable(SKIPPABLE_DIRECTORY, data)
        self._put(packed, 0, checksum(b""))
        table = b"".join(struct.pack("<III", *entry) for entry in self.entries)
        table += struct.pack("<IBI", len(self.entries), WITH_CHECKSUMS, SEEK_MAGIC)
        packed = _skippable(SKIPPABLE_SEEK_TABLE, table)
        self.out.write(packed)
        self.size += len(packed)
        self.out.close()


class Bad(ValueError):
    """A file that breaks the format or whose frame does not match its checksum."""


class Reader:
    """Random access to the documents of one file (a seekable binary stream)."""

    def __init__(self, file, size):
        self.file = file
        tail = self._at(size - 9, 9)
        count, flags, magic = struct.unpack("<IBI", tail)
        if magic != SEEK_MAGIC or flags != WITH_CHECKSUMS:
            raise Bad("no seek table")
        start = size - 9 - 12 * count
        head = struct.unpack("<II", self._at(start - 8, 8))
        if head != (SKIPPABLE_SEEK_TABLE, 12 * count + 9):
            raise Bad("a broken seek table")
        table = np.frombuffer(self._at(start, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.places = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.bounds = np.concatenate(([0], np.cumsum(table[:-1, 1]))) // 4
        self.checks = table[:, 2]
        if not count or self.checks[-1] != checksum(b""):
            raise Bad("a seek table without the directory")
        if self.places[-1] != start - 8:
            raise Bad("a seek table that does not cover its file")
        self._directory()

    def _at(self, place, size):
        self.file.seek(place)
        return self.file.read(size)

    def _directory(self):
        data = self._at(int(self.places[-2]), int(self.places[-1] - self.places[-2]))
        magic, size = struct.unpack_from("<II", data)
        if magic != SKIPPABLE_DIRECTORY or size != len(data) - 8:
            raise Bad("no directory")
        listed = zstandard.ZstdDecompressor().decompress(data[8:])
        (n,) = struct.unpack_from("<Q", listed)
        known = np.frombuffer(listed, np.uint8, n, 8)
        names = np.frombuffer(listed, "<i8", n, 8 + n)
        self.counts = np.frombuffer(listed, "<i8", n, 8 + 9 * n)
        self.doc_ids = [int(d) if k else None for k, d in zip(known, names, strict=True)]
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))
        if self.starts[-1] != self.bounds[-1]:
            raise Bad("a directory that does not cover its file")

    def frame(self, number):
        """The unpacked bytes of one frame, checked."""
        place = int(self.places[number])
        packed = self._at(place, int(self.places[number + 1]) - place)
        size = int(self.bounds[number + 1] - self.bounds[number]) * 4
        data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=size)
        if len(data) != size or checksum(data) != self.checks[number]:
            raise Bad(f"checksum of frame {number} differs")
        return data

    def frames_of(self, document):
        """The numbers of the frames that a document's ids are in."""
        start, end = self.starts[document], self.starts[document + 1]
        first = np.searchsorted(self.bounds, start, "right") - 1
        return range(int(first), int(np.searchsorted(self.bounds, end, "left"))) if end > start else range(0)

    def pieces(self, document, frame):
        """The bytes of a document's ids, frame by frame; ``frame`` unpacks one."""
        start, end = int(self.starts[document]), int(self.starts[document + 1])
        for number in self.frames_of(document):
            at = int(self.bounds[number])
            yield frame(number)[max(0, start - at) * 4 : (end - at) * 4]

    def ids(self, document):
        return np.frombuffer(b"".join(self.pieces(document, self.frame)), "<u4")


# --- jobs ----------------------------------------------------------------------------------


def _writer(folder, tokenizer, end_id, file_ids, frame_ids):
    def write(batches):
        encode = encoder(tokenizer)
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        partition = TaskContext.get().partitionId()
        file, path, part, total = None, None, 0, 0

        def closed():
            file.close()
            row = {
                "path": path, "partition": partition, "part": part,
                "documents": len(file.counts), "ids": total, "bytes": file.size,
            }
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            docs = zip(
                batch.column("doc_id").to_pylist(),
                encode.batch(batch.column("text").to_pylist()),
                strict=True,
            )
            for doc_id, ids in docs:
                if file is None:
                    name = f"{partition:08d}-{part:04d}-{uuid.uuid4().hex}.ids.zst"
                    path, total = f"{folder}/{name}", 0
                    file = Writer(store.open_output_stream(f"{base}/{name}", compression=None), frame_ids)
                file.add(doc_id, np.append(ids, np.uint32(end_id)))
                total += len(ids) + 1
                if total >= file_ids:
                    yield closed()
                    file, part = None, part + 1
        if file is not None:
            yield closed()

    return write


def write(docs, folder, tokenizer, end_id, file_ids=FILE_IDS, frame_ids=FRAME_IDS):
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order; return the manifest.

    The rows are sorted by ranges of doc_id, so any number of tasks write at once and no range is
    large because a doc_id is repeated: rows that share one are ordered by a hash of their text.
    Files follow each other in the order of (partition, part).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    work = _writer(folder, tokenizer, end_id, file_ids, frame_ids)
    return stored(mapped(rows.drop("tie"), work, MANIFEST), "manifest")


def _starts(manifest):
    """The manifest with the ids in all files before each. One row per file."""
    before = Window.orderBy("partition", "part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _opened(path):
    store, place = filesystem(path)
    return store.open_input_file(place), store.get_file_info(place).size


def _read(batches):
    for files in batches:
        for path, first in zip(*(files.column(n).to_pylist() for n in ("path", "first")), strict=True):
            stream, size = _opened(path)
            with stream:
                reader = Reader(stream, size)
                last = (None, None)  # the frame unpacked last, which the next document may go on in

                def frame(number, reader=reader):
                    nonlocal last
                    if last[0] != number:
                        last = number, reader.frame(number)
                    return last[1]

                sums = []
                for document in range(len(reader.counts)):
                    crc = 0
                    for piece in reader.pieces(document, frame):
                        crc = zlib.crc32(piece, crc)
                    sums.append(crc)
            columns = [reader.doc_ids, first + reader.starts[:-1], reader.counts, sums]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read(manifest):
    """Read all files back, every frame checked: a row per document, ids only as their CRC.

    ``start`` counts the ids of all documents before it, over all files.
    """
    rows = in_tasks(_starts(manifest).select("path", "first"))
    return mapped(rows, _read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(manifest, wanted):
    """(doc_id, ids) of the documents in ``wanted`` (doc_id); only their frames are unpacked."""

    def directory(batches):
        for files in batches:
            for path in files.column("path").to_pylist():
                stream, size = _opened(path)
                with stream:
                    names = Reader(stream, size).doc_ids
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.int64()),
                        pa.array([path] * len(names)),
                        pa.array(range(len(names)), pa.int64()),
                    ],
                    ["doc_id", "path", "document"],
                )

    def unpack(batches):
        path, reader = None, None
        for rows in batches:
            found = []
            for row in rows.to_pylist():
                if row["path"] != path:
                    path = row["path"]
                    reader = Reader(*_opened(path))
                ids = reader.ids(row["document"]).astype(np.int32)
                found.append({"doc_id": row["doc_id"], "ids": ids})
            yield pa.RecordBatch.from_pylist(
                found, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
            )

    listed = mapped(
        in_tasks(manifest.select("path")), directory, "doc_id long, path string, document long"
    )
    places = listed.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    places = places.repartitionByRange("path", "document").sortWithinPartitions("path", "document")
    return mapped(places, unpack, "doc_id long, ids array<int>")


def round_trip(docs, tokenizer, end_id, folder=None):
    """Write ``docs`` (doc_id, text) and read them back: doc_id, start, n_tokens, ids_crc32.

    Null texts are empty and have the end id alone. Rows without doc_id come first, repeated rows
    stand side by side. An empty table gives no files and no rows.
    """
    folder = folder or scratch(docs.sparkSession, "tokens")
    return read(write(docs, folder, tokenizer, end_id))
