"""Token ids in files of independent zstandard frames.

A file is a run of frames, each holding ``FRAME_IDS`` ids (the last fewer) of the file's documents one after the other, then
skippable frames, then a seek table in zstandard's public seekable format: for each frame its compressed size, its content
size (0 for skippable ones) and the low 32 bits of its content's XXH64; then the number of frames, a descriptor byte (128:
checksums are there) and the magic number. Any reader of that format sees the ids, and nothing else, as the content. Ids
take two bytes where the vocabulary allows, else four; an id that doesn't fit is an error.

The skippable frames hold the document index: pages of up to ``PAGE`` document ids and end positions (64 bits each), zstandard
frames with checksums themselves, and last a directory of the pages (first and last document id, first position, documents).
A reader reads the tail, the directory, the pages that may hold a document, and then only the frames that do, checking
each frame's checksum.

Files are written to a temporary name and renamed, so a task that runs again replaces its own file with the same bytes.
Documents are dealt by range of doc_id and written in ascending order, equal ids by text; a null id comes first and is
written as the smallest 64-bit integer, which reads back as null. Null text is empty, further columns are ignored. An empty
table makes no files.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import slices
from .runtime import columns_named, new_path
from .tokens import encoder

FRAME_IDS, PAGE = 1 << 18, 1 << 16
#: Fixed values of zstandard's seekable format, and the kinds of the two skippable frames used here.
_SEEK_FRAME, _SEEK_MAGIC, _CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 128
_PAGE_FRAME, _DIRECTORY_FRAME = 0x184D2A50, 0x184D2A51
_HEAD, _ENTRY, _FOOTER = struct.Struct("<II"), struct.Struct("<III"), struct.Struct("<IBI")
#: The directory: id frames and bytes of an id, then first id, last id, first position, documents of each page.
_SIZES, _PAGE_ENTRY = struct.Struct("<QI"), struct.Struct("<qqQI")
_NULL_ID = -(1 << 63)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path."""
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else path.replace("file:", "file://", 1))


class Writer:
    """Writes one file; holds one frame of ids and the index."""

    def __init__(self, out, id_bytes: int, level: int = 3):
        self.out, self.dtype = out, np.dtype(f"<u{id_bytes}")
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.pending: list[np.ndarray] = []
        self.held = self.total = 0
        self.entries: list[tuple[int, int, int]] = []
        self.doc_ids: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []

    def _frame(self, data: bytes) -> None:
        packed = self.pack.compress(data)
        self.out.write(packed)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def _skippable(self, kind: int, data: bytes) -> None:
        self.out.write(_HEAD.pack(kind, len(data)) + data)
        self.entries.append((_HEAD.size + len(data), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        """Documents, ascending, with their ids one after the other; ends: each one's end in ids."""
        if len(ids) and (int(ids.max()) > np.iinfo(self.dtype).max or int(ids.min()) < 0):
            raise ValueError(f"an id does not fit into {self.dtype.itemsize} bytes")
        self.doc_ids.append(np.asarray(doc_ids, "<i8"))
        self.ends.append((np.asarray(ends) + self.total).astype("<u8"))
        self.total += len(ids)
        self.pending.append(ids.astype(self.dtype))
        self.held += len(ids)
        if self.held >= FRAME_IDS:
            every = np.concatenate(self.pending)
            whole = len(every) // FRAME_IDS * FRAME_IDS
            for lo in range(0, whole, FRAME_IDS):
                self._frame(every[lo : lo + FRAME_IDS].tobytes())
            self.pending, self.held = [every[whole:]], len(every) - whole

    def close(self) -> int:
        """Writes the rest; returns the number of ids."""
        if self.held:
            self._frame(np.concatenate(self.pending).tobytes())
        directory = _SIZES.pack(len(self.entries), self.dtype.itemsize)
        docs = np.concatenate(self.doc_ids) if self.doc_ids else np.zeros(0, "<i8")
        ends = np.concatenate(self.ends) if self.ends else np.zeros(0, "<u8")
        for lo in range(0, len(docs), PAGE):
            own = docs[lo : lo + PAGE]
            self._skippable(_PAGE_FRAME, self.pack.compress(own.tobytes() + ends[lo : lo + PAGE].tobytes()))
            directory += _PAGE_ENTRY.pack(int(own[0]), int(own[-1]), int(ends[lo - 1]) if lo else 0, len(own))
        self._skippable(_DIRECTORY_FRAME, directory)
        body = b"".join(_ENTRY.pack(*e) for e in self.entries) + _FOOTER.pack(len(self.entries), _CHECKSUMS, _SEEK_MAGIC)
        self.out.write(_HEAD.pack(_SEEK_FRAME, len(body)) + body)
        return self.total


class Reader:
    """Reads one file's documents; reads only index pages and frames that hold them."""

    def __init__(self, file):
        self.file, size = file, file.size()
        file.seek(size - _FOOTER.size)
        n, kind, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != _SEEK_MAGIC or kind != _CHECKSUMS:
            raise ValueError("not a token file")
        file.seek(size - _FOOTER.size - n * _ENTRY.size)
        self.entries = list(_ENTRY.iter_unpack(file.read(n * _ENTRY.size)))
        self.at = np.concatenate([[0], np.cumsum([e[0] for e in self.entries], dtype=np.int64)])
        self.unpack = zstandard.ZstdDecompressor()
        kind, data = self._skipped(n - 1)
        if kind != _DIRECTORY_FRAME:
            raise ValueError("no document index")
        self.id_frames, id_bytes = _SIZES.unpack(data[: _SIZES.size])
        self.pages = list(_PAGE_ENTRY.iter_unpack(data[_SIZES.size :]))
        self.dtype = np.dtype(f"<u{id_bytes}")
        self.frames_read = self.pages_read = 0
        self._last: tuple[int, bytes] = (-1, b"")

    def _skipped(self, k: int) -> tuple[int, bytes]:
        self.file.seek(int(self.at[k]))
        kind, size = _HEAD.unpack(self.file.read(_HEAD.size))
        return kind, self.file.read(size)

    def _frame(self, k: int) -> bytes:
        packed, size, check = self.entries[k]
        self.file.seek(int(self.at[k]))
        data = self.unpack.decompress(self.file.read(packed), max_output_size=size)
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} does not match its checksum")
        self.frames_read += 1
        return data

    def page(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document ids, starts and ends of an index page."""
        kind, data = self._skipped(self.id_frames + k)
        n = self.pages[k][3]
        data = self.unpack.decompress(data, max_output_size=16 * n)
        if kind != _PAGE_FRAME or len(data) != 16 * n:
            raise ValueError(f"index page {k} is not whole")
        self.pages_read += 1
        ends = np.frombuffer(data[8 * n :], "<u8").astype(np.int64)
        return np.frombuffer(data[: 8 * n], "<i8"), np.concatenate([[self.pages[k][2]], ends[:-1]]), ends

    def ids(self, start: int, end: int) -> np.ndarray:
        """The file's ids from ``start`` to before ``end``."""
        parts = []
        for k in range(start // FRAME_IDS, -(-end // FRAME_IDS) if end > start else 0):
            if self._last[0] != k:
                self._last = (k, self._frame(k))
            lo = k * FRAME_IDS
            parts.append(np.frombuffer(self._last[1], self.dtype)[max(0, start - lo) : end - lo])
        return np.concatenate(parts) if parts else np.zeros(0, self.dtype)

    def documents(self, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
        """Id, start and end of all documents or of those whose ids, sorted, are wanted."""
        for k, (first, last, _, _) in enumerate(self.pages):
            if wanted is None or np.searchsorted(wanted, first) < np.searchsorted(wanted, last, side="right"):
                docs, starts, ends = self.page(k)
                at = np.arange(len(docs)) if wanted is None else np.flatnonzero(np.isin(docs, wanted))
                yield from zip(docs[at].tolist(), starts[at].tolist(), ends[at].tolist())

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document with this id."""
        return [self.ids(a, b) for _, a, b in self.documents(np.array([doc_id]))]


def write(docs: DataFrame, path: str, tokenizer_path: str, vocabulary: int, end_id: int = 0, files: int | None = None,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and writes every text; one row a file: part, file, n_docs, n_tokens, first_id, last_id. Lazy: an action on it writes the files."""
    id_bytes = 2 if vocabulary <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        writer, docs_seen, least, most = None, 0, 0, 0
        enc = encoder(tokenizer_path, True)
        where, folder = filesystem(path)
        temporary = f"{folder}/_part-{part:06d}-{TaskContext.get().taskAttemptId()}"
        name = f"part-{part:06d}.tok"
        for batch in batches:
            doc_ids = batch.column(0).cast(pa.int64()).fill_null(_NULL_ID).to_numpy()
            for lo, hi, buf, off in slices(batch.column(1)):
                if writer is None:
                    where.create_dir(folder, recursive=True)
                    out = where.open_output_stream(temporary, compression=None)
                    writer, least = Writer(out, id_bytes), int(doc_ids[lo])
                ids, cuts = enc.encode(buf, off)
                ids = np.insert(ids, cuts[1:], end_id)
                writer.add(doc_ids[lo:hi], ids, cuts[1:] + np.arange(1, hi - lo + 1))
                docs_seen, most = docs_seen + hi - lo, int(doc_ids[hi - 1])
        if writer is not None:
            total = writer.close()
            out.close()
            where.move(temporary, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), *(pa.array([x], pa.int64()) for x in (docs_seen, total, least, most))], ["part", "file", "n_docs", "n_tokens", "first_id", "last_id"])

    rows = columns_named(docs, id_col, text_col)
    n = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, F.col(f"`{id_col}`").asc_nulls_first()).sortWithinPartitions(F.col(f"`{id_col}`").asc_nulls_first(), F.col(f"`{text_col}`").asc_nulls_first())
    return dealt.mapInArrow(run, "part int, file string, n_docs long, n_tokens long, first_id long, last_id long")


def read(spark: SparkSession, path: str, written: list, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32 bits), ids_crc32 of files that ``write`` listed.

    start counts the ids of all files before. doc_ids: read only these documents' frames.
    """
    wanted = None if doc_ids is None else np.array(sorted({int(x) for x in doc_ids}), dtype=np.int64)
    rows, start = [], 0
    for r in sorted(written, key=lambda r: r["part"]):
        if wanted is None or np.searchsorted(wanted, r["first_id"]) < np.searchsorted(wanted, r["last_id"], side="right"):
            rows.append((r["file"], start))
        start += r["n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = filesystem(path)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with where.open_input_file(f"{folder}/{name}") as file:
                    yield from _documents(Reader(file), wanted, first)

    files = spark.createDataFrame(rows, "file string, start long")
    if rows:
        files = files.repartition(min(len(rows), 512))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _documents(reader: Reader, wanted: np.ndarray | None, first: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    rows, size = [], 0
    for doc, start, end in reader.documents(wanted):
        data = reader.ids(start, end).astype("<u4").tobytes()
        rows.append((None if doc == _NULL_ID else doc, first + start, len(data) // 4, zlib.crc32(data), data))
        size += len(data)
        if size > 1 << 22:
            yield _batch(rows, names)
            rows, size = [], 0
    if rows:
        yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names)


def to_bytes(documents: list[tuple[int, list[int]]], id_bytes: int = 4) -> bytes:
    """A file's bytes for documents in memory (for small uses and tests)."""
    out = io.BytesIO()
    writer = Writer(out, id_bytes)
    for doc, ids in documents:
        writer.add(np.array([doc]), np.array(ids, dtype=np.int64), np.array([len(ids)]))
    writer.close()
    return out.getvalue()
