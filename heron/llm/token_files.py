"""Token-ID files of independent zstandard frames with a trailing seek table.

Layout of a file (all integers little-endian):

    frame*            zstandard frames, each on its own: ids as unsigned 32-bit integers, whole documents in ascending
                      doc_id order, about FRAME_BYTES before compression
    documents         a skippable frame (magic 0x184D2A50): zstandard of doc_id int64[n], then tokens uint32[n], frame
                      uint32[n], whose highest bit says that the doc_id is null
    seek table        a skippable frame (magic 0x184D2A5E) as in the seekable format: for each frame its compressed size,
                      its size and a checksum (low half of XXH64 of the ids), then the number of frames, a flag byte
                      (128: with checksums) and the magic 0x8F92EAB1; zstandard tools read the file as one stream

A document larger than a frame has a frame to itself. A reader takes the tail, finds the frames of the documents that
it wants, and decompresses and verifies only those.

The documents are dealt to partitions by ranges of doc_id; each partition writes one file under a temporary name and
renames it, so a task that is run again replaces it by the same bytes. The list of files, with the totals of their
tokens, is written as a table; prefix sums over it, one row a file, give each file's first token.

Cases: a null or empty text has the end id alone; equal doc_ids lie next to each other, in the order of a hash of their
texts, and may be dealt to several files; a null doc_id comes before all others and stays null; a text of any length is
taken whole; an empty table gives no files and an empty result; other columns are never read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .codec import codec
from .common import shared_dir, steps, strings, written

FRAME_BYTES = 1 << 20
#: Bytes of text that are encoded together: each distinct piece of a step is looked up once.
STEP = 8 << 20
DOCUMENTS, SEEK, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NULL_ID = 1 << 31
FILES = "file string, n_docs long, n_tokens long, first_doc long"


def _xxh(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class TokenFileWriter:
    def __init__(self, out, level: int = 1):
        import zstandard

        self.out, self.pack = out, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []
        self.held: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > FRAME_BYTES:
            self._frame()
        self.docs.append((doc_id or 0, len(ids) // 4, len(self.frames) | (NULL_ID if doc_id is None else 0)))
        self.held.append(ids)
        self.size += len(ids)

    def _frame(self) -> None:
        if self.size:
            data = b"".join(self.held)
            self.out.write(packed := self.pack.compress(data))
            self.frames.append((len(packed), len(data), _xxh(data)))
            self.held, self.size = [], 0

    def close(self) -> None:
        self._frame()
        d = np.array(self.docs, dtype=np.int64).reshape(-1, 3)
        body = self.pack.compress(d[:, 0].astype("<i8").tobytes() + d[:, 1].astype("<u4").tobytes() + d[:, 2].astype("<u4").tobytes())
        self.out.write(struct.pack("<II", DOCUMENTS, len(body)) + body)
        table = b"".join(struct.pack("<III", *x) for x in [*self.frames, (8 + len(body), 0, 0)])
        tail = table + struct.pack("<IBI", len(self.frames) + 1, 128, SEEK_END)
        self.out.write(struct.pack("<II", SEEK, len(tail)) + tail)


class TokenFileReader:
    """Random access to one file; `source` is a seekable file object."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        source.seek(0, 2)
        end = source.tell()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_END or flags != 128:
            raise ValueError("no seek table")
        table = np.frombuffer(self._at(end - 9 - 12 * n, 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        start = np.cumsum(table[:, 0]) - table[:, 0]
        self.start, self.table = start, table
        body = self.unpack.decompress(self._at(int(start[-1]) + 8, int(table[-1, 0]) - 8))
        k = len(body) // 16
        self.doc_id, self.tokens, self.frame = np.frombuffer(body, "<i8", k), np.frombuffer(body, "<u4", k, 8 * k).astype(np.int64), np.frombuffer(body, "<u4", k, 12 * k).astype(np.int64)
        self.null, self.frame = self.frame >= NULL_ID, self.frame & (NULL_ID - 1)
        self.first = np.cumsum(self.tokens) - self.tokens
        opens = np.searchsorted(self.frame, np.arange(n - 1))  # every frame has a document
        self.inside = self.first - self.first[opens][self.frame] if k else self.first

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def frame_ids(self, k: int) -> bytes:
        packed, size, check = self.table[k].tolist()
        data = self.unpack.decompress(self._at(int(self.start[k]), packed), max_output_size=size)
        if len(data) != size or _xxh(data) != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def read(self, rows: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, first token in the file, ids) of the documents in these rows of the index, all by default;
        a frame without one of them stays compressed."""
        held, data = -1, b""
        for r in range(len(self.doc_id)) if rows is None else sorted(rows):
            if self.frame[r] != held:
                held = int(self.frame[r])
                data = self.frame_ids(held)
            a = int(self.inside[r]) * 4
            yield None if self.null[r] else int(self.doc_id[r]), int(self.first[r]), data[a : a + 4 * int(self.tokens[r])]

    def find(self, doc_ids: Iterable[int]) -> list[int]:
        return np.flatnonzero(np.isin(self.doc_id, np.array(list(doc_ids), dtype=np.int64)) & ~self.null).tolist()


def _write(batches: Iterable[pa.RecordBatch], path: str, folder: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, end = codec(path).encode, np.uint32(end_id).tobytes()
    writer, n, tokens, first = None, 0, 0, 0
    for b in steps(batches, limit=STEP):
        if writer is None:
            files, root = pafs.FileSystem.from_uri(folder)
            files.create_dir(root, recursive=True)
            task = TaskContext.get()
            name = f"{root}/ids-{task.partitionId():06d}.zst"
            part = f"{name}.{task.taskAttemptId()}.tmp"
            out = files.open_output_stream(part)
            writer, first = TokenFileWriter(out), b.column("doc_id")[0].as_py()
        for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode(strings(b.column("text"))), strict=True):
            writer.add(doc_id, ids + end)
            n, tokens = n + 1, tokens + len(ids) // 4 + 1
    if writer:
        writer.close()
        out.close()
        files.move(part, name)
        yield pa.record_batch([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([n]), pa.array([tokens]), pa.array([first], pa.int64())], names=["file", "n_docs", "n_tokens", "first_doc"])


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 0) -> DataFrame:
    """Writes the files into `folder`, a path that all executors share. Returns their list, ready to be used any
    number of times: file, n_docs, n_tokens, first_doc."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_place"))
    order = ["doc_id", "_h", "_place"]  # so that rows of one id are no single task's
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(dealt.mapInArrow(partial(_write, path=path, folder=folder, end_id=end_id), FILES), "files")


def _read(batches: Iterable[pa.RecordBatch], only: frozenset | None, whole: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
            files, name = pafs.FileSystem.from_uri(uri)
            with files.open_input_file(name) as f:
                reader = TokenFileReader(f)
                docs, start, n, last = [], [], [], []
                for doc_id, first, ids in reader.read(None if only is None else reader.find(only)):
                    docs.append(doc_id)
                    start.append(base + first)
                    n.append(len(ids) // 4)
                    last.append(np.frombuffer(ids, "<u4").tolist() if whole else zlib.crc32(ids))
                    if len(docs) >= 4096:
                        yield _rows(docs, start, n, last, whole)
                        docs, start, n, last = [], [], [], []
                if docs:
                    yield _rows(docs, start, n, last, whole)


def _rows(docs: list, start: list, n: list, last: list, whole: bool) -> pa.RecordBatch:
    return pa.record_batch([pa.array(docs, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(last, pa.list_(pa.int64()) if whole else pa.int64())], names=["doc_id", "start", "n_tokens", "ids" if whole else "ids_crc32"])


def read_token_files(files: DataFrame, doc_ids: list[int] | None = None, whole: bool = True) -> DataFrame:
    """The documents of these files, or those with the given doc_ids: doc_id, start (the ids of all documents before
    it, over all files), n_tokens, and the ids (whole) or ids_crc32."""
    before = Window.orderBy(F.length("file"), "file").rowsBetween(Window.unboundedPreceding, -1)  # numbered in order
    # The sums run over a row a file.
    based = files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("file", "base").repartition(max(1, files.count()))
    kind = "ids array<long>" if whole else "ids_crc32 long"
    return based.mapInArrow(partial(_read, only=None if doc_ids is None else frozenset(doc_ids), whole=whole), f"doc_id long, start long, n_tokens long, {kind}")


def token_file_digests(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Every document's place and CRC-32, from files written to the shared folder and read back."""
    files = write_token_files(docs, path, shared_dir(docs.sparkSession, "ids"), end_id)
    return read_token_files(files, whole=False)
