"""Hierarchical packing of documents into windows of several lengths.

Every partition packs its own documents, in one pass and without a shuffle. From each document the full windows of the
longest tier are cut; the rest is routed to the smallest tier that holds it. When the waiting rests pass POOL tokens,
the tiers are packed from the longest to the shortest: each rest opens a window of its tier, and the gap behind it is
filled from the shorter tiers, first by the largest rests that fit whole, then by the front part of one that is cut. So
windows are full, their lengths are the tiers, and little is cut. What is left at the end of a partition, less than one
window, is cut into windows whose lengths are powers of two, which need no padding.

Step groups take windows of one tier until they hold STEP_TOKENS, so all full groups have the same number of tokens,
whatever their tier.

Cases: a null or empty text is its end id alone; equal doc_ids are packed as the separate rows that they are; a null
doc_id stays null; a text of any length is taken whole and cut into as many windows as it fills; rests of equal length are
told apart by the order in which they came; repeated rows are documents of their own; other columns are never read; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import codec
from .common import give_back, steps, strings

TIERS = (512, 1024, 2048, 4096)
#: Tokens that wait in a task before they are packed.
POOL = 1 << 20
STEP_TOKENS = 16 * 4096
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Rest:
    """Ids of a document from `start` on that aren't packed yet."""

    __slots__ = ("doc_id", "ids", "start", "total")

    def __init__(self, doc_id, start: int, ids: bytes, total: int):
        self.doc_id, self.start, self.ids, self.total = doc_id, start, ids, total

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> Rest:
        """The first n ids; the others remain."""
        front = Rest(self.doc_id, self.start, self.ids[: 4 * n], self.total)
        self.start, self.ids = self.start + n, self.ids[4 * n :]
        return front


class Packer:
    """add() documents, then take rows from `done`; finish() packs what waits."""

    def __init__(self, base: int, tiers: tuple[int, ...] = TIERS, pool: int = POOL, step_tokens: int = STEP_TOKENS):
        self.tiers, self.pool, self.step, self.base = sorted(tiers), pool, step_tokens, base
        self.waiting: list[list[tuple[int, int, Rest]]] = [[] for _ in self.tiers]  # sorted by length, then arrival
        self.held = self.number = self.arrived = 0
        self.groups: dict[int, tuple[int, int]] = {}  # by tier: the open group and its tokens
        self.group_count = 0
        self.done: list[tuple] = []

    def route(self, rest: Rest) -> None:
        if n := len(rest):
            self.arrived += 1
            tier = next(k for k, size in enumerate(self.tiers) if n <= size)
            insort(self.waiting[tier], (n, self.arrived, rest))
            self.held += n

    def add(self, doc_id, ids: bytes) -> None:
        rest, most = Rest(doc_id, 0, ids, len(ids) // 4), self.tiers[-1]
        while len(rest) >= most:
            self.emit([rest.cut(most)])
        self.route(rest)
        if self.held > self.pool:
            self.pack()

    def emit(self, pieces: list[Rest]) -> None:
        """A window of these pieces."""
        tokens = sum(map(len, pieces))
        group, used = self.groups.get(tokens, (-1, self.step))
        if used + tokens > self.step:
            group, used = self.group_count, 0
            self.group_count += 1
        self.groups[tokens] = (group, used + tokens)
        at = 0
        for p in pieces:
            self.done.append((p.doc_id, p.start, len(p), p.ids, p.total, self.base + self.number, at, tokens, self.base + group))
            at += len(p)
        self.number += 1

    def fill(self, pieces: list[Rest], gap: int, tier: int) -> int:
        """Takes rests of the tiers up to `tier` into the gap; what stays open."""
        for k in range(tier, -1, -1):
            shelf = self.waiting[k]
            while gap and (i := bisect_right(shelf, (gap, float("inf")))):
                n, _, rest = shelf.pop(i - 1)
                pieces.append(rest)
                gap, self.held = gap - n, self.held - n
        for k in range(tier + 1):
            if gap and self.waiting[k]:  # all are longer than the gap: the longest of the shortest tier is cut
                n, _, rest = self.waiting[k].pop()
                self.held -= n
                pieces.append(rest.cut(gap))
                self.route(rest)
                return 0
        return gap

    def pack(self, last: bool = False) -> None:
        for k in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[k]
            while self.waiting[k]:
                n, _, rest = self.waiting[k].pop()
                self.held -= n
                pieces = [rest]
                if gap := self.fill(pieces, size - n, k):
                    self.leave(pieces, last)
                    if not last:
                        return  # too little waits to fill a window; later documents may
                else:
                    self.emit(pieces)
        if last and self.held:
            self.pack(last)

    def leave(self, pieces: list[Rest], last: bool) -> None:
        if not last:
            for p in pieces:
                self.route(p)
            return
        left = sum(map(len, pieces))
        while left:  # windows of 2**k tokens, the longest first
            size = 1 << (left.bit_length() - 1)
            window, need = [], size
            while need:
                p = pieces[0]
                if len(p) <= need:
                    window.append(pieces.pop(0))
                else:
                    window.append(p.cut(need))
                need -= len(window[-1])
            self.emit(window)
            left -= size


def _rows(rows: list[tuple], whole: bool) -> pa.RecordBatch:
    doc_id, start, length, ids, total, sequence, offset, tier, group = zip(*rows, strict=True)
    long = lambda x: pa.array(x, pa.int64())
    columns = [long(doc_id), long(start), long(length), long([zlib.crc32(x) for x in ids]), long(total), long(sequence), long(offset), pa.array(tier, pa.int32()), long(group)]
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    if whole:
        offsets = np.append(0, np.cumsum(length)).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))))
        names.append("ids")
    return pa.record_batch(columns, names=names)


def _pack(batches: Iterable[pa.RecordBatch], path: str, end_id: int, whole: bool, tiers: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    encode, end = codec(path).encode, np.uint32(end_id).tobytes()
    packer = Packer(TaskContext.get().partitionId() << 40, tiers)
    for b in steps(batches, limit=1 << 20):
        for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode(strings(b.column("text"))), strict=True):
            packer.add(doc_id, ids + end)
        if packer.done:
            yield _rows(packer.done, whole)
            packer.done = []
    packer.pack(last=True)
    if packer.done:
        yield _rows(packer.done, whole)
    if whole:  # the last of several stages; packing alone keeps its pieces from task to task
        packer.done = []
        codec(path).forget()
        give_back()


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, whole: bool = True, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """A row for each piece of a document: its place in the document, its window, its place there, the window's length
    (tier), and its step group; `whole` adds the ids. The tiers are powers of two."""
    columns = COLUMNS + (", ids array<int>" if whole else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_pack, path=path, end_id=end_id, whole=whole, tiers=tuple(tiers)), columns)
