"""Substring dedup: passages of WINDOW words that start in an earlier document too are removed.

Shards by content. The anchor of a window is the word 4-gram of least hash in it, so equal windows have equal anchors;
consecutive windows of one anchor make a segment, about 18 words. A first pass finds the anchors that more than one
document has (each batch sends an anchor once: a common one is known for shared there and then); only segments of
those can repeat. Their distinct texts, with the least document of each, are dealt by anchor to shards.

Each shard builds FM-indexes (wavelet matrix over word numbers) of up to INDEX_WORDS words, cut between anchors, and
streams all windows of its segments through backward search; a window with one place left is no repeat, so most stop after
a few words. The intervals of those that match in full give the least document that has the window. The segments of an
anchor of more than HOT documents (a line before ever other texts) would be one task's group, so they are summed up by
segment and then by single window (a 128-bit hash), with partial sums before each shuffle: the least document of a window
needs no index then. The answers are joined to the segments' places and, by document, to the texts.

Only the least doc_id counts: a window is removed where its document's id is larger. All windows are judged on the input.

Cases: a null or empty text, or one of fewer than WINDOW words, loses nothing; a text of any length is taken whole, as a
step of its own; documents without an id neither lose words nor count as earlier; rows of the same doc_id don't count as
earlier to each other; repeated rows and ties: the least id keeps the passage, rows of that id all do; an empty table
gives an empty result; other columns are carried by remove_repeats and otherwise never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, steps, utf8, written
from .fm_index import FmIndex
from .xxh import xxh64

WINDOW = 13
ANCHOR = 4
#: Words of one index.
INDEX_WORDS = 1 << 19
#: Documents of one anchor whose segments go to one index.
HOT = 20_000
#: Hot anchors (of 8 bytes) that are broadcast at most; HOT is doubled until they are as few.
BROADCAST = 500_000
#: Tasks that answer one window of hot anchors.
SALTS = 32
_BLOCK = 1 << 21
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Windows:
    """The words of some texts and the segments of their windows."""

    def __init__(self, texts: list[bytes], window: int):
        split = [b" ".join(t.split()) for t in texts]
        self.n = np.array([s.count(b" ") + 1 if s else 0 for s in split], np.int64)
        self.data = b"\n".join(s for s in split if s) + b"\n"
        chars = np.frombuffer(self.data, np.uint8)
        self.end = np.flatnonzero((chars == 32) | (chars == 10)) if self.n.any() else np.zeros(0, np.int64)
        self.begin = np.append(0, self.end[:-1] + 1) if len(self.end) else self.end
        self.first = np.cumsum(self.n) - self.n
        words = len(self.end)
        empty = np.zeros(0, np.int64)
        self.start = self.doc = self.count = empty
        self.anchor = empty.astype(np.uint64)
        if words < window:
            return
        h = xxh64(self.data, self.begin, self.end - self.begin, 7)
        g = np.zeros(words - ANCHOR + 1, np.uint64)
        for j in range(ANCHOR):
            g = (g ^ h[j : len(g) + j]) * _MIX
            g ^= g >> np.uint64(29)
        m = np.maximum(self.n - window + 1, 0)  # windows by text
        doc = np.repeat(np.arange(len(texts)), m)
        at = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(self.first, m)
        if not len(at):
            return
        least = np.empty(words - window + 1, np.int64)
        span = window - ANCHOR + 1
        for s in range(0, len(least), _BLOCK):  # the place in the low bits: the leftmost of equal ones
            part = g[s : s + _BLOCK + span - 1]
            key = (part >> np.uint64(22) << np.uint64(22)) | np.arange(len(part), dtype=np.uint64)
            size = 1
            while size * 2 <= span:
                key = np.minimum(key[:-size], key[size:])
                size *= 2
            if size < span:
                key = np.minimum(key[: len(key) - (span - size)], key[span - size :])
            least[s : s + len(key)] = (key & np.uint64((1 << 22) - 1)).astype(np.int64) + s
        p = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])
        heads = np.flatnonzero(new)
        self.start, self.doc, self.anchor = at[heads], doc[heads], g[p[heads]]
        self.count = np.diff(np.append(heads, len(at)))  # windows of the segment

    def content(self, k: int, window: int) -> bytes:
        a = self.start[k]
        return self.data[self.begin[a] : self.end[a + self.count[k] + window - 2]]


def _signed(x: int) -> int:
    return x - ((x >> 63) << 64)


def _ids(b: pa.RecordBatch) -> np.ndarray:
    return b.column("doc_id").to_numpy(zero_copy_only=False)


# First pass: anchors that more than one document has.


def _anchors(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """route, doc_id, kind, n, hits. kind 0: an anchor (route) of one document; 1: an anchor known for shared by n documents;
    2: the anchors (hits) of a document that are known for shared."""
    for b in steps(batches):
        ids = _ids(b)
        w = Windows(utf8(b.column("text")), window)
        if not len(w.start):
            continue
        owner = ids[w.doc]
        order = np.lexsort((owner, w.anchor))
        h, d = w.anchor[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(start, len(h)))
        many = size > 1
        shared = np.repeat(many, size)
        one, known = h[~shared].view(np.int64), h[start[many]].view(np.int64)
        hit_h, hit_d = h[shared], d[shared]
        order = np.argsort(hit_d, kind="stable")
        hit_h, hit_d = hit_h[order], hit_d[order]
        cut = np.flatnonzero(np.append(True, hit_d[1:] != hit_d[:-1])) if len(hit_d) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(hit_d))
        hits = [hit_h[a:e].tobytes() for a, e in zip(cut.tolist(), ends.tolist(), strict=True)] if len(cut) else []
        docs = hit_d[cut]
        n = [len(one), len(known), len(docs)]
        yield pa.record_batch(
            [
                pa.array(np.concatenate([one, known, docs ^ _MIX.view(np.int64)])),
                pa.concat_arrays([pa.array(d[~shared], pa.int64()), pa.nulls(n[1], pa.int64()), pa.array(docs, pa.int64())]),
                pa.array(np.repeat(np.array([0, 1, 2], np.int32), n)),
                pa.array(np.concatenate([np.ones(n[0], np.int64), size[many], np.zeros(n[2], np.int64)])),
                pa.concat_arrays([pa.nulls(n[0] + n[1], pa.binary()), pa.array(hits, pa.binary())]),
            ],
            names=["route", "doc_id", "kind", "n", "hits"],
        )


def _shared(batches: Iterable[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """doc_id, hits: the shared anchors of a document; or without a document those of more than `hot` ones, with the
    number of these (n). The rows come sorted by route; a batch sends an anchor once, so the rows of one are few."""

    def emit(table: pa.Table) -> pa.RecordBatch:
        kind = table["kind"].to_numpy()
        plain = np.flatnonzero(kind == 2)
        hits = table.take(plain).combine_chunks()
        at = np.flatnonzero(kind < 2)
        route, k = table["route"].to_numpy()[at], kind[at]
        doc = table["doc_id"].fill_null(0).to_numpy()[at]
        out_doc, out_hits = hits["doc_id"].to_pylist(), hits["hits"].to_pylist()
        counts = None
        if len(at):
            start = np.flatnonzero(np.append(True, route[1:] != route[:-1]))
            big = np.iinfo(np.int64)
            low = np.minimum.reduceat(np.where(k == 0, doc, big.max), start)
            high = np.maximum.reduceat(np.where(k == 0, doc, big.min), start)
            size = np.add.reduceat(table["n"].to_numpy()[at], start)
            often = route[start[size > hot]]
            if len(often):
                out_doc.append(None)
                out_hits.append(often.tobytes())
                counts = (len(out_doc) - 1, size[size > hot].astype(np.int64).tobytes())
            yes = (np.maximum.reduceat(k, start) == 1) | (low < high)
            pick = np.repeat(yes, np.diff(np.append(start, len(route)))) & (k == 0)
            h, d = route[pick], doc[pick]
            order = np.argsort(d, kind="stable")
            h, d = h[order], d[order]
            cut = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else np.zeros(0, np.int64)
            ends = np.append(cut[1:], len(d))
            out_doc += d[cut].tolist()
            out_hits += [h[a:e].tobytes() for a, e in zip(cut.tolist(), ends.tolist(), strict=True)] if len(cut) else []
        n = [None] * len(out_doc)
        if counts:
            n[counts[0]] = counts[1]
        return pa.record_batch([pa.array(out_doc, pa.int64()), pa.array(out_hits, pa.binary()), pa.array(n, pa.binary())], names=["doc_id", "hits", "n"])

    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        if t.num_rows < 200_000:  # larger pieces have the hits of a document together
            rest = t
            continue
        route = t["route"].to_numpy()
        cut = int(np.searchsorted(route, route[-1]))  # the last may go on
        if cut:
            yield emit(t.slice(0, cut))
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield emit(rest)


def _unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([pa.array(np.frombuffer(b"".join(b.column(c).to_pylist()), np.int64)) for c in ("hits", "n")], names=["anchor", "n"])


# Second pass: the segments of shared anchors.

SEGMENTS = "anchor long, seg long, doc_id long, last long, row long, starts binary, content binary"


def _tag(text: bytes) -> int:
    """Tells texts of one doc_id apart."""
    return _signed(xxhash.xxh64_intdigest(text))


def _segments(batches: Iterable[pa.RecordBatch], window: int, contents: bool, often: Broadcast | None, hot: bool) -> Iterator[pa.RecordBatch]:
    """With contents: each distinct segment of a batch once, with its least and largest document; those of the anchors in
    `often` (sorted) if `hot`, else those of the others. Without: the places of all, a row for each document; `row` tells
    rows of one doc_id apart."""
    apart = often.value if often and contents else np.zeros(0, np.uint64)

    def chosen(x: np.ndarray) -> np.ndarray:
        if not contents or not len(apart):
            return x
        return x[(apart[np.minimum(np.searchsorted(apart, x), len(apart) - 1)] == x) == hot]

    for b in steps(batches):
        ids = _ids(b)
        hits = [chosen(np.frombuffer(b"".join(x or ()), np.uint64)) for x in b.column("hits").to_pylist()]
        texts = [t if len(x) else b"" for t, x in zip(utf8(b.column("text")), hits, strict=True)]
        w = Windows(texts, window)
        wanted = np.unique(np.concatenate([x ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) for i, x in enumerate(hits)]))
        if not len(w.start) or not len(wanted):
            continue
        own = w.anchor ^ ((w.doc + 1).astype(np.uint64) * _MIX)
        at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
        pick = np.flatnonzero(wanted[at] == own)
        if not len(pick):
            continue
        a = w.begin[w.start[pick]]
        e = w.end[w.start[pick] + w.count[pick] + window - 2]
        seg, anchor, doc = xxh64(w.data, a, e - a, 11), w.anchor[pick], ids[w.doc[pick]]
        if contents:
            order = np.lexsort((doc, seg, anchor))
            s, h, d = seg[order], anchor[order], doc[order]
            start = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (h[1:] != h[:-1])))
            last = d[np.append(start[1:], len(d)) - 1]
            text = [w.data[x:y] for x, y in zip(a[order[start]].tolist(), e[order[start]].tolist(), strict=True)]
            n = len(start)
            yield pa.record_batch([pa.array(h[start].view(np.int64)), pa.array(s[start].view(np.int64)), pa.array(d[start]), pa.array(last - d[start]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(text, pa.binary())], names=[x.split()[0] for x in SEGMENTS.split(", ")])
        else:
            of = w.doc[pick]
            place = (w.start[pick] - w.first[of]).astype(np.int32)
            order = np.lexsort((place, seg, anchor, of))
            s, h, o, p = seg[order], anchor[order], of[order], place[order]
            start = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (h[1:] != h[:-1]) | (o[1:] != o[:-1])))
            ends = np.append(start[1:], len(p))
            raw, n = p.astype("<i4").tobytes(), len(start)
            rows = np.array([_tag(t) for t in texts], np.int64)
            yield pa.record_batch(
                [pa.array(h[start].view(np.int64)), pa.array(s[start].view(np.int64)), pa.array(ids[o[start]]), pa.nulls(n, pa.int64()), pa.array(rows[o[start]]), pa.array([raw[4 * x : 4 * y] for x, y in zip(start.tolist(), ends.tolist(), strict=True)], pa.binary()), pa.nulls(n, pa.binary())],
                names=[x.split()[0] for x in SEGMENTS.split(", ")],
            )


WINDOWS = "w binary, anchor long, seg long, part int, low long, high long"


def _windows(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The windows of segments (anchor, seg, low, high, content), each by its place and its hash."""
    for b in batches:
        key, part, of = [], [], []
        for i, content in enumerate(b.column("content").to_pylist()):
            words = content.split(b" ")
            for j in range(len(words) - window + 1):
                key.append(xxhash.xxh3_128_digest(b" ".join(words[j : j + window])))
                part.append(j)
                of.append(i)
        at = pa.array(of, pa.int32())
        yield pa.record_batch([pa.array(key, pa.binary()), b.column("anchor").take(at), b.column("seg").take(at), pa.array(part, pa.int32()), b.column("low").take(at), b.column("high").take(at)], names=[x.split()[0] for x in WINDOWS.split(", ")])


# The shards.

FOUND = "anchor long, seg long, answers array<struct<part: int, mins: array<bigint>>>"


def _search(rows: list[tuple], window: int) -> pa.RecordBatch | None:
    """rows: anchor, seg, least and largest document, content; the least document of each window."""
    kept: dict[tuple, list] = {}
    for anchor, seg, low, last, content in rows:
        got = kept.setdefault((anchor, seg), [low, last, content])
        got[0], got[1] = min(got[0], low), max(got[1], last)
    split = pa.compute.split_pattern(pa.array([v[2] for v in kept.values()], pa.binary()), " ")
    coded = split.values.dictionary_encode()
    ends = split.offsets.to_numpy()[1:].astype(np.int64)
    sizes = np.diff(ends, prepend=0) + 1
    text = np.insert(coded.indices.to_numpy().astype(np.int64) + 1, ends, 0)  # 0 behind each segment
    symbols = len(coded.dictionary) + 1
    low, last = (np.array([v[i] for v in kept.values()], np.int64) for i in (0, 1))
    first, m = np.cumsum(sizes) - sizes, sizes - window
    owner = np.repeat(np.arange(len(sizes)), m)
    begin = np.cumsum(m) - m
    starts = np.arange(int(m.sum())) - np.repeat(begin, m) + np.repeat(first, m)
    index = FmIndex(text, symbols, window)
    least = low[owner]
    number, lo, hi = index.repeated(text, starts, window)
    if len(number):
        doc = np.repeat(low, sizes)[index.order]
        los, at, back = np.unique(lo, return_index=True, return_inverse=True)  # equal or disjoint intervals
        bounds = np.stack([los, hi[at]], axis=1).ravel()
        least[number] = np.minimum.reduceat(np.append(doc, np.iinfo(np.int64).max), bounds)[::2][back]
    tell = np.flatnonzero((last > low) | (np.minimum.reduceat(least, begin) < low))
    if not len(tell):
        return None
    keys = list(kept)
    mins = [least[begin[k] : begin[k] + m[k]] for k in tell.tolist()]
    names = [keys[k] for k in tell.tolist()]
    offsets = np.append(0, np.cumsum(m[tell])).astype(np.int32)
    each = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(mins)))
    answer = pa.StructArray.from_arrays([pa.array(np.zeros(len(names), np.int32)), each], names=["part", "mins"])
    answers = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32)), answer)
    return pa.record_batch([pa.array([x[0] for x in names], pa.int64()), pa.array([x[1] for x in names], pa.int64()), answers], names=["anchor", "seg", "answers"])


def _index(batches: Iterable[pa.RecordBatch], window: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Indexes of consecutive anchors; equal windows have equal anchors, so a cut between two loses nothing."""
    rows: list[tuple] = []
    words, before = 0, None
    for b in batches:
        for anchor, seg, low, more, content in zip(*(b.column(c).to_pylist() for c in ("anchor", "seg", "doc_id", "last", "content")), strict=True):
            if words >= limit and anchor != before:
                if (found := _search(rows, window)) is not None:
                    yield found
                rows, words = [], 0
            rows.append((anchor, seg, low, low + more, content))
            words += content.count(b" ") + 1
            before = anchor
    if rows and (found := _search(rows, window)) is not None:
        yield found
    rows = []
    give_back()


def _often(shared: DataFrame, most: int) -> np.ndarray:
    """The hot anchors, sorted: those of the most documents, `most` at most."""
    often = shared.where("doc_id is null").mapInArrow(_unpack, "anchor long, n long")
    step = F.floor(F.log2("n")).cast("int")
    kept, least = 0, 64
    for r in sorted(often.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):  # a row a power of two
        if kept + r["count"] > most:
            break
        kept, least = kept + r["count"], r.step
    rows = often.where(step >= least).select("anchor").toPandas() if kept else None  # `most` rows at most
    return np.sort(rows["anchor"].to_numpy(np.int64).view(np.uint64)) if kept else np.zeros(0, np.uint64)


def repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT, limit: int = INDEX_WORDS) -> DataFrame:
    """doc_id, spans array<struct<row, starts, answers array<struct<part, gone>>>>: for each document with a repeat, its
    segments' places and which windows from there start in an earlier document."""
    sent = _texts(docs).where("doc_id is not null").mapInArrow(partial(_anchors, window=window), "route long, doc_id long, kind int, n long, hits binary")
    shared = written(sent.repartition("route").sortWithinPartitions("route").mapInArrow(partial(_shared, hot=hot), "doc_id long, hits binary, n binary"), "anchors")
    hits = shared.where("doc_id is not null").groupBy("doc_id").agg(F.collect_list("hits").alias("hits"))
    apart = _often(shared, BROADCAST)
    often = docs.sparkSession.sparkContext.broadcast(apart) if len(apart) else None
    # The uses below read one exchange of the texts.
    joined = _texts(docs).join(hits, "doc_id").select("doc_id", "text", "hits")
    segments = lambda contents, of_hot=False: joined.mapInArrow(partial(_segments, window=window, contents=contents, often=often, hot=of_hot), SEGMENTS)
    places = segments(False).select("anchor", "seg", "doc_id", "row", "starts")
    contents = segments(True).select("anchor", "seg", "doc_id", "last", "content")
    found = contents.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(partial(_index, window=window, limit=limit), FOUND)
    if often:
        each = segments(True, True).groupBy("anchor", "seg").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id") + F.col("last")).alias("high"), F.min("content").alias("content"))
        windows = each.mapInArrow(partial(_windows, window=window), WINDOWS)
        least = windows.groupBy("w").agg(F.min("low").alias("least"), F.max("high").alias("high")).where("least < high")
        # A window that ever other segments have is dealt to SALTS tasks.
        least = least.select("w", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        asked = windows.select("w", F.pmod("seg", F.lit(SALTS)).cast("int").alias("salt"), "anchor", "seg", "part")
        answer = F.struct("part", F.array("least").alias("mins"))
        found = found.unionByName(asked.join(least, ["w", "salt"]).groupBy("anchor", "seg").agg(F.collect_list(answer).alias("answers")))
    earlier = "transform(answers, a -> struct(a.part as part, transform(a.mins, x -> x < doc_id) as gone))"
    gone = places.join(found, ["anchor", "seg"]).where("exists(answers, a -> exists(a.mins, x -> x < doc_id))").select("doc_id", F.struct("row", "starts", F.expr(earlier).alias("answers")).alias("span"))
    return gone.groupBy("doc_id").agg(F.collect_list("span").alias("spans"))


def _texts(docs: DataFrame) -> DataFrame:
    # A cast to the type that it has leaves an alias in some of the plans, and then their exchange isn't shared.
    return docs.select("doc_id" if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long"), "text")


def _with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Every text with its spans or null. Texts without an id need no join; the others use the exchange that repeats()
    does, which asks for an id too."""
    none = texts.where("doc_id is null").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    return texts.where("doc_id is not null").join(spans, "doc_id", "left").select(none.columns).unionByName(none)


def _removals(texts: list[bytes], words: np.ndarray, column: pa.Array, window: int) -> list[np.ndarray | None]:
    """Which words of each text go, None where there is nothing to remove. The spans of all texts are laid out together."""
    n = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out: list[np.ndarray | None] = [None] * len(texts)
    has = np.flatnonzero(n)
    if not len(has):
        return out
    spans = column.flatten()
    doc = np.repeat(np.arange(len(texts)), n)
    tags = np.zeros(len(texts), np.int64)
    tags[has] = [_tag(texts[k]) for k in has.tolist()]
    own = spans.field("row").to_numpy(zero_copy_only=False) == tags[doc]
    starts = spans.field("starts")
    size = pa.compute.binary_length(starts).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    place = np.frombuffer(b"".join(starts.to_pylist()), "<i4").astype(np.int64)
    answers = spans.field("answers")
    answer_of = np.repeat(np.arange(len(spans)), pa.compute.list_value_length(answers).fill_null(0).to_numpy(zero_copy_only=False))
    flat = answers.flatten()
    gone = flat.field("gone")
    length = pa.compute.list_value_length(gone).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    which = np.repeat(np.arange(len(flat)), length)
    ahead = np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length) + flat.field("part").to_numpy(zero_copy_only=False)[which]
    yes = gone.flatten().fill_null(False).to_numpy(zero_copy_only=False) & own[answer_of[which]]
    span, ahead = answer_of[which[yes]], ahead[yes]
    times = size[span]  # each place of the segment
    first = np.cumsum(size) - size
    at = np.repeat(first[span] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    slot = np.cumsum(words + 1) - (words + 1)
    start = slot[np.repeat(doc[span], times)] + place[at] + np.repeat(ahead, times)
    edge = np.bincount(start, minlength=int((words + 1).sum()) + window) - np.bincount(start + window, minlength=int((words + 1).sum()) + window)
    covered = np.cumsum(edge) > 0
    for k in has.tolist():
        out[k] = covered[slot[k] : slot[k] + words[k]]
    return out


_SPANS = pa.list_(pa.struct([("row", pa.int64()), ("starts", pa.binary()), ("answers", pa.list_(pa.struct([("part", pa.int32()), ("gone", pa.list_(pa.bool_()))])))]))


def _removed(text: bytes, words: int, spans: list | None, window: int) -> np.ndarray:
    """Which words of one text go."""
    rows = [{"row": s["row"], "starts": s["starts"], "answers": [{"part": a["part"], "gone": a["gone"]} for a in s["answers"]]} for s in spans or ()]
    gone = _removals([text], np.array([words]), pa.array([rows], _SPANS), window)[0]
    return np.zeros(words, bool) if gone is None else gone


def _kept(batches: Iterable[pa.RecordBatch], window: int, digest: bool) -> Iterator[pa.RecordBatch]:
    for b in steps(batches):
        texts = utf8(b.column("text"))
        has = pa.compute.list_value_length(b.column("spans")).fill_null(0).to_numpy(zero_copy_only=False) > 0
        # Only one text's words are held at a time; those of texts with spans are counted first.
        sizes = np.array([len(t.split()) if h else 0 for t, h in zip(texts, has.tolist(), strict=True)], np.int64)
        n, removed, out = [], [], []
        for text, gone in zip(texts, _removals(texts, sizes, b.column("spans"), window), strict=True):
            words = text.split()
            n.append(len(words))
            left = words if gone is None else list(compress(words, (~gone).tolist()))
            removed.append(len(words) - len(left))
            if digest:
                out.append(hashlib.sha256(b" ".join(left)).hexdigest())
            else:
                out.append(text.decode() if len(left) == len(words) else b" ".join(left).decode())
        keep = [c for c in b.schema.names if c not in ("text", "spans")]
        yield pa.record_batch([*(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], names=[*keep, "n_words", "n_removed", "kept"])


def repeat_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    joined = _with_spans(_texts(docs), repeats(docs, window))
    return joined.mapInArrow(partial(_kept, window=window, digest=True), "doc_id long, n_words long, n_removed long, kept string").withColumnRenamed("kept", "kept_sha256")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with all their columns, their text without the repeats: untouched where there is none, else the
    words left joined by one space (empty if none is)."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names).withColumns({"text": F.col(names[docs.columns.index("text")]), "doc_id": F.col(names[docs.columns.index("doc_id")]).cast("long")})
    joined = _with_spans(inner, repeats(docs, window)).select(*names, "text", "spans")
    schema = ", ".join([f"`{n}` {t.dataType.simpleString()}" for n, t in zip(names, docs.schema.fields, strict=True)] + ["n_words long", "n_removed long", "kept string"])
    done = joined.mapInArrow(partial(_kept, window=window, digest=False), schema)
    text = F.when(F.col(names[docs.columns.index("text")]).isNull(), None).otherwise(F.col("kept"))
    return done.select(*[(text if c == "text" else F.col(n)).alias(c) for n, c in zip(names, docs.columns, strict=True)])
