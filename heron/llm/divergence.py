"""How the sources of a language differ in their words: divergences between sources, and the terms that set one apart.

Terms are runs of ASCII letters and of everything beyond ASCII, with A-Z lower-cased. A numpy table over a batch's
concatenated UTF-8 finds their boundaries, XXH64 groups equal slices, and each slice is compared with its group's first
byte by byte; what differs (a collision) is grouped by its bytes. Documents become a sparse matrix, whose rows are summed
up by (lang, source) before anything is shuffled.

A language keeps the terms of at least `least` of its documents. With V kept terms, and N occurrences of them in a group, a
term's share of the group is p = 1 + floor(10^9 (count + 1) / (N + V)). The divergence of p from q is floor((p - q)^2 / q).
For the pairs of sources the kept terms are dealt by hash, and sources in tiles of TILE, so that a task has a bounded part of
a language. There the sources are rows of a CSR matrix: the sum over all terms is that of terms which neither has, for all V,
plus what the terms of either change, summed by row with reduceat.

Cases: a null text, lang or source counts as ''; an empty text has no terms, but its (lang, source) still is a group; a text
or term of any length is taken whole; repeated rows are documents of their own, whatever their doc_id, which is not read; ties
go by the item's UTF-8; an empty table gives an empty result; a language without kept terms has value 0 for all its pairs; a
language of one source has no pairs; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, steps, written
from .xxh import LONG, xxh64

SCALE = 1_000_000_000
LEAST, TOP = 3, 200
#: Bytes of text that are counted together; a worker's arrays take 20 to 40 times as much.
STEP = 2 << 20
#: Sources of a tile, and counts of a language that a task has about for each pair of tiles.
TILE, PART = 256, 1 << 18

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values' UTF-8 one after another, and where each begins (one more entry for the end). Null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8), offsets - offsets[0]


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each term; none goes from one document into the next."""
    inside = _LETTER[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1 - start


def equal_slices(data: bytes, start: np.ndarray, length: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether data[start : start + length] equals data[other : other + length], eight bytes at a time."""
    at = np.ndarray((len(data) + 8,), "<u8", np.frombuffer(data + bytes(16), np.uint8).data, strides=(1,))
    same = np.ones(len(start), bool)
    live = np.flatnonzero(length <= LONG)
    done = 0
    while len(live):
        rest = np.minimum(length[live] - done, 8)
        shift = ((8 - rest) * 8).astype(np.uint64)  # bytes beyond the slice are shifted out
        same[live] &= ((at[start[live] + done] ^ at[other[live] + done]) << shift) == 0
        done += 8
        live = live[length[live] > done]
    for k in np.flatnonzero(length > LONG).tolist():
        a, b, n = int(start[k]), int(other[k]), int(length[k])
        same[k] = data[a : a + n] == data[b : b + n]
    return same


def grouped(data: bytes, start: np.ndarray, length: np.ndarray, hashed=xxh64) -> tuple[np.ndarray, np.ndarray]:
    """The first slice of each distinct term, and each slice's number among these."""
    _, first, number = np.unique(hashed(data, start, length, 0), return_index=True, return_inverse=True)
    lead = first[number]
    wrong = length != length[lead]
    wrong |= ~equal_slices(data, start, np.minimum(length, length[lead]), start[lead])
    if wrong.any():  # slices that share a hash with another term
        own: dict[bytes, int] = {}
        more = []
        for k in np.flatnonzero(wrong).tolist():
            x = data[start[k] : start[k] + length[k]]
            if x not in own:
                own[x] = len(first) + len(more)
                more.append(k)
            number[k] = own[x]
        first = np.append(first, np.array(more, first.dtype))
    return first, number


def _runs(key: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin in a sorted array."""
    return np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches, limit=STEP):
        raw, offsets = buffer(b.column("text"))
        data = _LOWER[raw].tobytes()
        start, length = boundaries(raw, offsets)
        first, term = grouped(data, start, length)
        doc = np.repeat(np.arange(b.num_rows), np.diff(np.searchsorted(start, offsets)))
        pair = pa.StructArray.from_arrays([b.column("lang"), b.column("source")], ["lang", "source"])
        names = pa.compute.dictionary_encode(pa.compute.binary_join_element_wise(_sized(pair.field("lang")), pair.field("lang"), pair.field("source"), "\0"))
        group = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        seen, of = np.unique(group, return_index=True)
        n = len(first) + 1
        cell = np.sort(doc * n + term)  # the rows of the documents' matrix
        at = _runs(cell)
        size, cell = np.diff(np.append(at, len(cell))), cell[at]
        key = group[cell // n] * n + cell % n
        order = np.argsort(key, kind="stable")
        key, size = key[order], size[order]
        at = _runs(key)
        total = np.add.reduceat(size, at) if len(at) else size
        docs = np.diff(np.append(at, len(key)))
        key = key[at]
        words = pa.array([data[s : s + k] for s, k in zip(start[first].tolist(), length[first].tolist(), strict=True)], pa.binary()).cast(pa.string())
        rows = pa.array(np.append(of[np.searchsorted(seen, key // n)], of))
        terms = pa.concat_arrays([words.take(pa.array(key % n)), pa.nulls(len(of), pa.string())])
        zeros = np.zeros(len(of), np.int64)
        yield pa.record_batch([b.column("lang").take(rows), b.column("source").take(rows), terms, pa.array(np.append(total, zeros)), pa.array(np.append(docs, zeros))], names=["lang", "source", "term", "count", "docs"])


def _sized(column: pa.Array) -> pa.Array:
    """Lengths as text, so that no two pairs of names join to one."""
    return pa.compute.cast(pa.compute.binary_length(column), pa.string())


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs (documents that have it); for each group also a row without a term."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = named.mapInArrow(_counts, "lang string, source string, term string, count long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: str, n: str, v: str) -> Column:
    """1 + floor(10^9 (count + 1) / (n + v)), whatever their size."""
    return F.expr(f"1 + ({SCALE} * cast({count} + 1 as decimal(20, 0))) div nullif({n} + {v}, 0)")


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def csr_divergences(indptr: np.ndarray, col: np.ndarray, p: np.ndarray, rest: np.ndarray, n_terms: int) -> np.ndarray:
    """What the terms that rows have change in the divergence of each row from each other, against a row's share of any
    other term (`rest`): p has the shares, by row and column. Sums are exact: what wraps around in between comes back, as
    results fit."""
    rows = len(rest)
    row = np.repeat(np.arange(rows), np.diff(indptr))
    full = np.flatnonzero(np.diff(indptr))
    at = indptr[:-1][full]
    out = np.zeros((rows, rows), np.int64)
    if not len(full):
        return out
    for r in range(rows):  # terms that the first has, against the second's rest
        out[full, r] += np.add.reduceat(apart(p, rest[r]) - apart(rest[row], rest[r]), at)
    dense = np.empty(n_terms, np.int64)
    for s in range(rows):  # terms that the second has: its share there in place of its rest
        dense[:] = rest[s]
        dense[col[indptr[s] : indptr[s + 1]]] = p[indptr[s] : indptr[s + 1]]
        mine = dense[col]
        out[s, full] += np.add.reduceat(apart(mine, p) - apart(mine, rest[row]), at)
    return out


def _pairs(key: tuple, rows: pa.Table, tile: int) -> pa.Table:
    lang, _, left, right = (x.as_py() for x in key)
    pos = rows["pos"].to_numpy()
    rest_of = rows["rest"].to_numpy()
    seen, first, row = np.unique(pos, return_index=True, return_inverse=True)
    term = rows["term"].combine_chunks().dictionary_encode()
    col = term.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    has = col >= 0
    order = np.flatnonzero(has)
    order = order[np.lexsort((col[order], row[order]))]
    indptr = np.append(0, np.cumsum(np.bincount(row[order], minlength=len(seen))))
    got = csr_divergences(indptr, col[order], rows["p"].fill_null(0).to_numpy()[order], rest_of[first], len(term.dictionary))
    own = (seen - 1) // tile
    wanted = own[:, None] != own[None, :] if left != right else seen[:, None] != seen[None, :]
    a, b = np.nonzero(wanted)
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "pos": seen[a], "other": seen[b], "value": got[a, b]})


def source_divergences(docs: DataFrame, least: int = LEAST, top: int = TOP, tile: int = TILE, part: int = PART) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: each other source of the language and the divergence from it;
    part `term`: the `top` terms that a source has more of than its language, by their divergence."""
    by_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumn("lang_docs", F.sum("docs").over(by_term)).withColumn("lang_count", F.sum("count").over(by_term))
    counts = counts.withColumn("lead", (F.row_number().over(by_term.orderBy("source")) == 1).cast("long"))
    kept = written(counts.where(f"term is null or lang_docs >= {int(least)}").drop("docs", "lang_docs"), "terms")

    langs = kept.groupBy("lang").agg(F.sum("count").alias("lang_n"), F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("lead"))), F.lit(0)).alias("v"), F.count("term").alias("entries"))
    groups = kept.groupBy("lang", "source").agg(F.sum("count").alias("n")).join(langs, "lang")
    groups = groups.withColumn("pos", F.row_number().over(Window.partitionBy("lang").orderBy("source")))
    groups = groups.withColumn("tiles", F.max(F.floor((F.col("pos") - 1) / tile)).over(Window.partitionBy("lang"))).withColumn("parts", F.expr(f"1 + entries div {int(part)}"))
    groups = written(groups.withColumn("rest", F.coalesce(share("0", "n", "v"), F.lit(1))).drop("entries"), "groups")

    rows = kept.where("term is not null").join(sized(groups), ["lang", "source"]).withColumn("p", share("count", "n", "v"))
    dealt = rows.select("lang", "pos", "rest", "tiles", F.pmod(F.xxhash64("term"), "parts").alias("part"), "term", "p")
    every = groups.select("lang", "pos", "rest", "tiles", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"))
    tiled = dealt.unionByName(every).withColumn("tile", F.floor((F.col("pos") - 1) / tile)).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles"))))
    keyed = tiled.select("lang", "part", F.least("tile", "with").alias("left"), F.greatest("tile", "with").alias("right"), "pos", "rest", "term", "p")

    def divergences(key: tuple, rows: pa.Table) -> pa.Table:
        return _pairs(key, rows, tile)

    sums = keyed.groupBy("lang", "part", "left", "right").applyInArrow(divergences, "lang string, pos int, other int, value long").groupBy("lang", "pos", "other").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "pos", "source", "v", F.col("rest").alias("p"))
    pairs = sums.join(sized(names), ["lang", "pos"]).join(sized(names.select("lang", F.col("pos").alias("other"), F.col("source").alias("item"), F.col("p").alias("q"))), ["lang", "other"])
    pairs = pairs.withColumn("value", F.expr("value + v * (((p - q) * (p - q)) div q)"))  # the terms that neither has count too

    q = share("lang_count", "lang_n", "v")
    terms = rows.where("count > 0").withColumn("q", q).where("p > q").withColumn("value", F.expr("((p - q) * (p - q)) div q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    told = lambda df, part: df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return told(pairs, "pair").unionByName(told(terms.withColumnRenamed("term", "item"), "term").where(f"rank <= {int(top)}"))
