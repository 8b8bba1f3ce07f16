"""SimHash near-duplicates by a generalised pigeonhole search.

Fingerprints: 64 bits, each the majority of that bit over the hashes of all word shingles. Documents of equal
fingerprints are collapsed first; the search runs on distinct ones.

Search. The 64 bits are put into partitions, correlated bits together, by the correlation over all fingerprints. For
radius r and m partitions, thresholds t_i >= -1 with sum(t_i) = r - m + 1 lose no pair: two fingerprints within r differ
in at most t_i bits in some partition i. Dynamic programming picks the thresholds, and before them m, of least estimated
cost: probes, and candidates as the histograms of the keys show them. A fingerprint probes partition i once for each
choice of t_i masked bits; fingerprints with the same masked key are candidates, and the XOR of the whole is counted.

A key holds its fingerprints sorted in a task. Of the links found there a spanning forest is passed on, which keeps
components. A key of more than HOT fingerprints is divided by equality on one of r + 1 blocks of the bits it leaves open
(again lossless). What is still larger gets a pivot: all within r bits of it are linked to it, and need not be compared
with each other; only those beyond go, as blocks of HOT against blocks of all. So a dense group takes linear work, no
task gets an unbounded group, and only fingerprints that agree on all bits of a key and of a block, are more than HOT and
yet farther apart than r take work in proportion to their number times that of the whole key.

keep_one has a radius so wide that the masked keys of unlike texts meet ever more often as the table grows. So there a
text's keys are the least of its shingle hashes: texts of a similarity of 0.8 have one in common all but for certain (see
_keyed), unlike ones only what is said again and again. What more than COMMON texts have is put last in the order of the
hashes, and keys that stay large are divided as above. So the work follows the number of texts.

Cases: a null or empty text, or one of white space, has the fingerprint 0 and links like any other; fewer words than a
shingle: the whole sequence is the one shingle; a text of any length is taken whole, as a step of its own; repeated rows
and ties collapse; rows of one doc_id are rows of their own; an empty table gives an empty result; a null doc_id keeps
its row, and counts as larger than any id; other columns are never read by near_duplicates and carried by keep_one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, give_back, sized, steps, utf8, written
from .components import components
from .xxh import xxh64

SEED = 42
#: Fingerprints of one key that one task compares.
HOT = 4096
#: keep_one: fingerprints of a text; those that are searched, and within how many bits; most bits that all may differ in.
#: At a similarity of 0.8 a bit differs with a chance of 0.15, so all together by 29 +- 5.
PRINTS, SEARCHES, RADIUS, APART = 3, 2, 13, 46
#: keep_one: pivots of a key that is still larger than HOT. Its families may be larger than the links make them.
PIVOTS = 8
#: keep_one: shingle hashes of a text that are kept, the least; those that are its keys; of those kept, how many must be
#: uncommon if only such are keys; texts that have a common one.
SKETCH, KEYS, ENOUGH, COMMON = 32, 12, 24, 1000
#: Texts of a family, and their bytes, that a block has at most on average.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: What a candidate costs in probes.
CANDIDATE = 0.01


def _normal(texts: list[bytes]) -> list[bytes]:
    return [b" ".join(t.lower().split()) for t in texts]


def shingles_of(split: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of normal texts: the hashes of all shingles, one text after another; the texts that have any; how many each has."""
    n = np.array([s.count(b" ") + 1 if s else 0 for s in split], np.int64)
    has = np.flatnonzero(n)
    if not len(has):
        return np.zeros(0, np.uint64), has, n[has]
    data = b"\n".join(s for s in split if s) + b"\n"
    chars = np.frombuffer(data, np.uint8)
    end = np.flatnonzero((chars == 32) | (chars == 10))  # after each word
    begin = np.append(0, end[:-1] + 1)
    n = n[has]
    m = np.maximum(n - words + 1, 1)
    first_word, first = np.cumsum(n) - n, np.cumsum(m) - m
    inside = np.arange(int(m.sum())) - np.repeat(first, m)
    a = np.repeat(first_word, m) + inside
    b = a + np.minimum(words, np.repeat(n, m)) - 1
    return xxh64(data, begin[a], end[b] - begin[a], SEED), has, m


def _majority(hashes: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The majority of each bit over the hashes of each text, of which it has m."""
    first = np.cumsum(m) - m
    half = np.zeros((len(m), 64), np.int64)
    step = 1 << 14
    for k in range(0, len(hashes), step):  # bits of some shingles at a time
        bits = np.unpackbits(hashes[k : k + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo, hi = np.searchsorted(first, k, "right") - 1, np.searchsorted(first, min(k + step, len(hashes)), "left")
        half[lo:hi] += np.add.reduceat(bits, np.maximum(first[lo:hi] - k, 0), axis=0, dtype=np.int32)
    return np.packbits(half * 2 > m[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash of each hash (SplitMix64 from its k-th step); the same for k = 0."""
    if not k:
        return h
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints_of(texts: list[bytes], words: int) -> np.ndarray:
    """The fingerprint of each text, shingles of so many words, A-Z lower-cased."""
    hashes, has, m = shingles_of(_normal(texts), words)
    out = np.zeros(len(texts), np.uint64)
    if len(has):
        out[has] = _majority(hashes, m)
    return out


def _fingerprint(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in steps(batches, limit=2 << 20):
        yield pa.record_batch([b.column("doc_id"), pa.array(fingerprints_of(utf8(b.column("text")), words).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_fingerprint, words=words), "doc_id long, fp long")


# Statistics and the plan of the search: 64 x 64 numbers and a few histograms, whatever the input.


def _together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((64, 64), np.int64)
    for b in batches:
        bits = np.unpackbits(np.ascontiguousarray(b.column("fp").to_numpy()).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        total += (bits.T @ bits).astype(np.int64)
    yield pa.record_batch([pa.array(range(4096), pa.int32()), pa.array(total.ravel())], names=["cell", "n"])


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Partitions of near-equal width; each takes the bits that correlate most with those it has."""
    p = np.diag(together) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, out = set(range(64)), []
    for k in range(parts):
        width = (64 - sum(map(len, out)) + parts - k - 1) // (parts - k)
        rows = sorted(left)
        own = [max(rows, key=lambda b: (corr[b, rows].sum(), -b))]
        while len(own) < width:
            own.append(max((b for b in rows if b not in own), key=lambda b: (corr[b, own].sum(), -b)))
        out.append(sorted(own))
        left -= set(own)
    return out


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one a partition, of the given sum and the least cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, more in own.items():
                if s + t not in new or c + more < new[s + t][0]:
                    new[s + t] = (c + more, [*chosen, t])
        best = new
    return best[total]


def _cost(n: int, equal: float, agree: np.ndarray, radius: int) -> dict[int, float]:
    """By threshold: the probes and candidates of one partition. equal: expected pairs of equal keys; agree: the chance
    that two fingerprints have a bit in common, by bit."""
    out, width = {-1: 0.0}, len(agree)
    odds = float(((1 - agree) / agree).sum())
    apart = [equal, equal * odds, equal * odds * odds / 2]  # pairs by the bits they differ in
    for t in range(min(radius, 2, width - 1) + 1):
        out[t] = n * comb(width, t) + CANDIDATE * sum(apart[s] * comb(width - s, t - s) for s in range(t + 1))
    return out


def plan_search(unique: DataFrame, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition."""
    n = unique.count()
    if n < 2:
        return []
    cells = unique.select("fp").mapInArrow(_together, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    together = np.zeros(4096, np.int64)
    for cell, count in cells.collect():  # 4,096 rows
        together[cell] = count
    together = together.reshape(64, 64)
    p = np.diag(together) / n
    agree = np.clip(p * p + (1 - p) ** 2, 0.5, 1 - 1e-9)
    best = None
    for parts in range(2, radius + 2):
        groups = group_bits(together, n, parts)
        costs = [_cost(n, n * n / 2 * float(np.prod(agree[g])), agree[g], radius) for g in groups]
        total = radius - parts + 1
        if sum(max(c) for c in costs) < total:
            continue
        cost, _ = allocate(costs, total)
        if best is None or cost < best[0]:
            best = (cost, groups)
    groups = best[1]
    # Now with the pairs of equal keys that there are.
    keys = unique.select(F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("key")) for i, g in enumerate(groups)])).alias("k")).select("k.*")
    equal = {r.part: r.pairs for r in keys.groupBy("part", "key").count().groupBy("part").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2.0).alias("pairs")).collect()}
    costs = [_cost(n, float(equal[i] or 0), agree[g], radius) for i, g in enumerate(groups)]
    _, thresholds = allocate(costs, radius - len(groups) + 1)
    return list(zip(groups, thresholds, strict=True))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(bits: Iterable[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def probe_masks(plan: list[tuple[list[int], int]]) -> list[list[int]]:
    """The bits that each probe compares: for a threshold t, every choice of t bits left out."""
    return [[b for b in bits if b not in out] for bits, t in plan if t >= 0 for out in combinations(bits, t)]


# Candidates of a key, verified.


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each index's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(fp: np.ndarray, run: np.ndarray, radius: int, more: Sequence[np.ndarray] = (), most: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fingerprints of the same run; runs are contiguous. With more fingerprints
    of each text, a link is also at most `most` bits apart in all of them together."""
    n = len(fp)
    size = np.bincount(run)
    start = np.cumsum(size) - size
    place, total = np.arange(n) - start[run], size[run]
    found_a, found_b, held = [], [], 0
    at = np.flatnonzero(total > 1)
    shift = 1
    while len(at := at[place[at] + shift < total[at]]):
        apart = np.bitwise_count(fp[at] ^ fp[at + shift])
        near = apart <= radius
        hit = at[near]
        if len(hit) and len(more):
            bits = apart[near].astype(np.int64)
            for x in more:
                bits += np.bitwise_count(x[hit] ^ x[hit + shift])
            hit = hit[bits <= most]
        if len(hit):
            found_a.append(hit)
            found_b.append(hit + shift)
            held += len(hit)
            if held > 8 * n + 100_000:  # keep a forest of what is known
                a, b = _forest(n, np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b, held = [a], [b], len(a)
        shift += 1
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _forest(n, np.concatenate(found_a), np.concatenate(found_b))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    label = _labels(n, a, b)
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def _verify(batches: Iterable[pa.RecordBatch], radius: int, keys: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by so many key columns; then the fingerprint; then, if any, more fingerprints and the id."""
    rest = None

    def emit(columns: list[np.ndarray]) -> pa.RecordBatch:
        fp, more, name = columns[keys], columns[keys + 1 : -1], columns[-1]
        new = np.zeros(len(fp), bool)
        for k in columns[:keys]:
            new[1:] |= k[1:] != k[:-1]
        a, b = _links(fp.view(np.uint64), np.cumsum(new), radius, [x.view(np.uint64) for x in more], most)
        return pa.record_batch([pa.array(name[a]), pa.array(name[b])], names=["a", "b"])

    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        if not len(columns[-1]):
            continue
        # The last key may go on in the next batch.
        same = np.ones(len(columns[-1]), bool)
        for k in columns[:keys]:
            same &= k == k[-1]
        other = np.flatnonzero(~same)
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield emit([c[:cut] for c in columns])
        rest = [c[cut:] for c in columns]
    if rest is not None and len(rest[-1]):
        yield emit(rest)
    give_back()


def _compared(rows: DataFrame, keys: list[str], radius: int, others: list[str], most: int) -> DataFrame:
    ordered = rows.select(*keys, "fp", *others).repartition(*keys).sortWithinPartitions(*keys, "fp")
    return ordered.mapInArrow(partial(_verify, radius=radius, keys=len(keys), most=most), "a long, b long")


def _probes(rows: DataFrame, masks: list[tuple[int, int]], others: list[str]) -> DataFrame:
    """A row for each (number, mask): the bits of fp under the mask are the key."""
    each = F.array(*[F.struct(F.lit(i).alias("probe"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in masks])
    return rows.select("fp", *others, F.explode(each).alias("k")).select("k.probe", "k.key", "fp", *others)


def links(unique: DataFrame, radius: int = 4, hot: int = HOT, others: Sequence[str] = (), most: int = 0) -> DataFrame:
    """a, b: edges with the components of all pairs of distinct fingerprints (fp) at most `radius` bits apart. With
    `others`, columns of more fingerprints and last of an id, rows are told by the id, fingerprints may repeat, and a
    pair is also at most `most` bits apart in all of its fingerprints together."""
    others = list(others)
    plan = plan_search(unique, radius)
    spark: SparkSession = unique.sparkSession
    if not plan:
        return spark.createDataFrame([], "a long, b long")
    bits = probe_masks(plan)
    rows = _probes(unique.select("fp", *others), [(i, _mask(b)) for i, b in enumerate(bits)], others)
    counts = written(rows.groupBy("probe", "key").count().where(F.col("count") > hot), "hot")
    if counts.isEmpty():
        return _compared(rows, ["probe", "key"], radius, others, most)
    cold = rows.join(counts, ["probe", "key"], "left_anti")
    # Hot keys: each probe has blocks of its own.
    blocks = F.array(*[_blocks([b for b in range(64) if b not in own], radius) for own in bits])
    warm = rows.join(counts.select("probe", "key"), ["probe", "key"])
    return _compared(cold, ["probe", "key"], radius, others, most).unionByName(_divided(warm, ["probe", "key"], F.get(blocks, F.col("probe")), radius, hot, others, most))


def _blocks(bits: list[int], radius: int) -> Column:
    """The masks of radius + 1 blocks of these bits: what is within the radius is equal on one of them."""
    return F.array(*[F.lit(_mask(bits[j :: radius + 1])) for j in range(radius + 1)])


def _divided(warm: DataFrame, keys: list[str], blocks: Column, radius: int, hot: int, others: list[str], most: int) -> DataFrame:
    """Links of hot keys: of fingerprints that are equal on one of the blocks."""
    warm = warm.select(*keys, "fp", *others, F.posexplode(blocks).alias("block", "mask"))
    warm = warm.select(*keys, "block", F.col("fp").bitwiseAND(F.col("mask")).alias("sub"), "fp", *others)
    keys = [*keys, "block", "sub"]
    sizes = warm.groupBy(*keys).count().where(F.col("count") > hot)
    sized = warm.join(sizes, keys, "left")
    large = sized.where("count is not null")
    found = _compared(sized.where("count is null"), keys, radius, others, most)
    if sizes.isEmpty():
        return found
    return found.unionByName(_around_pivots(large, keys, radius, hot, others, most))


def _around_pivots(large: DataFrame, keys: list[str], radius: int, hot: int, others: list[str], most: int) -> DataFrame:
    """Links of keys that stay large (with their count): stars around pivots, and what lies beyond in blocks. With
    `others` a key has PIVOTS of them, and all of their stars are joined."""
    names = ["fp", *others]
    node = names[-1]
    turn = F.xxhash64(node)
    n = PIVOTS if others else 1
    pivots = large.groupBy(*keys).agg(*[F.min(F.when(F.pmod(turn, F.lit(n)) == k, F.struct(turn.alias("_h"), *names))).alias(f"_p{k}") for k in range(n)])
    pivots = written(pivots, "pivots")
    joined = large.join(pivots, keys)

    def near(k: int) -> Column:
        apart = [F.bit_count(F.col(c).bitwiseXOR(F.col(f"_p{k}.{c}"))) for c in names[: len(names) - bool(others)]]
        close = apart[0] <= radius
        return F.coalesce(close & (sum(apart[1:], apart[0]) <= most) if others else close, F.lit(False))

    inside = near(0)
    for k in range(1, n):
        inside = inside | near(k)
    first = F.coalesce(*[F.col(f"_p{k}.{node}") for k in range(n)])
    told = written(joined.select(*keys, *names, "count", inside.alias("_in"), first.alias("_first")), "around")
    stars = told.where("_in").select(F.col(node).alias("a"), F.col("_first").alias("b"))
    beyond = told.where("not _in").groupBy(*keys).agg(F.ceil(F.count("*") / hot).cast("int").alias("_r"))
    blocks = told.join(beyond, keys).withColumn("_n", F.ceil(F.col("count") / hot).cast("int"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64(node, F.lit(1)), F.col(c)).cast("int")
    out = blocks.where("not _in").withColumn("x", own("_r")).withColumn("y", every("_n"))
    all_ = blocks.withColumn("y", own("_n")).withColumn("x", every("_r"))
    both = out.select(*keys, "x", "y", *names).unionByName(all_.select(*keys, "x", "y", *names)).distinct()
    return stars.unionByName(_compared(both, [*keys, "x", "y"], radius, others, most))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: the least doc_id that links reach."""
    prints = written(fingerprints(docs, words), "fingerprints")
    return _with_components(prints, radius, hot).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _with_components(prints: DataFrame, radius: int, hot: int = HOT) -> DataFrame:
    """prints (doc_id, fp) with component_id."""
    unique = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "unique")
    found = components(links(unique, radius, hot))
    grouped = unique.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = written(grouped.groupBy("label").agg(F.min("least").alias("component_id")), "least")  # so that the join can split a hot label
    of_print = grouped.join(least, "label").select("fp", "component_id")
    return prints.join(of_print, "fp")


# Near-duplicates by the exact similarity of their shingles.


def _sketch(hashes: np.ndarray) -> tuple[int, bytes]:
    """How many distinct hashes there are, or a number above SKETCH and not below that; the least SKETCH of them."""
    if len(hashes) > 4 * SKETCH:
        own = np.unique(np.partition(hashes, 4 * SKETCH - 1)[: 4 * SKETCH])
        if len(own) > SKETCH:
            return len(hashes), own[:SKETCH].tobytes()
    own = np.unique(hashes)
    return len(own), own[:SKETCH].tobytes()


def _several(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in steps(batches, limit=2 << 20):
        split = _normal(utf8(b.column("text")))
        hashes, has, m = shingles_of(split, words)
        fps = np.zeros((PRINTS, len(split)), np.uint64)
        for k in range(PRINTS if len(has) else 0):
            fps[k, has] = _majority(_mixed(hashes, k), m)
        sketches = [(0, b"")] * len(split)
        for i, x in zip(has.tolist(), np.split(hashes, np.cumsum(m)[:-1]) if len(has) else [], strict=True):
            sketches[i] = _sketch(x)
        digests = pa.array([hashlib.md5(x).digest() for x in split], pa.binary())
        keep = [c for c in b.schema.names if c != "text"]
        size = pa.array([len(x) for x in split], pa.int64())
        n, least = pa.array([x[0] for x in sketches], pa.int64()), pa.array([x[1] for x in sketches], pa.binary())
        yield pa.record_batch([*(b.column(c) for c in keep), size, digests, n, least, *(pa.array(x.view(np.int64)) for x in fps)], names=[*keep, "bytes", "digest", "shingles", "sketch", *(f"f{k}" for k in range(PRINTS))])


def _flat(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([pa.array(np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.int64))], names=["key"])


def _keyed(batches: Iterable[pa.RecordBatch], similarity: float, common: Broadcast) -> Iterator[pa.RecordBatch]:
    """A row for each key of a text, and whether it is a common one.

    Two texts that are similar share all but a few of their shingles. In any one order of all shingles, the first that they
    share is among the first n - ceil(similarity * n) + 1 of either, n being its number; beyond KEYS, the chance that none
    of the first is shared is 0.2 ** KEYS = 4e-9 at 0.8. The order is that of the hashes, with the common ones last:

    - n so small that the sketches of such a text and of all that may be similar are whole: the first in this order;
    - ENOUGH of the sketch uncommon: the first of those (a fourth of the sketch is common at most; then 0.27 ** KEYS = 1e-7);
    - else the first of those and the first of all.
    """
    apart = common.value
    for b in batches:
        size = pa.compute.binary_length(b.column("sketch")).to_numpy(zero_copy_only=False).astype(np.int64) // 8
        keys = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint64)
        if not len(keys):
            continue
        doc = np.repeat(np.arange(len(size)), size)
        rank = np.arange(len(keys)) - (np.cumsum(size) - size)[doc]
        often = apart[np.minimum(np.searchsorted(apart, keys), len(apart) - 1)] == keys if len(apart) else np.zeros(len(keys), bool)
        n_often = np.bincount(doc, often, len(size)).astype(np.int64)
        before = np.cumsum(often) - often - (np.cumsum(n_often) - n_often)[doc]  # common ones of the text that are less
        n = b.column("shingles").to_numpy()
        most = np.minimum(KEYS, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1)[doc]
        uncommon = (size - n_often)[doc]
        small = (n <= int(SKETCH * similarity))[doc]
        own = ~often & (rank - before < most)
        pick = np.flatnonzero(np.where(small, np.where(often, uncommon + before, rank - before) < most, own | ((uncommon < ENOUGH) & (rank < most))))
        at = pa.array(doc[pick])
        rest = [c for c in b.schema.names if c not in ("shingles", "sketch")]
        yield pa.record_batch([pa.array(keys[pick].view(np.int64)), pa.array(often[pick]), *(b.column(c).take(at) for c in rest)], names=["key", "often", *rest])


def _common(unique: DataFrame, least: int) -> np.ndarray:
    """The shingle hashes that more than `least` sketches have, sorted; `least` is doubled until BROADCAST_ROWS hold them."""
    counts = written(unique.select("sketch").mapInArrow(_flat, "key long").groupBy("key").count().where(F.col("count") > least), "common")
    while counts.where(F.col("count") > least).count() > BROADCAST_ROWS:
        least *= 2
    rows = counts.where(F.col("count") > least).select("key").toPandas()
    return np.sort(rows["key"].to_numpy(np.int64).view(np.uint64))


def sharing(unique: DataFrame, names: list[str], similarity: float, radius: int, searches: int, hot: int, most: int) -> DataFrame:
    """unique (node, shingles, sketch, fingerprints by these names) -> a, b: edges with the components of all pairs that
    share a key and are at most `most` bits apart in all fingerprints together. In a key of more than `hot` texts a pair is
    within `radius` bits in one of the first `searches` too."""
    common = unique.sparkSession.sparkContext.broadcast(_common(unique, min(COMMON, hot)))
    schema = "key long, often boolean, " + ", ".join(f"{f} long" for f in names) + ", node long"
    rows = unique.select("shingles", "sketch", *names, "node").mapInArrow(partial(_keyed, similarity=similarity, common=common), schema)
    own, others = F.col(names[0]).alias("fp"), [*names[1:], "node"]
    counts = written(rows.where("often").groupBy("key").count().where(F.col("count") > hot).select("key"), "hot")
    if counts.isEmpty():
        return _compared(rows.select("key", own, *others), ["key"], 64, others, most)
    counts = sized(counts)
    found = _compared(rows.join(counts, "key", "left_anti").select("key", own, *others), ["key"], 64, others, most)
    for name in names[:searches]:
        others = [*[f for f in names if f != name], "node"]
        warm = rows.join(counts, "key").select("key", F.col(name).alias("fp"), *others)
        found = found.unionByName(_divided(warm, ["key"], _blocks(list(range(64)), radius), radius, hot, others, most))
    return found


def similar_pairs(sets: list[np.ndarray], similarity: float, queries: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sets (distinct hashes each) whose Jaccard similarity is at least that, or those of the first `queries`
    sets with all others; two empty ones are equal."""
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    shared = times[column] > 1  # what one set alone has is in no intersection
    column, row = (np.cumsum(times > 1) - 1)[column[shared]], row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    most = n - 1 if queries is None else min(queries, n - 1)
    both = np.zeros((most, n), np.int32)
    width = 1 << 13
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, width):  # some columns at a time, as bits
        lo, hi = np.searchsorted(column, [k, k + width])
        part = np.zeros((n, min(width, -(-(int(column[-1]) + 1 - k) // 64) * 64)), bool)
        part[row[lo:hi], column[lo:hi] - k] = True
        bits = np.packbits(part, axis=1).view(np.uint64)
        for i in range(most):
            both[i, i + 1 :] += np.bitwise_count(bits[i + 1 :] & bits[i]).sum(1, dtype=np.int32)
    found = [i + 1 + np.flatnonzero(both[i, i + 1 :] * (1 + similarity) >= similarity * (size[i] + size[i + 1 :]) - 1e-9) for i in range(most)]
    return np.repeat(np.arange(most), [len(x) for x in found]), np.concatenate(found)


def _exact(batches: Iterable[pa.RecordBatch], words: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Batches (label, x, y, asks, node, text) sorted by the first three: a spanning forest of each group's similar pairs
    of which one text asks at least."""
    key, nodes, sets, asking = None, [], [], []

    def emit() -> pa.RecordBatch:
        order = np.argsort(~np.array(asking), kind="stable")
        n = int(sum(asking))
        a, b = similar_pairs([sets[i] for i in order.tolist()], similarity, n) if len(sets) > 1 and n else (np.zeros(0, np.int64),) * 2
        a, b = _forest(len(sets), a, b) if len(a) else (a, b)
        own = np.array(nodes, np.int64)[order]
        return pa.record_batch([pa.array(own[a]), pa.array(own[b])], names=["a", "b"])

    for b in steps(batches, limit=2 << 20):
        hashes, has, m = shingles_of(_normal(utf8(b.column("text"))), words)
        own = [np.zeros(0, np.uint64)] * b.num_rows
        for i, x in zip(has.tolist(), np.split(hashes, np.cumsum(m)[:-1]) if len(has) else [], strict=True):
            own[i] = np.unique(x)
        for k, node, asks, x in zip(zip(*(b.column(c).to_pylist() for c in ("label", "x", "y")), strict=True), b.column("node").to_pylist(), b.column("asks").to_pylist(), own, strict=True):
            if k != key and sets:
                yield emit()
                nodes, sets, asking = [], [], []
            key = k
            nodes.append(node)
            sets.append(x)
            asking.append(asks)
    if sets:
        yield emit()
        sets = []
    give_back()


def confirmed(families: DataFrame, texts: DataFrame, on: list[str], words: int, similarity: float, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """families (node, label, bytes, on), texts (on, text) -> a, b: edges with the components of all pairs of a family whose
    shingles are similar.

    A family of up to a block is compared in one task. A larger one is dealt into blocks twice, by two hashes, and the
    pairs inside these are compared: in a group of copies that joins nearly all. What isn't in the family's largest part
    then is compared with all of the family, in blocks. So each pair is compared that could still join two parts; a dense
    group takes linear work, a family of unlike texts work in proportion to its square.
    """
    keys, own = ["label", "x", "y"], lambda n, k=0: F.pmod(F.xxhash64("node", F.lit(k)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blocks = lambda: F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("bytes") / block_bytes), F.lit(1)).cast("int")
    several = sized(families.groupBy("label").agg(blocks().alias("n")).where("n > 1"))  # so that no family is one task's
    members = written(families.join(several, "label", "left").withColumn("n", F.coalesce("n", F.lit(1))), "members")

    def compared(rows: DataFrame) -> DataFrame:
        chosen = sized(rows.select(*keys, "asks", "node", *[c for c in on if c != "node"]))
        full = texts.join(chosen, on).select(*keys, "asks", "node", "text")
        return full.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(partial(_exact, words=words, similarity=similarity), "a long, b long")

    large = members.where("n > 1")
    once = [members.withColumn("x", own("n", k)).withColumn("y", F.lit(0)).withColumn("asks", F.lit(True)) for k in (0, 1)]
    found = compared(once[0])
    if large.isEmpty():
        return found
    found = written(found.unionByName(compared(once[1].where("n > 1"))), "inside")
    parts = _parts(large, found)
    most = parts.groupBy("label", "part").count().groupBy("label").agg(F.max_by("part", F.struct("count", "part")).alias("_most"))
    placed = written(parts.join(most, "label").withColumn("asks", F.col("part") != F.col("_most")).drop("part", "_most"), "parts")
    asking = placed.where("asks").groupBy("label").agg(blocks().alias("_r"))
    placed = placed.join(asking, "label")
    cross = placed.where("asks").withColumn("x", own("_r")).withColumn("y", every("n")).unionByName(placed.withColumn("asks", F.lit(False)).withColumn("y", own("n")).withColumn("x", every("_r")))
    return found.unionByName(compared(cross))


def _parts(members: DataFrame, edges: DataFrame) -> DataFrame:
    """The members with the part of their family that the edges make."""
    joined = components(edges).select("node", F.col("label").alias("part"))
    return members.join(joined, "node", "left").withColumn("part", F.coalesce("part", "node"))


def _located(docs: DataFrame) -> DataFrame:
    """file, place, doc: the rows with a key that is found again when the table is read once more. A table of files is
    read as it stands; anything else is written first."""
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    if "_metadata" not in docs.columns:
        try:
            return docs.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"), doc)
        except AnalysisException:
            pass  # not a table of files
    return written(docs.select(doc), "rows").select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"), "doc")


def keep_one(docs: DataFrame, words: int = 5, radius: int = RADIUS, similarity: float = 0.8, searches: int = SEARCHES, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """The documents without near-duplicates of a smaller doc_id, with all their columns. Links are pairs of texts whose
    sets of shingles have a Jaccard similarity of at least `similarity`, exactly; of each component the row of the least
    (doc_id, row key) stays, and every row without an id.

    Texts that are equal but for case and white space are collapsed first. Each other text has PRINTS independent
    fingerprints. Families are the components of pairs that share one of their least shingle hashes and are within APART
    bits in all fingerprints together (where more than `hot` share a hash, within `radius` bits in one of the first `searches`
    too); inside a family every pair is compared that could join two of its parts. So a search only has to bring a pair into
    one family, and what is contracted before the comparison loses no link.
    """
    rows, key = _located(docs), ["file", "place"]
    texts = rows.select(*key, F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").alias("text"))
    names = [f"f{k}" for k in range(PRINTS)]
    prints = written(texts.mapInArrow(partial(_several, words=words), "file long, place long, doc_id long, bytes long, digest binary, shingles long, sketch binary, " + ", ".join(f"{f} long" for f in names)), "fingerprints")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *key))).alias("least")
    unique = prints.groupBy("digest").agg(F.min(F.struct(*key, "bytes", *names, "shingles", "sketch")).alias("s"), least)
    unique = written(unique.select(F.monotonically_increasing_id().alias("node"), "s.*", "least"), "unique")
    near = sharing(unique, names, similarity, radius, searches, hot, APART)
    families = components(near).join(unique.select("node", *key, "bytes"), "node")
    linked = components(confirmed(families, texts.select(*key, "text"), key, words, similarity, block))
    grouped = unique.select("node", "least").join(linked, "node", "left").withColumn("label", F.coalesce("label", "node"))
    stay = grouped.groupBy("label").agg(F.min("least").alias("least")).where("least is not null").select("least.file", "least.place")
    gone = written(prints.where("doc_id is not null").select(*key).join(stay, key, "left_anti"), "gone")
    return rows.join(sized(gone), key, "left_anti").select("doc.*")
