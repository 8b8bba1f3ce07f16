"""A hashed maximum-entropy language model with a class-factored softmax.

log P(token | context) = log P(class | context) + log P(bucket | class, context) + log P(token | bucket).

The class of a word is a hash of its first bytes, its bucket in the class a hash of the whole; the end of a text is a
class of its own. The first two factors are softmaxes whose scores add up the hashed weights of the same features: the
word before, the word before that (a skip over one), both together, and none (the bias). For the second the class is
hashed into each feature, so every class has scores of its own. The last factor is the token's share of its bucket,
smoothed, with a place for unknown words. So the probabilities of all known words and one unknown word a bucket sum to one.

Training goes over every training text once, in rounds of growing parts of them. A task starts from the weights of the
round before, makes gradient steps over units of about UNIT bytes, and sends the sums over its units of the weights,
each row by the gradients that it had, so that a row which few units met is not diluted (iterative parameter mixing).
Small partitions are put together to whole units, so the weights hang little on how the table is split. The sums are
added up in two levels. The tasks count words on the way. Words are known by their 64-bit hash; what a task holds is
bounded, and the weights' number (ROWS) is a parameter.

Scoring holds the weights and the TOP most frequent words in each task (both bounded). The count of any other token is
joined by hash, so every count is exact, and texts are put together again by a row key.

Cases: a null or empty text is its end token alone; words of A-Z are lower-cased; a null doc_id belongs to the training
texts; repeated rows and repeated ids are scored each on its own, equal texts alike; a text of any length is taken whole,
as a step of its own; without training tokens all counts are 0; an empty table gives an empty result; other columns are
never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, steps, utf8, written
from .xxh import xxh64

#: Classes, and buckets of a class.
CLASSES = 32
#: Rows of hashed weights by feature (the word before, the word before that, both), for classes and for buckets.
ROWS, ROWS_IN_CLASS = (4096, 4096, 8192), (8192, 8192, 16384)
TABLES = (*(a + b for a, b in zip(ROWS, ROWS_IN_CLASS, strict=True)), 1 + CLASSES)
TOP = 1 << 18
#: Tokens of a gradient step; words that a training task counts before it sends them on; bytes of text of a unit.
BATCH, HELD, UNIT = 8192, 1 << 20, 8 << 20
RATE = 0.8
#: The rounds' shares of the training texts.
ROUNDS = (0.25, 0.75)
SLICES = 64
END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127)
_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0x9FB21C651E98DF25], np.uint64)
ADD = 0.1


@dataclass
class Tokens:
    hash: np.ndarray  # by token
    label: np.ndarray  # its class times CLASSES plus its bucket
    doc: np.ndarray  # its text
    rows: list[np.ndarray]  # by decision: its rows in the tables; first the classes of all tokens, then the words' buckets
    choice: np.ndarray  # by decision: what is chosen
    of: np.ndarray  # by decision: its token


def tokens_of(texts: list[bytes]) -> Tokens:
    split = [b" ".join(t.lower().split()) for t in texts]
    n = np.array([s.count(b" ") + 1 if s else 0 for s in split], np.int64)
    data = b"\n".join(s for s in split if s) + b"\n"
    chars = np.frombuffer(data + bytes(4), np.uint8)
    end = np.flatnonzero((chars == 32) | (chars == 10))
    if not n.any():
        end = end[:0]
    begin = np.append(0, end[:-1] + 1) if len(end) else end
    total = int(n.sum()) + len(n)
    doc = np.repeat(np.arange(len(n)), n + 1)
    close = np.cumsum(n + 1) - 1
    word = np.ones(total, bool)
    word[close] = False
    h, kind = np.full(total, END), np.zeros(total, np.int64)
    if len(end):
        h[word] = xxh64(data, begin, end - begin, 3)
        first = np.zeros(len(begin), np.uint64)
        for j in range(3):
            first |= np.where(begin + j < end, chars[begin + j].astype(np.uint64) + np.uint64(1), 0).astype(np.uint64) << np.uint64(9 * j)
        kind[word] = ((first * _ODD[0]) >> np.uint64(40)).astype(np.int64) % (CLASSES - 1) + 1
    bucket = np.where(word, (h >> np.uint64(17)).astype(np.int64) % CLASSES, 0)
    one, two = np.full(total, START), np.full(total, START)
    one[1:], two[2:] = h[:-1], h[:-2]
    open_ = np.append(0, close[:-1] + 1)
    one[open_] = START
    two[open_] = START
    two[np.minimum(open_ + 1, total - 1)[n > 0]] = START
    pick = lambda x, rows: (x >> np.uint64(64 - int(rows).bit_length() + 1)).astype(np.int32)
    words = np.flatnonzero(word)
    features = [one * _ODD[1], two * _ODD[2], (one * _ODD[3] ^ two) * _ODD[1]]
    own = kind[words].astype(np.uint64) * _ODD[0]
    rows = [np.concatenate([pick(x, a), a + pick((x[words] ^ own) * _ODD[3], b)]) for x, a, b in zip(features, ROWS, ROWS_IN_CLASS, strict=True)]
    rows.append(np.concatenate([np.zeros(total, np.int32), 1 + kind[words].astype(np.int32)]))
    return Tokens(h, kind * CLASSES + bucket, doc, rows, np.concatenate([kind, bucket[words]]), np.concatenate([np.arange(total), words]))


def _scores(weights: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """The choices' scores of some decisions, the largest zero."""
    z = weights[0].take(rows[0], axis=0)
    for w, r in zip(weights[1:], rows[1:], strict=True):
        z += w.take(r, axis=0)
    z -= z.max(1, keepdims=True)
    return z


def softmax(weights: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """The choices' probabilities of some decisions."""
    z = _scores(weights, rows)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def log_chosen(weights: list[np.ndarray], rows: list[np.ndarray], choice: np.ndarray) -> np.ndarray:
    """Natural logarithms of the probabilities of what was chosen."""
    z = _scores(weights, rows)
    own = z[np.arange(len(choice)), choice]
    np.exp(z, out=z)
    return own - np.log(z.sum(1))


class Trainer:
    """Gradient steps from some weights, with a rate of its own for each row (by the gradients it has had)."""

    def __init__(self, weights: list[np.ndarray] | None = None, had: list[np.ndarray] | None = None):
        self.weights = [w.copy() for w in weights] if weights else [np.zeros((r, CLASSES), np.float32) for r in TABLES]
        self.before = had or [np.zeros(r, np.float32) for r in TABLES]
        self.had = [x.copy() for x in self.before]

    def learn(self, t: Tokens) -> None:
        """Steps of BATCH tokens, in their order: the decisions of these tokens together."""
        total, words = len(t.hash), t.of[len(t.hash) :]
        for a in range(0, total, BATCH):
            b = min(a + BATCH, total)
            lo, hi = total + np.searchsorted(words, [a, b])
            rows = [np.concatenate([r[a:b], r[lo:hi]]) for r in t.rows]
            choice = np.concatenate([t.choice[a:b], t.choice[lo:hi]])
            g = softmax(self.weights, rows)
            g[np.arange(len(choice)), choice] -= 1
            for w, had, r in zip(self.weights, self.had, rows, strict=True):
                order = np.argsort(r.astype(np.uint16), kind="stable")
                ordered = r[order]
                start = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
                own = ordered[start]
                step = np.add.reduceat(g.take(order, axis=0), start, axis=0)
                had[own] += (step * step).sum(1)
                w[own] -= RATE * step / np.sqrt(had[own] + 1)[:, None]

    def sums(self) -> np.ndarray:
        """The weights, each row times the gradients that it had here; these gradients; all that it ever had; and one."""
        new = [h - b for h, b in zip(self.had, self.before, strict=True)]
        return np.concatenate([*((w * n[:, None]).ravel() for w, n in zip(self.weights, new, strict=True)), *new, *self.had, [1]]).astype(np.float64)


SIZE = sum(TABLES) * (CLASSES + 2) + 1


def mixed(flat: np.ndarray, before: list[np.ndarray] | None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Weights and gradients of the next round from the sums of all units."""
    n, k = sum(TABLES), sum(TABLES) * CLASSES
    w, new, had, units = flat[:k].reshape(n, CLASSES), flat[k : k + n], flat[k + n : k + 2 * n], max(flat[-1], 1)
    old = np.concatenate(before) if before else np.zeros((n, CLASSES))
    w = np.where(new[:, None] > 0, w / np.maximum(new, 1e-30)[:, None], old).astype(np.float32)
    cuts = np.cumsum(TABLES)[:-1]
    return np.split(w, cuts), np.split((had / units).astype(np.float32), cuts)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


PASS = "hash long, label int, n long, part int, sums binary"


def _counts(h: np.ndarray, label: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, label, n = h[order], label[order], n[order]
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[start], label[start], np.add.reduceat(n, start) if len(h) else n


def _train(batches: Iterable[pa.RecordBatch], begun: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """Word counts (hash, label, n), and the sums over the task's units in slices (label: the slice, part: the task)."""
    start = begun.value if begun else (None, None)
    total, trainer, used = None, None, 0
    held: list[tuple] = []

    def send(c: tuple) -> pa.RecordBatch:
        n = len(c[0])
        return pa.record_batch([pa.array(c[0].view(np.int64)), pa.array(c[1].astype(np.int32)), pa.array(c[2]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=[x.split()[0] for x in PASS.split(", ")])

    for b in steps(batches, limit=2 << 20):
        texts = sorted(utf8(b.column("text")), key=zlib.crc32)  # so that the table's order matters less
        t = tokens_of(texts)
        trainer = trainer or Trainer(*start)
        trainer.learn(t)
        used += sum(map(len, texts))
        if used >= UNIT:
            total, trainer, used = trainer.sums() if total is None else total + trainer.sums(), None, 0
        held.append(_counts(t.hash, t.label, np.ones(len(t.hash), np.int64)))
        if sum(len(x[0]) for x in held) > HELD:
            held = [_counts(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            if len(held[0][0]) > HELD // 2:
                yield send(held.pop())
    if held:
        yield send(_counts(*(np.concatenate(x) for x in zip(*held, strict=True))))
    if trainer:
        total = trainer.sums() if total is None else total + trainer.sums()
    if total is not None:
        parts = [p.astype("<f4").tobytes() for p in np.array_split(total, SLICES)]
        yield pa.record_batch([pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()), pa.nulls(SLICES, pa.int64()), pa.array([TaskContext.get().partitionId()] * SLICES, pa.int32()), pa.array(parts, pa.binary())], names=[x.split()[0] for x in PASS.split(", ")])
    give_back()


def _sum(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the slices (label) that this task got."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, w in zip(b.column("label").to_pylist(), b.column("sums").to_pylist(), strict=True):
            x = np.frombuffer(w, "<f4")
            if k in sums:
                sums[k] += x
            else:
                sums[k] = x.astype(np.float64)
    if sums:
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.astype("<f4").tobytes() for x in sums.values()], pa.binary())], names=["label", "sums"])


class Table:
    """The places of hashes in a sorted array, by their high bits and a short walk."""

    def __init__(self, hashes: np.ndarray):
        self.bits = max(1, int(len(hashes)).bit_length())
        self.hashes = np.append(hashes, ~np.uint64(0))
        self.first = np.searchsorted(hashes, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        self.size = len(hashes)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each, or -1."""
        at = self.first[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        live = np.flatnonzero(self.hashes[at] < h)
        while len(live):
            at[live] += 1
            live = live[self.hashes[at[live]] < h[live]]
        return np.where((self.hashes[at] == h) & (at < self.size), at, -1)


@dataclass
class Model:
    """What each scoring task holds."""

    weights: list[np.ndarray]
    hashes: np.ndarray  # of the most frequent words, sorted
    logs: np.ndarray  # log10(count + ADD) of these
    share: np.ndarray  # log10 of the smoothed tokens of each bucket


SCORED = "key long, doc_id long, held_out boolean, n_tokens long, n_top long, logs double, shares double, rare array<long>"


def _score(batches: Iterable[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    m: Model = model.value
    table = Table(m.hashes)
    key = TaskContext.get().partitionId() << 40
    for b in steps(batches, limit=2 << 20):
        docs = b.column("doc_id").to_pylist()
        t = tokens_of(utf8(b.column("text")))
        chosen = np.empty(len(t.choice))
        for a in range(0, len(t.choice), BATCH):
            e = min(a + BATCH, len(t.choice))
            chosen[a:e] = log_chosen(m.weights, [r[a:e] for r in t.rows], t.choice[a:e])
        share = np.bincount(t.of, weights=chosen, minlength=len(t.hash)) / np.log(10) - m.share[t.label]
        at = table.find(t.hash)
        top = at >= 0
        n = len(docs)
        by = lambda x: np.bincount(t.doc, weights=x, minlength=n)
        rare = t.hash[~top].view(np.int64)
        size = np.bincount(t.doc[~top], minlength=n)
        yield pa.record_batch(
            [
                pa.array(np.arange(key, key + n)),
                pa.array(docs, pa.int64()),
                pa.array([held_out(d) for d in docs]),
                pa.array(np.bincount(t.doc, minlength=n)),
                pa.array(by(top).astype(np.int64)),
                pa.array(by(np.where(top, m.logs[at] if len(m.logs) else 0.0, 0.0))),
                pa.array(by(share)),
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(rare)),
            ],
            names=[x.split()[0] for x in SCORED.split(", ")],
        )
        key += n


def _part(rounds: tuple[float, ...]) -> tuple[Column, Column]:
    """Whether a text is held out, and its round, by the CRC-32 of its id; a null id is in the first round."""
    crc = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1))
    place = F.pmod(F.floor(crc / 10), F.lit(1000)) / 1000
    number = sum((place >= float(x)).cast("int") for x in np.cumsum(rounds)[:-1]) if len(rounds) > 1 else F.lit(0)
    return crc % 10 == 0, number


def train(docs: DataFrame, top: int = TOP, rounds: tuple[float, ...] = ROUNDS, unit: int = UNIT) -> tuple[DataFrame, Model, int, int]:
    """The counts of all words (hash, n), the model, the tokens and the distinct ones. The driver gets the weights, the
    most frequent words and sums by bucket, all of bounded size."""
    spark = docs.sparkSession
    out, number = _part(rounds)
    texts = docs.select(F.col("doc_id").cast("long"), "text").where(~out)
    size = {r.k: r.size for r in texts.groupBy(number.alias("k")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size")).collect()}  # a row a round
    weights = had = words = None
    bounds = np.cumsum([0, *(len(x) for x in np.array_split(np.zeros(SIZE, np.int8), SLICES))])
    for k in range(len(rounds)):
        tasks = max(1, -(-size.get(k, 0) // unit))  # fewer partitions than that stay as they are
        begun = spark.sparkContext.broadcast((weights, had)) if weights else None
        sent = written(texts.where(number == k).coalesce(tasks).mapInArrow(partial(_train, begun=begun), PASS), "trained")
        counted = sent.where("sums is null").select("hash", "label", "n")
        words = counted if words is None else words.unionByName(counted)
        width = max(1, int(tasks**0.5))  # so that no task adds up more than the root of their number
        slices = sent.where("sums is not null").select("label", (F.col("part") % width).alias("part"), "sums")
        first = slices.repartition("label", "part").mapInArrow(_sum, "label int, sums binary")
        flat = np.zeros(SIZE)
        for label, w in first.repartition("label").mapInArrow(_sum, "label int, sums binary").collect():  # SLICES rows
            flat[bounds[label] : bounds[label + 1]] = np.frombuffer(w, "<f4")
        weights, had = mixed(flat, weights)
    counts = written(words.groupBy("hash", "label").agg(F.sum("n").alias("n")), "counts")
    mass = np.zeros((CLASSES * CLASSES, 2))
    for r in counts.groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # a row a bucket
        mass[r.label] = r.n, r.v
    # The most frequent words, by steps of an eighth of a power of two so that no task sorts or sends more than it has to.
    step = F.floor(F.log2("n") * 8).cast("int")
    kept, least = 0, 1 << 20
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):  # 512 rows at most
        if kept + r["count"] > top:
            break
        kept, least = kept + r["count"], r.step
    rows = counts.where(step >= least).select("hash", "n").toPandas()  # at most `top` rows
    h, n = rows["hash"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.float64)
    order = np.argsort(h)
    model = Model(weights, h[order], np.log10(n[order] + ADD), np.log10(mass[:, 0] + ADD * (mass[:, 1] + 1)))
    return counts.select("hash", "n"), model, int(mass[:, 0].sum()), int(mass[:, 1].sum())


def score(docs: DataFrame, counts: DataFrame, model: Model, tokens: int, distinct: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_score, model=shared), SCORED), "scored")
    rare = scored.select("key", F.explode("rare").alias("hash"))
    found = rare.join(counts, "hash", "left").groupBy("key").agg(F.count("n").alias("n_rare"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD))).alias("rare_logs"))
    out = scored.drop("rare").join(found, "key", "left").withColumn("all_logs", F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)))
    base = float(np.log10(tokens + ADD * (distinct + 1)))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_top") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("all_logs") - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("all_logs") + F.col("shares")).alias("score"),
    )


def score_documents(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Trains on the texts that aren't held out and scores all."""
    counts, model, tokens, distinct = train(docs, top)
    return score(docs, counts, model, tokens, distinct)
