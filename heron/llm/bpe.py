"""BPE encoding and decoding by a pair occurrence index.

The words that a partition's next texts bring are laid out in one array of symbols. An index maps each pair of
neighbouring symbols to all its positions there. The active ranks are applied in ascending order: each merge is made at
all positions of its pair together, and the positions of the pairs to the left and right are added to theirs.

Cases: a null text counts as empty; an empty text has no ids and decodes to the empty string; repeated rows give equal
rows; a null id stays null; other columns of the input are ignored, whatever their names; an empty table gives an empty result. A text of any
length is taken whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import operator
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import _BYTE_LEVEL_OF, _LATIN, Codec, PairRanks
from .common import steps, strings

#: Words that a worker remembers.
KEEP = 150_000
#: Bytes of text that are encoded together.
STEP = 4 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Partners:
    """For each id, the ids that it makes a pair with on one side, in order, and the pairs' ranks."""

    def __init__(self, own: np.ndarray, other: np.ndarray, made: np.ndarray):
        order = np.lexsort((other, own))
        self.other, self.rank = other[order], order
        self.at = np.searchsorted(own[order], np.arange(max(own.max(initial=0), made.max(initial=0)) + 2)).tolist()

    def places(self, new: int, beside: np.ndarray, place: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """The places where `new` makes a pair with what is beside it, by the pair's rank."""
        x, y = self.at[new], self.at[new + 1]
        if x == y:
            return []
        at = np.searchsorted(self.other[x:y], beside)
        at[at == y - x] = 0
        found = np.flatnonzero(self.other[x:y][at] == beside)
        if not len(found):
            return []
        at = at[found]
        order = np.argsort(at, kind="stable")
        at, place = at[order], place[found[order]]
        cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
        ranks = self.rank[x:y][at[np.append(0, cuts)]].tolist()
        bounds = [0, *cuts.tolist(), len(at)]
        return [(j, place[u:w]) for j, u, w in zip(ranks, bounds[:-1], bounds[1:], strict=True)]


class PairIndexBpe(Codec):
    """The ids of the tokenizers library for a word-end vocabulary, by merges of our own."""

    def __init__(self, path: str):
        super().__init__(path)
        self.words: dict[str, str] = {}  # a word's ids, each as a character
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        token = {i: t for t, i in self.vocab.items()} | {int.from_bytes(b, "little"): s for s, b in self.special.items()}
        self.token = pa.array([token.get(i) for i in range(max(token) + 1)], pa.large_string())
        self.decimal = pa.array(map(str, range(max(token) + 1)), pa.large_string())
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        v = self.vocab
        left, right = (np.array([self.vocab[x[k]] for x in pairs], np.int32) for k in (0, 1))
        self.pair_of = list(zip(left.tolist(), right.tolist(), strict=True))
        #: The pairs that have an id on the right, by it and the id on the left, and the other way round.
        self.by_right, self.by_left = Partners(right, left, self.made), Partners(left, right, self.made)
        least = np.full(max(self.vocab.values()) + 1, len(pairs))
        np.minimum.at(least, left, np.arange(len(pairs)))
        np.minimum.at(least, right, np.arange(len(pairs)))
        self.early = (least[self.made] < np.arange(len(pairs))).tolist()  # whether a merge can make a pair of lower rank
        v = self.vocab
        self.first_of, self.last_of = np.full(1 << 9, -1, np.int64), np.full(1 << 9, -1, np.int64)
        for c, i in v.items():
            if len(c) == 1 and ord(c) < 1 << 9:
                self.first_of[ord(c)] = i
            elif len(c) == 1 + len(self.end) and c.endswith(self.end) and ord(c[0]) < 1 << 9:
                self.last_of[ord(c[0])] = i

    def merge(self, words: list[str]) -> list[str]:
        """Each word's ids, as characters. Words are in the byte-level alphabet, so a line end can stand between them."""
        if not words:
            return []
        chars = np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le"), "<u4")
        ends = np.flatnonzero(chars == 10)
        sym = self.first_of[chars]
        sym[ends - 1] = self.last_of[chars[ends - 1]]
        sym[ends] = -1  # no pair spans it
        n = len(sym)
        first = self.pairs.of(sym[:-1], sym[1:])
        first[(sym[:-1] < 0) | (sym[1:] < 0)] = PairRanks.NONE
        at = np.flatnonzero(first != PairRanks.NONE)
        at = at[np.argsort(first[at], kind="stable")]
        active, cuts = np.unique(first[at], return_index=True)
        index = {k: [x] for k, x in zip(active.tolist(), np.split(at, cuts[1:]), strict=True)}
        heap = active.tolist()  # in order already
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        while heap:
            k = heapq.heappop(heap)
            lists = index.pop(k)
            p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))  # each in order
            a, b = self.pair_of[k]
            q = after[p]
            there = (sym[p] == a) & (sym[q] == b)  # else another merge has taken one of the two
            p, q = p[there], q[there]
            if self.early[k] and len(p):  # a pair that this makes may go before the word's next places
                word = np.searchsorted(ends, p)
                lead = np.append(True, word[1:] != word[:-1])
                if not lead.all():
                    index[k] = [p[~lead]]
                    heapq.heappush(heap, k)
                    p, q = p[lead], q[lead]
            if a == b and len(p) > 1:  # of places that overlap every second one is left
                number = np.arange(len(p))
                number -= np.maximum.accumulate(np.where(np.append(False, q[:-1] == p[1:]), 0, number))
                p, q = p[number % 2 == 0], q[number % 2 == 0]
            if not len(p):
                continue
            new = self.made[k]
            sym[p], sym[q] = new, -2
            r = after[q]
            after[p], before[r] = r, p
            left = before[p]
            for partners, beside, place in ((self.by_right, sym[left], left), (self.by_left, sym[r], p)):
                for j, more in partners.places(new, beside, place):
                    if j in index:
                        index[j].append(more)
                    else:
                        index[j] = [more]
                        heapq.heappush(heap, j)
        count = np.cumsum(sym >= 0)[ends].tolist()
        ids = sym[sym >= 0].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return list(map(ids.__getitem__, map(slice, [0, *count[:-1]], count)))

    def learn(self, pieces: list[str]) -> None:
        """New pieces: their distinct words are merged together, and laid out again by piece."""
        latin = list(map(bool, map(_LATIN.fullmatch, pieces)))
        order = list(compress(pieces, latin))
        flat, size = [], np.zeros(0, np.int64)
        if order:
            words = "\0".join(self.latin_lines.findall("\n".join(order).lower())).encode().decode("latin-1").translate(_BYTE_LEVEL_OF)
            words = words.replace("\0\n\0", "\n")
            size = np.fromiter((x.count("\0") + 1 for x in words.split("\n")), np.int64, len(order))
            flat = words.replace("\n", "\0").split("\0")
        if len(order) < len(pieces):
            for p in compress(pieces, map(operator.not_, latin)):
                own = [x for x, _ in self.pre(self.normal(p))]
                order.append(p)
                flat += own
                size = np.append(size, len(own))
        coded = pa.array(flat, pa.large_string()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.words) > KEEP:
            self.words = {}
        new = [w for w in words if w not in self.words]
        self.words.update(zip(new, self.merge(new), strict=True))
        told = list(map(self.words.__getitem__, words))
        ids, at = gathered("".join(told).encode("utf-32-le", "surrogatepass"), np.fromiter(map(len, told), np.int64, len(told)), coded.indices.to_numpy())
        raw = ids.tobytes()
        cuts = (at[np.append(0, np.cumsum(size))] * 4).tolist()
        self.kept.update(zip(order, map(raw.__getitem__, map(slice, cuts[:-1], cuts[1:])), strict=True))

    def written_out(self, encoded: list[bytes]) -> tuple[pa.Array, pa.Array]:
        """Texts of ids in decimal, and of tokens, from texts of ids."""
        at = pa.array(np.append(0, np.cumsum(list(map(len, encoded)), dtype=np.int64)) // 4)
        ids = pa.array(np.frombuffer(b"".join(encoded), "<u4"))
        decimal, tokens = (pa.compute.binary_join(pa.LargeListArray.from_arrays(at, table.take(ids)), pa.scalar(" ", pa.large_string())) for table in (self.decimal, self.token))
        return decimal, tokens

    def encode_decode(self, texts: list[str]) -> list[tuple[str, str]]:
        """Each text's ids in decimal and its decoded text."""
        decimal, decoded = self.written_out(self.encode(texts))
        return list(zip(decimal.to_pylist(), decoded.to_pylist(), strict=True))


def gathered(ids: bytes, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids that are told once for each number (`size` of them), laid out by the numbers in `code`, and where each of these begins."""
    n = size[code]
    end = np.append(0, np.cumsum(n))
    start = (np.cumsum(size) - size)[code]
    return np.frombuffer(ids, "<u4")[np.arange(end[-1]) + np.repeat(start - end[:-1], n)], end


@lru_cache(maxsize=4)
def pair_index_bpe(path: str) -> PairIndexBpe:
    return PairIndexBpe(path)


def _hexed(texts: pa.Array) -> pa.Array:
    """The SHA-256 of each value's UTF-8."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
    data = memoryview(texts.buffers()[2] or b"")
    return pa.array([hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)], pa.string())


def _digests(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = pair_index_bpe(path)
    for b in steps(batches, limit=STEP):
        encoded = bpe.encode(strings(b.column("text")))
        decimal, decoded = bpe.written_out(encoded)
        yield pa.record_batch(
            [b.column("doc_id"), pa.array([len(x) // 4 for x in encoded], pa.int64()), _hexed(decimal), _hexed(decoded)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _encoded(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = pair_index_bpe(path)
    for b in steps(batches, limit=STEP):
        encoded = bpe.encode(strings(b.column("text")))
        ids = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in encoded], pa.list_(pa.int32()))
        decoded = bpe.written_out(encoded)[1].cast(pa.string())
        yield pa.record_batch([b.column("doc_id"), ids, decoded], names=["doc_id", "ids", "decoded"])


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_encoded, path=path), "doc_id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the decoded text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_digests, path=path), SCHEMA)
