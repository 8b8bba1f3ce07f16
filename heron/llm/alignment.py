"""Cross-tokenizer alignment: which tokens of one vocabulary lie over which of another, and how usual each link is.

A transducer reads the tokens of both sides, always of the side that is behind. Its state is the dangling suffix: which
side leads, and that side's bytes that the other has not matched. A transition depends on the state and the next token alone
and is kept; when it leaves nothing dangling, a group closes. Two tokens are linked when they lie in one group.

A text is cut at white space where neither vocabulary has a token across, so that both sides end there, and each distinct
unit goes through the tokenizers and the transducer as long as a worker remembers it (KEEP). New units go through the
transducer side by side, a step of all of them at a time; its states are numbers, and its kept transitions a sorted table.
Texts are put together from their units by Arrow and numpy, a block of about BLOCK bytes at a time. A block is written with
its documents' links as numbers into the block's own list of id pairs; the pairs are summed up over all blocks by id pair,
and come back to each block, whose documents are then summed up with reduceat.

Sides: A is a byte-level BPE of the tokenizers library and reads the space and the text; B is a sentencepiece model, which
puts the space there itself. Special tokens written out in a text are plain text.

Cases: a null or empty text, and one whose tokens' bytes do not give the space and the text back on both sides, has no
tokens: zeros and ''. A text of any length is taken whole, and is a block of its own if it is longer than one. Equal ids and
repeated rows are documents of their own, as are rows without an id, whose doc_id stays null; ties for the highest count all
count as best; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import BYTE_CHARS, SPACE, codec
from .common import give_back, sized, steps, strings, written

#: Units, and transitions, that a worker remembers.
KEEP, MOVES = 250_000, 1_000_000
#: Bytes of text in a block; units that go through the tokenizers together; characters of one that the codec remembers.
BLOCK, LEARN, LONG = 8 << 20, 32768, 256
_RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\v", "\f", "\r", "\0")
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ONE_BYTE = re.compile("<0x([0-9A-F]{2})>")

BLOCKS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, idx int, a int, b int, docs long"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start[k] ... start[k] + size[k] - 1 of each k, one after another."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sum of each run of `size` values."""
    out = np.zeros(len(size), np.int64)
    full = np.flatnonzero(size)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(size) - size)[full])
    return out


class Transducer:
    """States are pairs (side that leads, its unmatched bytes); in the first one nothing dangles, and side 0 (A) reads."""

    NO = -1

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.tokens = (a_bytes, b_bytes)
        self.width = max(len(a_bytes), len(b_bytes))
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple[int, bytes]] = [(1, b"")]
        self.number = {self.states[0]: 0}
        self.reads = np.zeros(1, np.int64)
        self.keys, self.to = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def move(self, leads: int, residual: bytes, token: int) -> tuple[int, bytes] | None:
        """The state after a token of the side that is behind; None if its bytes differ from the residual."""
        side = 1 - leads
        x = self.tokens[side][token]
        n = len(residual)
        if len(x) <= n:
            rest = residual[len(x) :] if residual.startswith(x) else None
            return None if rest is None else (leads, rest) if rest else (1, b"")
        return (side, x[n:]) if x.startswith(residual) else None

    def moved(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Many transitions at once. New ones are made, and kept by residual and token."""
        key = state * self.width + token
        at = np.searchsorted(self.keys, key)
        new = np.unique(key[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != key)] if len(self.keys) else key)
        if len(new):
            made = []
            for k in new.tolist():
                to = self.move(*self.states[k // self.width], k % self.width)
                if to is not None and to not in self.number:
                    self.number[to] = len(self.states)
                    self.states.append(to)
                made.append(self.NO if to is None else self.number[to])
            keys = np.concatenate([self.keys, new])
            order = np.argsort(keys, kind="stable")
            self.keys, self.to = keys[order], np.concatenate([self.to, np.array(made, np.int64)])[order]
            more = self.states[len(self.reads) :]
            self.reads = np.concatenate([self.reads, np.array([1 - leads for leads, _ in more], np.int64)])
            at = np.searchsorted(self.keys, key)
        return self.to[at]

    def groups(self, ids: np.ndarray, size: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids: the A tokens of all units, then the B tokens of all; size: how many a unit has on each side. The number of
        each token's group in its unit, how many groups a unit has, and whether its two sides have the same bytes."""
        if len(self.keys) > MOVES:
            self.forget()
        at = np.stack([np.cumsum(size[0]) - size[0], int(size[0].sum()) + np.cumsum(size[1]) - size[1]])
        end = at + np.stack(size)
        group, own, same = np.zeros(len(ids), np.int64), np.zeros(len(size[0]), np.int64), np.zeros(len(size[0]), bool)
        state, live = np.zeros(len(size[0]), np.int64), np.arange(len(size[0]))
        while len(live):
            side = self.reads[state[live]]
            place = at[side, live]
            over = place >= end[side, live]
            if over.any():
                done = live[over]
                same[done] = (state[done] == 0) & (at[1, done] >= end[1, done])
                live, side, place = live[~over], side[~over], place[~over]
            to = self.moved(state[live], ids[place])
            group[place] = own[live]
            at[side, live] += 1
            state[live] = to
            own[live] += to == 0
            live = live[to != self.NO]
        return group, own, same


class Units:
    """What units add to their texts, in columns: tokens on both sides, groups and links (n, -1 where the bytes don't come
    back), the groups written out, and the links' id pairs one after another."""

    def __init__(self, n: np.ndarray, told: list[str], pairs: np.ndarray):
        self.n, self.told, self.pairs = n, told, pairs
        self.size = np.maximum(n[:, 3], 0)
        self.start = np.cumsum(self.size) - self.size

    def __add__(self, more: Units) -> Units:
        return Units(np.concatenate([self.n, more.n]), self.told + more.told, np.concatenate([self.pairs, more.pairs]))

    def take(self, rows: np.ndarray) -> Units:
        return Units(self.n[rows], list(map(self.told.__getitem__, rows.tolist())), self.pairs[_spread(self.start[rows], self.size[rows])])


NOTHING = Units(np.zeros((0, 4), np.int64), [], np.zeros(0, np.int64))


class Aligner:
    """Units of texts through both tokenizers and the transducer."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task for each core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.codec = codec(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = {c: b for b, c in enumerate(BYTE_CHARS)}
        a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            a_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i).replace("▁", " ") for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _ONE_BYTE.fullmatch(p)) else p.encode() for i, p in enumerate(pieces)]
        self.transducer = Transducer(a_bytes, b_bytes)
        self.numbers = pa.array([str(i) for i in range(self.transducer.width)])
        across = "".join({y for p in pieces for x, y in re.findall(f"(?=([^{SPACE}])([{SPACE}]))", p)})
        self.whole = " " in across or any("\n" in p for p in pieces)  # then B has tokens across words, and texts are not cut
        held = f"(?:[{re.escape(across)}][{SPACE}]*[^{SPACE}]*)*" if across else ""
        self.unit = re.compile(f"[{SPACE}]*[^{SPACE}]+{held}|[{SPACE}]+")
        self.lead = "" if self.whole else "x\n"  # before each unit, so that the model adds no space of its own to it
        self.led = self.b.encode(self.lead)
        self.row: dict[str, int] = {}
        self.kept = NOTHING

    def pieces(self, text: str) -> str | list[str]:
        """The units of the space and the text, or both with NUL between the units where plain replacing finds them."""
        text = " " + text
        if self.whole:
            return [text]
        if text[-1] in " \n" or any(x in text for x in _RUNS) or (not text.isascii() and _WIDE.search(text)):
            return self.unit.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0")[1:]

    def _a_ids(self, units: list[str]) -> list[bytes]:
        """By the codec, which remembers units and takes special tokens for such; long units, and those that hold a special
        token, go through the library as plain text."""
        odd = {u for u in units if len(u) > LONG or any(x in u for x in self.codec.special)}
        plain = [u for u in units if u not in odd]
        found = dict(zip(plain, self.codec.known(plain), strict=True))
        found |= {u: np.array(self.a.encode(u, add_special_tokens=False).ids, "<u4").tobytes() for u in odd}
        return [found[u] for u in units]

    def _b_ids(self, units: list[str]) -> list[list[int]]:
        if self.whole:
            return self.b.encode([u[1:] for u in units], num_threads=1)
        n = len(self.led)
        return [x[n:] for x in self.b.encode([self.lead + u for u in units], num_threads=1)]

    def aligned(self, units: list[str]) -> Units:
        out = NOTHING
        for k in range(0, len(units), LEARN):
            out += self._aligned(units[k : k + LEARN])
        return out

    def _aligned(self, units: list[str]) -> Units:
        raw, b_lists = self._a_ids(units), self._b_ids(units)
        size = np.array([len(x) // 4 for x in raw], np.int64), np.array([len(x) for x in b_lists], np.int64)
        a, b = np.frombuffer(b"".join(raw), "<u4").astype(np.int64), np.fromiter(chain.from_iterable(b_lists), np.int64, int(size[1].sum()))
        group, n_groups, same = self.transducer.groups(np.concatenate([a, b]), size)
        a_bytes = self.transducer.tokens[0]
        if b"".join(map(a_bytes.__getitem__, a.tolist())) != "".join(units).encode():
            ends = np.cumsum(size[0]).tolist()
            same &= np.array([b"".join(map(a_bytes.__getitem__, a[s:e].tolist())) == u.encode() for u, s, e in zip(units, [0, *ends[:-1]], ends, strict=True)])
        n_groups = np.where(same, n_groups, 0)
        first = np.cumsum(n_groups) - n_groups  # of a unit's groups among all
        kept, of, texts = [], [], []
        for ids, n, own in ((a, size[0], group[: len(a)]), (b, size[1], group[len(a) :])):
            good = np.repeat(same, n)
            kept.append(ids[good])
            of.append((np.repeat(first, n) + own)[good])
        count = [np.bincount(g, minlength=int(n_groups.sum())) for g in of]
        times = count[1][of[0]]  # each A token with all B tokens of its group
        pairs = (np.repeat(kept[0], times) << 32) | kept[1][_spread((np.cumsum(count[1]) - count[1])[of[0]], times)]
        for ids, n in zip(kept, count, strict=True):
            texts.append(pa.compute.binary_join(_lists(n, self.numbers.take(pa.array(ids))), ","))
        told = pa.compute.binary_join(_lists(n_groups, pa.compute.binary_join_element_wise(*texts, "|")), ";").to_pylist()
        n = np.stack([*size, n_groups, _sums(count[0] * count[1], n_groups)], axis=1)
        n[~same] = -1
        return Units(n, told, pairs)

    def known(self, units: list[str]) -> np.ndarray:
        """The rows of distinct units in `kept`. When it is full, what these units don't need is forgotten."""
        row = self.row
        rows = np.array([row.get(u, -1) for u in units], np.int64)
        new = np.flatnonzero(rows < 0)
        if len(new) and len(row) + len(new) > KEEP:
            old = np.flatnonzero(rows >= 0)
            self.kept = self.kept.take(rows[old])
            rows[old] = np.arange(len(old))
            row = self.row = dict(zip([units[k] for k in old.tolist()], range(len(old)), strict=True))
        if len(new):
            rows[new] = len(row) + np.arange(len(new))
            fresh = [units[k] for k in new.tolist()]
            self.kept += self.aligned(fresh)
            row.update(zip(fresh, rows[new].tolist(), strict=True))
        return rows


def _lists(size: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), values)


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process and pair of files."""
    return Aligner(a_path, b_path)


class Block:
    """The texts of a block, in units."""

    def __init__(self, al: Aligner, texts: list[str]):
        rows: list[list[str]] = []
        plain, plain_at, other_at = [], [], []
        for k, t in enumerate(texts):
            if t:
                p = al.pieces(t)
                if isinstance(p, str):
                    plain.append(p)
                    plain_at.append(k)
                else:
                    rows.append(p)
                    other_at.append(k)
        split = pa.compute.split_pattern(pa.array(plain, pa.large_string()), "\0")
        coded = pa.concat_arrays([split.values, pa.array(list(chain.from_iterable(rows)), pa.large_string())]).dictionary_encode()
        known = al.known(coded.dictionary.to_pylist())
        units = al.kept.take(known)
        code = coded.indices.to_numpy().astype(np.int64)
        size = np.zeros(len(texts), np.int64)  # units of each text
        n = np.append(np.diff(split.offsets.to_numpy()), [len(x) for x in rows]).astype(np.int64)
        at = np.array([*plain_at, *other_at], np.int64)
        size[at] = n
        start = np.zeros(len(texts), np.int64)
        start[at] = np.cumsum(n) - n
        code = code[_spread(start, size)]
        odd = np.flatnonzero(_sums((units.n[:, 0] < 0).astype(np.int64)[code], size))
        if len(odd):  # a text with such a unit is one unit, whose bytes decide
            keep = ~np.isin(np.repeat(np.arange(len(texts)), size), odd)
            code, size[odd] = code[keep], 1
            code = np.insert(code, (np.cumsum(size) - size)[odd] - np.arange(len(odd)), len(units.n) + np.arange(len(odd)))
            units += al.aligned([" " + texts[k] for k in odd.tolist()])
        self.units, self.code, self.size = units, code, size
        self.n = np.maximum(units.n, 0)

    def totals(self) -> list[np.ndarray]:
        return [_sums(self.n[:, j][self.code], self.size) for j in range(4)]

    def told(self) -> Iterator[str]:
        """Each text's groups, written out."""
        ends = np.cumsum(self.size).tolist()
        return (";".join(map(self.units.told.__getitem__, self.code[s:e].tolist())) for s, e in zip([0, *ends[:-1]], ends, strict=True))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The block's distinct id pairs, how many texts have each; for the texts one after another, the pairs (by number) and
        how often; and how many of these each text has."""
        pairs, number = np.unique(self.units.pairs, return_inverse=True)
        width = max(len(pairs), 1)
        size = self.units.size[self.code]
        doc = np.repeat(np.repeat(np.arange(len(self.size)), self.size), size)
        cell = np.sort(doc * width + number[_spread(self.units.start[self.code], size)])
        at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        times = np.diff(np.append(at, len(cell)))
        cell = cell[at]
        return pairs, np.bincount(cell % width, minlength=len(pairs)), np.stack([cell % width, times]).astype("<u4"), np.bincount(cell // width, minlength=len(self.size))


def _blocks(batches: Iterable[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    al = aligner(a_path, b_path)
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    number = TaskContext.get().partitionId() << 32
    for b in steps(batches, limit=BLOCK):
        block = Block(al, strings(b.column("text")))
        n_a, n_b, n_groups, n_links = block.totals()
        pairs, docs, links, size = block.links()
        ends = np.cumsum(size).tolist()
        packed = [links[:, s:e].tobytes() for s, e in zip([0, *ends[:-1]], ends, strict=True)]
        digests = [hashlib.sha256(x.encode()).hexdigest() if k else "" for x, k in zip(block.told(), n_groups.tolist(), strict=True)]
        n, m = b.num_rows, len(pairs)
        none = lambda k, kind: pa.nulls(k, kind)
        told = [pa.array(np.full(n, number)), b.column("doc_id"), *map(pa.array, (n_a, n_b, n_groups, n_links)), pa.array(digests, pa.string()), pa.array(packed, pa.binary())]
        yield pa.record_batch([*told, none(n, pa.int32()), none(n, pa.int32()), none(n, pa.int32()), none(n, pa.int64())], names=names)
        if m:
            own = [pa.array(np.arange(m, dtype=np.int32)), pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(docs.astype(np.int64))]
            yield pa.record_batch([pa.array(np.full(m, number)), *[none(m, pa.int64())] * 5, none(m, pa.string()), none(m, pa.binary()), *own], names=names)
        number += 1


def _weighed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    count, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, bool)
    idx = pairs["idx"].to_numpy()
    count[idx], best[idx] = pairs["count"].to_numpy(), pairs["best"].to_numpy(zero_copy_only=False)
    raw = docs["links"].to_pylist()
    size = np.array([len(x) // 8 for x in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
    first = 2 * (np.cumsum(size) - size)
    which, times = flat[_spread(first, size)], flat[_spread(first + size, size)]
    got = docs.drop_columns(["links"])
    got = got.append_column("n_best", pa.array(_sums(times * best[which], size))).append_column("count_sum", pa.array(_sums(times * count[which], size)))
    return got.select([x.split()[0] for x in RESULT.split(", ")])


def align_blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The written blocks: rows of documents with their totals and links, and rows of a block's id pairs."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return written(rows.mapInArrow(partial(_blocks, a_path=a_path, b_path=b_path), BLOCKS), "aligned")


def link_counts(blocks: DataFrame) -> DataFrame:
    """a, b, count: how many documents hold the id pair linked; best: whether that is the highest of its A id."""
    counts = written(blocks.where("idx is not null").groupBy("a", "b").agg(F.sum("docs").alias("count")), "links")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))  # one row for each entry of A's vocabulary at most
    return counts.join(F.broadcast(highest), "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def alignment_digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Each document's tokens on both sides, groups and links, how many links are their A id's most usual, and the links'
    counts summed up."""
    blocks = align_blocks(docs, a_path, b_path)
    pairs = blocks.where("idx is not null").select(F.col("block").alias("of"), "idx", "a", "b").join(sized(link_counts(blocks)), ["a", "b"]).select("of", "idx", "count", "best")
    texts = blocks.where("idx is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    return texts.groupBy("block").cogroup(pairs.groupBy("of")).applyInArrow(_weighed, RESULT)


def _grouped(batches: Iterable[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    al = aligner(a_path, b_path)
    for b in steps(batches):
        told = Block(al, strings(b.column("text"))).told()
        groups = [[{"a": [int(i) for i in x.split(",")], "b": [int(i) for i in y.split(",")]} for x, y in (g.split("|") for g in t.split(";") if g)] for t in told]
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        yield pa.record_batch([b.column("doc_id"), pa.array(groups, kind)], names=["doc_id", "groups"])
    give_back()


def aligned_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, groups array<struct<a array<int>, b array<int>>>: the ids over each stretch where both sides end together."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_grouped, a_path=a_path, b_path=b_path), "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")
