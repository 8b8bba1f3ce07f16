"""Exact encoding of whole texts with a vocabulary file, one distinct piece at a time.

White space bounds the matches of both kinds of pre-tokenizer, so the ids of a text are those of its pieces put
together. Arrow finds the distinct pieces of some texts, only these are looked up, and numpy lays their ids out in the
order of the texts. A worker keeps the ids of pieces it has seen, in two generations of at most KEEP pieces: when the
younger is full it becomes the older, and a piece found there moves back; so frequent pieces stay.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute

#: Pieces of a generation (about 200 bytes each).
KEEP = 100_000
#: Pieces that go through the library together.
LEARN = 4096
#: Characters of a piece that is merged here.
SHORT = 48
#: White space by Unicode's property, as the pre-tokenizers' \\s has it. str.split also takes \x1c to \x1f.
SPACE = "\t-\r \x85\xa0  -     　"
_NOT_SPACE = re.compile(f"[^{SPACE}]+")
_BYTE_LEVEL = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\v", "\f", "\r", "\0")
_WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = "\x1c\x1d\x1e\x1f"
#: Latin pieces up to U+024F are their own normal form and have fixed categories; others go through the library's
#: normalizer and pre-tokenizer.
_LATIN = re.compile(" ?[!-~\xa1-\u024f]+")


def _latin_words(space: str, digits: str) -> re.Pattern:
    import unicodedata

    of = lambda kind: "".join(c for c in map(chr, range(0x21, 0x250)) if unicodedata.category(c)[0] == kind)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|{space}[{of('L')}]+|{space}[{of('N')}]{digits}|{space}[^\\s{of('L')}{of('N')}]+")


_LATIN_WORDS, _LATIN_BYTES = _latin_words("", ""), _latin_words(" ?", "+")


def word_pieces(text: str) -> list[str]:
    """The pieces between white space, for a vocabulary that drops white space."""
    return _NOT_SPACE.findall(text) if any(c in text for c in _ODD) else text.split()


def plain_bytes(text: str) -> str | None:
    """The pieces with NUL between them where plain replacing finds them: all white space is single spaces and line ends
    between words. Else None."""
    if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _RUNS) or (not text.isascii() and any(x in text for x in _WIDE)):
        return None
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0")


def plain_words(text: str) -> str | None:
    """The same for a vocabulary that drops white space; empty pieces between NULs don't matter."""
    if any(x in text for x in "\t\v\f\r\0" + _ODD) or (not text.isascii() and any(x in text for x in _WIDE)):
        return None
    return text.replace(" ", "\0").replace("\n", "\0")


def byte_pieces(text: str) -> list[str]:
    """Pieces with their leading space, and runs of white space as the byte-level pattern cuts them."""
    plain = plain_bytes(text)
    return _BYTE_LEVEL.findall(text) if plain is None else plain.split("\0")


def _byte_chars() -> list[str]:
    """Byte-level BPE writes a printable byte as itself and the others as the code points from 256 on."""
    out, more = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


BYTE_CHARS = _byte_chars()
_BYTE_LEVEL_OF = {b: c for b, c in enumerate(BYTE_CHARS) if b not in b"\0\n"}  # these two separate here


class PairRanks:
    """The ranks of pairs of ids, in a hash table of numpy arrays that is looked up for many pairs at once."""

    NONE = np.int32(np.iinfo(np.int32).max)

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.shift = np.uint64(64 - 2 - int(len(left)).bit_length())  # a quarter of the slots is taken at most
        self.size = 1 << (64 - int(self.shift))
        self.keys = np.full(self.size, -1, np.int64)
        self.ranks = np.full(self.size, self.NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right
        rank, slot = np.arange(len(key), dtype=np.int32), self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            take = free[first]
            self.keys[slot[take]], self.ranks[slot[take]] = key[take], rank[take]
            left_over = np.ones(len(key), bool)
            left_over[take] = False
            key, rank, slot = key[left_over], rank[left_over], (slot[left_over] + 1) & (self.size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], self.NONE)
        live = np.flatnonzero((found != key) & (found >= 0))
        if len(live):
            key, slot, flat = key.ravel()[live], slot.ravel()[live], out.ravel()
            while len(live):
                slot = (slot + 1) & (self.size - 1)
                found = self.keys[slot]
                hit = found == key
                flat[live[hit]] = self.ranks[slot[hit]]
                go = ~hit & (found >= 0)
                live, key, slot = live[go], key[go], slot[go]
        return out


class Codec:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = bool(spec["model"].get("end_of_word_suffix"))
        self.split, self.plain = (word_pieces, plain_words) if self.by_word else (byte_pieces, plain_bytes)
        self.pre = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.normal = self.tokenizer.normalizer.normalize_str if self.by_word else str
        self.latin = _LATIN_WORDS if self.by_word else _LATIN_BYTES
        self.latin_lines = re.compile("\n|" + self.latin.pattern)
        self.special = {x["content"]: np.uint32(x["id"]).tobytes() for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        vocab, merges = spec["model"]["vocab"], [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.pairs = PairRanks(np.array([vocab[a] for a, _ in merges]), np.array([vocab[b] for _, b in merges]))
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.first_ids = np.array([vocab[c] for c in BYTE_CHARS], np.int32)
        self.last_ids = np.array([vocab[c + suffix] for c in BYTE_CHARS], np.int32)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept.update(self.special)
        self.kept[""] = b""

    def pieces(self, text: str) -> list[str]:
        """Special tokens written out in a text are pieces of their own, as the library takes them."""
        if not any(x in text for x in self.special):
            return self.split(text)
        return [p for k, part in enumerate(self.cut.split(text)) for p in ([part] if k % 2 else self.split(part))]

    def pre_tokens(self, piece: str) -> list[str]:
        """The words of a piece, in the byte-level alphabet."""
        if _LATIN.fullmatch(piece):
            words = self.latin.findall(piece.lower() if self.by_word else piece)
            if piece.isascii():
                return [w.replace(" ", BYTE_CHARS[32]) for w in words] if piece[0] == " " else words
            return [w.encode().decode("latin-1").translate(_BYTE_LEVEL_OF) for w in words]
        return [x for x, _ in self.pre(self.normal(piece))]

    def all_pre_tokens(self, pieces: list[str]) -> list[list[str]]:
        """pre_tokens of many pieces: those in Latin letters go through one expression together, a line each."""
        latin = list(map(bool, map(_LATIN.fullmatch, pieces)))
        joined = "\n".join([p for p, yes in zip(pieces, latin, strict=True) if yes])
        if self.by_word:
            joined = joined.lower()
        words = "\0".join(self.latin_lines.findall(joined)).encode().decode("latin-1").translate(_BYTE_LEVEL_OF)
        lines = iter(words.split("\0\n\0"))
        return [next(lines).split("\0") if yes else [x for x, _ in self.pre(self.normal(p))] for p, yes in zip(pieces, latin, strict=True)]

    def merged(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words (bytes, each with a NUL or a line end behind it), one after another, and how many each has.

        Words of as many symbols are rows of a matrix. From the longest down, each row makes the merge of its least rank,
        the leftmost of equal ones, which puts it among the rows that are shorter by one; a row without a rank is done.
        """
        chars = np.frombuffer(data, np.uint8)
        end = np.flatnonzero((chars == 0) | (chars == 10))
        begin = np.append(0, end[:-1] + 1)
        length = end - begin
        ids = self.first_ids[chars]
        ids[end - 1] = self.last_ids[chars[end - 1]]
        order = np.argsort(length, kind="stable")
        upto = np.searchsorted(length[order], np.arange(int(length.max()) + 2))
        size = np.zeros(len(length), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        word = np.zeros(0, np.int64)
        sym, rank = np.zeros((0, len(upto) - 1), np.int32), np.zeros((0, len(upto) - 2), np.int32)
        for n in range(len(upto) - 2, 0, -1):
            new = order[upto[n] : upto[n + 1]]
            if len(new):
                own = ids[begin[new][:, None] + np.arange(n)]
                sym, rank, word = np.concatenate([sym[:, :n], own]), np.concatenate([rank[:, : n - 1], self.pairs.of(own[:, :-1], own[:, 1:])]), np.concatenate([word, new])
            if not len(word):
                sym, rank = sym[:, : n - 1], rank[:, : max(n - 2, 0)]
                continue
            rows = np.arange(len(word))
            at = rank.argmin(1) if n > 1 else np.zeros(len(word), np.int64)
            best = rank[rows, at] if n > 1 else np.full(len(word), PairRanks.NONE)
            ended = best == PairRanks.NONE
            if ended.any():
                size[word[ended]] = n
                done.append((word[ended], sym[ended]))
                go = ~ended
                word, sym, rank, at, best = word[go], sym[go], rank[go], at[go], best[go]
                rows = np.arange(len(word))
            if n == 1:
                break
            keep = np.ones(sym.shape, bool)
            keep[rows, at + 1] = False
            sym = sym[keep].reshape(len(word), n - 1)
            sym[rows, at] = self.made[best]
            keep = np.ones(rank.shape, bool)
            keep[rows, at] = False
            rank = rank[keep].reshape(len(word), n - 2)
            r, k = rows[at > 0], at[at > 0]
            rank[r, k - 1] = self.pairs.of(sym[r, k - 1], sym[r, k])
            r, k = rows[at < n - 2], at[at < n - 2]
            rank[r, k] = self.pairs.of(sym[r, k], sym[r, k + 1])
        start = np.cumsum(size) - size
        out = np.empty(int(size.sum()), "<u4")
        for w, s in done:
            out[start[w][:, None] + np.arange(s.shape[1])] = s
        return out, size

    def learn(self, pieces: list[str]) -> None:
        """New pieces: short ones in Latin letters by merged(), the others by the library."""
        plain = [p for p in pieces if len(p) <= SHORT and _LATIN.fullmatch(p)]
        if plain:
            joined = "\n".join(plain)
            words = "\0".join(self.latin_lines.findall(joined.lower() if self.by_word else joined)).replace("\0\n\0", "\n").encode() + b"\n"
            ids, size = self.merged(words)
            chars = np.frombuffer(words, np.uint8)
            stop = chars[(chars == 0) | (chars == 10)] == 10  # the last word of its piece
            ends = (np.cumsum(size)[stop] * 4).tolist()
            raw = ids.tobytes()
            self.kept.update(zip(plain, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        if len(plain) < len(pieces):
            self.ask(list(set(pieces).difference(plain)))

    def ask(self, pieces: list[str]) -> None:
        """Pieces go through the library together, with a special token, which none of them holds, between them."""
        mark, number = next((x, int.from_bytes(i, "little")) for x, i in self.special.items())
        for k in range(0, len(pieces), LEARN):  # the library's results are large for their ids
            part = pieces[k : k + LEARN]
            ids = np.array(self.tokenizer.encode_batch_fast([mark.join(part)], add_special_tokens=False)[0].ids, "<u4")
            raw = ids.tobytes()
            ends = [*(np.flatnonzero(ids == number) * 4).tolist(), len(raw)]
            self.kept.update((p, raw[a:e]) for p, a, e in zip(part, [0, *(x + 4 for x in ends[:-1])], ends, strict=True))

    def known(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        if len(self.kept) > KEEP:
            self.older, self.kept = self.kept, {**self.special, "": b""}
        kept, older = self.kept, self.older.get
        found = list(map(kept.get, pieces))
        if None in found:
            new = []
            for k, x in enumerate(found):
                if x is None:
                    p = pieces[k]
                    x = older(p)
                    if x is None:
                        new.append(k)
                    else:
                        found[k] = kept[p] = x
            if new:
                self.learn([pieces[k] for k in new])
            for k in new:
                found[k] = kept[pieces[k]]
        return found

    def forget(self) -> None:
        """The pieces that it has seen; workers live on from stage to stage."""
        self.older, self.kept = {}, {**self.special, "": b""}

    def encode(self, texts: list[str]) -> list[bytes]:
        plain, plain_at, other, other_at = [], [], [], []
        for k, t in enumerate(texts):
            p = None if any(x in t for x in self.special) else self.plain(t)
            if p is None:
                other.append(self.pieces(t))
                other_at.append(k)
            else:
                plain.append(p)
                plain_at.append(k)
        split = pa.compute.split_pattern(pa.array(plain, pa.large_string()), "\0")
        coded = pa.concat_arrays([split.values, pa.array([p for x in other for p in x], pa.large_string())]).dictionary_encode()
        ids = self.known(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        code = coded.indices.to_numpy()
        n = size[code]  # ids by piece
        end = np.append(0, np.cumsum(n))
        start = (np.cumsum(size) - size)[code]
        flat = np.frombuffer(b"".join(ids), "<u4")[np.arange(end[-1]) + np.repeat(start - end[:-1], n)]
        pieces = np.append(0, np.cumsum(np.append(np.diff(split.offsets.to_numpy()), [len(x) for x in other]))).astype(np.int64)
        cuts = end[pieces].tolist()
        out: list[bytes] = [b""] * len(texts)
        for k, a, b in zip([*plain_at, *other_at], cuts[:-1], cuts[1:], strict=True):
            out[k] = flat[a:b].tobytes()
        return out


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One for each worker process and file."""
    return Codec(path)
