"""Chunks of documents: paragraphs are packed greedily up to a number of tokens.

The tokenizer is a parameter: a function from texts to their numbers of tokens, words by default. Packing is an expression
over the parts of a document and their tokens, without Python.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron.functions.text import trimmed

SIZE, OVERLAP, LEAST = 500, 50, 100
_PIECES = "array<struct<content: string, n: int>>"
_PART = f"struct<content: string, n: int, pieces: {_PIECES}>"
_PIECE_ARROW = pa.struct([("content", pa.string()), ("n", pa.int32())])
_PART_ARROW = pa.struct([("content", pa.string()), ("n", pa.int32()), ("pieces", pa.list_(_PIECE_ARROW))])
_MARK = "\uffff"


def paragraphs(text: Column) -> Column:
    """Runs of lines that are not blank, as an array. Blank lines become a mark that no text has (a noncharacter), which
    takes the line ends around it with it."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.when(trimmed(x) == "", F.lit(_MARK)).otherwise(x))
    joined = F.replace(F.replace(F.array_join(lines, "\n"), F.lit("\n" + _MARK), F.lit(_MARK)), F.lit(_MARK + "\n"), F.lit(_MARK))
    return F.filter(F.split(joined, _MARK, -1), lambda x: x != "")


def whole_lines(text: Column) -> Column:
    """The lines that are not blank."""
    return F.filter(F.split(text, "\n", -1), lambda x: trimmed(x) != "")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != "")


def _by_words(part: Column, size: int) -> Column:
    """A part (content) with its number of words, and its pieces if these are too many."""
    words = words_of(part)
    numbers = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / size).cast("int"))
    cut = lambda i: F.slice(words, i * size + 1, F.lit(size))
    pieces = F.transform(numbers, lambda i: F.struct(F.array_join(cut(i), " ").alias("content"), F.size(cut(i)).alias("n")))
    return F.struct(part.alias("content"), F.size(words).alias("n"), F.when(F.size(words) > size, pieces).otherwise(F.array().cast(_PIECES)).alias("pieces"))


def _measured(batch: pa.Array, size: int, count: Callable[[list[str]], list[int]]) -> pa.Array:
    """The parts of a batch of documents, all counted together; then the words of those that are too large, and the pieces
    that these make."""
    texts = batch.flatten().to_pylist()
    n = count(texts) if texts else []
    large = [k for k, x in enumerate(n) if x > size]
    words = [texts[k].split() for k in large]
    flat = [w for ws in words for w in ws]
    sizes = iter(count(flat) if flat else [])
    cut = [_packed(ws, [next(sizes) for _ in ws], size) for ws in words]
    flat = [x for xs in cut for x in xs]
    tokens = iter(count(flat) if flat else [])
    pieces: list[list] = [[] for _ in texts]
    for k, xs in zip(large, cut, strict=True):
        pieces[k] = [{"content": x, "n": next(tokens)} for x in xs]
    rows = pa.array([{"content": t, "n": m, "pieces": p} for t, m, p in zip(texts, n, pieces, strict=True)], _PART_ARROW)
    return pa.ListArray.from_arrays(batch.offsets, rows, mask=batch.is_null()) if batch.null_count else pa.ListArray.from_arrays(batch.offsets, rows)


def _packed(words: list[str], sizes: list[int], size: int) -> list[str]:
    out, own, used = [], [], 0
    for w, n in zip(words, sizes, strict=True):
        if own and used + n > size:
            out.append(" ".join(own))
            own, used = [], 0
        own.append(w)
        used += n
    return [*out, " ".join(own)] if own else out


def packed(parts: Column, size: int, overlap: int, least: int, joint: str) -> Column:
    """Chunks (content, n, start, end) of an array of parts (content, n, pieces), as one fold over their numbers.

    A chunk is closed where the next part doesn't fit; one that is too large by itself gives its pieces. The state has the
    chunks as ranges of parts, the first part of the open one and how many it has, its tokens and bytes, and the place where
    it starts. Overlap shifts the start only: the trailing parts that fit in it, each with the two bytes of a joint, count
    again for the place of the next chunk. A small last chunk is appended to the one before."""
    none = F.array().cast("array<struct<first: int, last: int, piece: int, n: int, start: int, end: int>>")
    zero = F.struct(none.alias("chunks"), F.lit(1).alias("first"), F.lit(0).alias("own"), F.lit(0).alias("used"), F.lit(0).alias("bytes"), F.lit(0).alias("start"), F.lit(0).alias("i"))
    chunk = lambda first, last, piece, n, start, end: F.struct(first.alias("first"), last.alias("last"), piece.alias("piece"), n.alias("n"), start.alias("start"), end.alias("end"))
    width = lambda s: s["bytes"] + (s["own"] - 1) * len(joint.encode())

    def back(s: Column) -> Column:
        """Bytes of the trailing parts that fit in the overlap, joints included."""
        if overlap <= 0:
            return F.lit(0)
        last = F.reverse(F.slice(parts, s["first"], s["own"]))
        start = F.struct(F.lit(0).alias("kept"), F.lit(0).alias("back"), F.lit(True).alias("goes"))

        def step(a: Column, p: Column) -> Column:
            goes = a["goes"] & (a["kept"] + p["n"] <= overlap)
            more = lambda x: F.when(goes, x).otherwise(F.lit(0))
            return F.struct((a["kept"] + more(p["n"])).alias("kept"), (a["back"] + more(F.octet_length(p["content"]) + 2)).alias("back"), goes.alias("goes"))

        return F.aggregate(last, start, step, lambda a: a["back"])

    closed = lambda s: F.concat(s["chunks"], F.array(chunk(s["first"], s["first"] + s["own"] - 1, F.lit(-1), s["used"], s["start"], s["start"] + width(s))))

    def step(s: Column, p: Column) -> Column:
        large = p["n"] > size
        ends = (s["own"] > 0) & (large | (s["used"] + p["n"] > size))
        i = s["i"] + 1
        chunks, start = F.when(ends, closed(s)).otherwise(s["chunks"]), F.when(ends, s["start"] + width(s) - back(s)).otherwise(s["start"])
        held = lambda x: F.when(large | ends, F.lit(0)).otherwise(x)  # noqa: E731  of the open chunk
        piece_ends = lambda k: F.aggregate(F.slice(p["pieces"], 1, k), F.lit(0), lambda a, x: a + F.octet_length(x["content"]))
        cut = F.transform(p["pieces"], lambda x, k: chunk(i, i, k, x["n"], start + piece_ends(k), start + piece_ends(k + 1)))
        one = F.when(large, F.lit(0)).otherwise(F.lit(1))
        return F.struct(
            F.when(large, F.concat(chunks, cut)).otherwise(chunks).alias("chunks"),
            F.when(ends | (s["own"] == 0), i).otherwise(s["first"]).alias("first"),
            (held(s["own"]) + one).alias("own"),
            (held(s["used"]) + one * p["n"]).alias("used"),
            (held(s["bytes"]) + one * F.octet_length(p["content"])).alias("bytes"),
            F.when(large, start + piece_ends(F.size(p["pieces"]))).otherwise(start).alias("start"),
            i.alias("i"),
        )

    ranges = F.aggregate(parts, zero, step, lambda s: F.when(s["own"] > 0, closed(s)).otherwise(s["chunks"]))
    text = lambda c: F.when(c["piece"] >= 0, F.get(F.get(parts, c["first"] - 1)["pieces"], c["piece"])["content"]).otherwise(F.array_join(F.transform(F.slice(parts, c["first"], c["last"] - c["first"] + 1), lambda p: p["content"]), joint))
    whole = F.transform(ranges, lambda c: F.struct(text(c).alias("content"), c["n"].alias("n"), c["start"].alias("start"), c["end"].alias("end")))

    def merged(c: Column) -> Column:
        a, b = F.element_at(c, -2), F.element_at(c, -1)
        return F.struct(F.concat(a["content"], F.lit(joint), b["content"]).alias("content"), (a["n"] + b["n"]).alias("n"), a["start"].alias("start"), b["end"].alias("end"))

    # An array of one, so that what is asked of the chunks twice is made once.
    small = lambda c: (F.size(c) > 1) & (F.element_at(c, -1)["n"] < least)
    return F.get(F.transform(F.array(whole), lambda c: F.when(small(c), F.concat(F.slice(c, 1, F.size(c) - 2), F.array(merged(c)))).otherwise(c)), 0)


def chunk_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, count: Callable[[list[str]], list[int]] | None = None, by_line: bool = False) -> DataFrame:
    """A row for each chunk: doc_id, chunk_index, content, n_tokens, start_offset, end_offset (bytes). Paragraphs, or with
    by_line every line, are packed greedily up to `size` tokens. Tokens are words, counted natively, or what `count` gives
    for a list of texts: it is asked a few times for each Arrow batch. A blank text has no chunk; of repeated ids each row
    is cut by itself."""
    text = F.col("text")
    parts = whole_lines(text) if by_line else paragraphs(text)
    if count is None:
        measured = F.transform(parts, lambda p: _by_words(p, size))
    else:
        own = count

        @F.arrow_udf(f"array<{_PART}>")
        def counted(batch: pa.Array) -> pa.Array:
            return _measured(batch, size, own)

        measured = counted(parts)
    rows = docs.select(F.col("doc_id").cast("long"), measured.alias("parts"))
    cut = rows.select("doc_id", packed(F.col("parts"), size, overlap, least, "\n" if by_line else "\n\n").alias("c"))
    each = cut.select("doc_id", F.posexplode_outer("c").alias("chunk_index", "c")).where("chunk_index is not null")
    return each.select("doc_id", "chunk_index", "c.content", F.col("c.n").alias("n_tokens"), F.col("c.start").alias("start_offset"), F.col("c.end").alias("end_offset"))


def chunk_words(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The words of every text in chunks of `size`, natively: doc_id, chunk_index, n_words, content. A text without words
    has none."""
    words = docs.select("doc_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w"))
    part = lambda i: F.slice(F.col("w"), i * size + 1, F.lit(size))
    numbers = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int")))
    # The chunks are cut before they are exploded, so the words are not repeated beside each. An explode that may give
    # nothing leaves no condition on the array behind, which would be pushed down and split the text again for each chunk.
    chunks = words.select("doc_id", F.transform(numbers, lambda i: F.struct(F.size(part(i)).alias("n_words"), F.array_join(part(i), " ").alias("content"))).alias("c"))
    each = chunks.select("doc_id", F.posexplode_outer("c").alias("chunk_index", "c")).where("chunk_index is not null")
    return each.select("doc_id", "chunk_index", "c.n_words", "c.content")


READY, FAILED = 2, 3


def ingest(docs: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None, vector: str = "embedding", **how) -> tuple[DataFrame, DataFrame]:
    """Chunks (with what `embed` adds) and each document's status: 2 ready; 3 failed, where no chunk came out or `embed`
    left one without a vector. A failed document keeps no chunk. With an `embed` that is dear, write what it returns:
    both results read it."""
    chunks = chunk_documents(docs, **how)
    done = F.lit(True)
    if embed:
        chunks, done = embed(chunks), F.col(vector).isNotNull()
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("_n"), F.bool_and(done).alias("_done"))
    ready = F.coalesce(F.col("_done"), F.lit(False))
    status = docs.select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.when(ready, READY).otherwise(FAILED).alias("status"), F.when(ready, F.col("_n")).otherwise(0).alias("chunk_count"))
    kept = chunks.join(status.where(F.col("status") == READY).select("doc_id"), "doc_id", "left_semi") if embed else chunks
    return kept, status
