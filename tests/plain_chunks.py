"""Chunks in plain Python, one document after another: what the expressions of heron.operators.chunking have to give."""

from __future__ import annotations

from collections.abc import Callable

SIZE, OVERLAP, LEAST = 500, 50, 100


def count_words(text: str) -> int:
    return len(text.split())


def paragraphs(text: str) -> list[str]:
    """Runs of lines that are not blank."""
    out, own = [], []
    for line in text.split("\n"):
        if line.strip():
            own.append(line)
        elif own:
            out.append("\n".join(own))
            own = []
    return [*out, "\n".join(own)] if own else out


def split_words(text: str, size: int, count: Callable[[str], int]) -> list[str]:
    """A paragraph that is too large, by its words; a word that is too large by itself is a chunk of its own."""
    out, own, used = [], [], 0
    for w in text.split():
        n = count(w)
        if own and used + n > size:
            out.append(" ".join(own))
            own, used = [], 0
        own.append(w)
        used += n
    return [*out, " ".join(own)] if own else out


def pack(parts: list[str], size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, count: Callable[[str], int] = count_words, joint: str = "\n\n") -> list[tuple[str, int, int, int]]:
    """(content, tokens, start, end). Overlap shifts the start only: the trailing parts that fit in it, each with the two
    bytes of a joint, count again for the place of the next chunk, and no text is repeated; so a chunk may start before
    the one in front of it. Behind the pieces of a large part the next chunk starts at their end. A small last chunk is
    appended to the one before."""
    chunks: list[list] = []
    own: list[str] = []
    used = start = 0

    def close(texts: list[str], tokens: int) -> None:
        nonlocal start
        content = joint.join(texts)
        size_ = len(content.encode())
        chunks.append([content, tokens, start, start + size_])
        back, kept = 0, 0
        for t in reversed(texts):
            if kept + count(t) > overlap:
                break
            kept += count(t)
            back += len(t.encode()) + 2
        start += size_ - back

    for p in parts:
        n = count(p)
        if n > size:
            if own:
                close(own, used)
                own, used = [], 0
            for w in split_words(p, size, count):
                chunks.append([w, count(w), start, start + len(w.encode())])
                start = chunks[-1][3]
            continue
        if own and used + n > size:
            close(own, used)
            own, used = [], 0
        own.append(p)
        used += n
    if own:
        close(own, used)
    if len(chunks) > 1 and chunks[-1][1] < least:
        last = chunks.pop()
        chunks[-1][0] += joint + last[0]
        chunks[-1][1] += last[1]
        chunks[-1][3] = last[3]
    return [tuple(c) for c in chunks]
