"""Text functions. Sizes are code points unless a name says bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_any_case(text: Column, needle: str) -> Column:
    """% and _ have no meaning of their own; an empty needle is in every text."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


def keyword_score(text: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords the text has; one given twice counts twice."""
    out = F.lit(0)
    for k in keywords:
        out = out + contains_any_case(text, k).cast("int")
    return out


def head_bytes(text: Column, most: int, slack: int = 1024) -> Column:
    """The first `most` bytes in UTF-8, cut back to the last line end if it lies within `slack` of the cut; as binary, as
    the cut may part a character."""
    raw = text.cast("binary")
    cut = F.substring(raw, 1, most)
    back = F.instr(F.reverse(F.decode(cut, "ISO-8859-1")), "\n")  # from the end, 0: none
    return F.when(F.octet_length(text) <= most, raw).when((back > 0) & (back <= slack), F.substring(raw, F.lit(1), F.lit(most) - back)).otherwise(cut)


def tail_bytes(text: Column, most: int, slack: int = 1024) -> Column:
    """The last `most` bytes in UTF-8, from behind the first line end if it lies within `slack` of the cut; as binary."""
    raw = text.cast("binary")
    cut = F.substring(raw, F.octet_length(text) - most + 1, F.lit(most))
    at = F.instr(F.decode(cut, "ISO-8859-1"), "\n")
    return F.when(F.octet_length(text) <= most, raw).when((at > 0) & (at <= slack), F.substring(cut, at + 1, F.lit(most))).otherwise(cut)


def head(text: Column, most: int, slack: int = 1024) -> Column:
    """head_bytes as text: what is left of a parted character becomes a replacement character."""
    return F.make_valid_utf8(head_bytes(text, most, slack).cast("string"))


def tail(text: Column, most: int, slack: int = 1024) -> Column:
    return F.make_valid_utf8(tail_bytes(text, most, slack).cast("string"))


def limit_output(text: Column, most_bytes: int = 51200, notice: str = "output too large") -> Column:
    return F.when(F.octet_length(text) > most_bytes, F.lit(notice)).otherwise(text)


#: White space by Unicode's property.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends; F.trim takes blanks only."""
    return F.btrim(text, F.lit(SPACE))


def shortened(text: Column, most: int) -> Column:
    """Titles (15) and snippets (200): the first characters and three dots where more follows."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def occurrences(text: Column, needle: str) -> Column:
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def replace_exact(text: Column, old: str, new: str, every: bool = False) -> tuple[Column, Column]:
    """The edited text and an error: none found, or more than one without `every`; the text is null with an error."""
    n = occurrences(text, old)
    error = F.when(n == 0, F.lit("not found"))
    if not every:
        error = error.when(n > 1, F.concat(F.lit("found "), n.cast("string"), F.lit(" times")))
    return F.when(error.isNull(), F.replace(text, F.lit(old), F.lit(new))), error


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def numbered_lines(text: Column) -> Column:
    return F.array_join(F.transform(lines_of(text), lambda line, i: F.concat((i + 1).cast("string"), F.lit("| "), line)), "\n")


def line_range(text: Column, start: int, end: int, fallback: str = "") -> Column:
    """Lines start to end (from 1), or the fallback where the text doesn't have them."""
    lines = lines_of(text)
    fits = (F.size(lines) >= end) & F.lit(1 <= start <= end)
    return F.when(fits, F.array_join(F.slice(lines, max(start, 1), max(end - start + 1, 0)), "\n")).otherwise(F.lit(fallback))


def page_of_lines(text: Column, offset: int = 1, limit: int = 200, most: int = 500) -> Column:
    return F.slice(lines_of(text), max(offset, 1), min(limit if limit > 0 else 200, most))


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.char_length(text) / 4).cast("int")


def phrase(code: Column, phrases: dict[int, str]) -> Column:
    """A code's phrase; an unknown code passes through as text."""
    out = code.cast("string")
    for k, v in phrases.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return out


def sections(*parts: tuple[str, Column, Column | None], joint: str = "\n\n") -> Column:
    """(title, body, condition): a text of those sections whose body is not empty and whose condition, if any, holds; in
    the order given, each under its title."""
    out = []
    for title, body, condition in parts:
        shown = body != ""
        if condition is not None:
            shown = shown & condition
        out.append(F.when(shown, F.concat(F.lit(title + "\n"), body)))
    return F.concat_ws(joint, *out)


def prompt(character: Column, profiles: Column, story: Column, version: Column, dialog: Column, segments: Column, result: Column, state: Column, guidance: Column) -> Column:
    """The context of an answer. A story is told only if there is one, on a summary (version -1: none)."""
    return sections(
        ("# Character", character, None), ("# People", profiles, None), ("# Story so far", story, version != -1), ("# Dialog", dialog, None), ("# Related", segments, None), ("# Result", result, None), ("# State", state, None), ("# Guidance", guidance, None)
    )


def rendered_note(at: Column, kind: Column, content: Column, references: Column, conflicts: Column) -> Column:
    """A note as a section of its own: heading, content, the list of its references, and what it conflicts with."""
    refs = F.when(F.size(references) > 0, F.concat(F.lit("\nReferences:\n"), F.array_join(F.transform(references, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")))
    conflict = F.when(conflicts != "", F.concat(F.lit("\nConflicts with: "), conflicts, F.lit("\n")))
    return F.concat(F.lit("## ["), at, F.lit("] "), kind, F.lit("\n\n"), content, F.lit("\n"), F.coalesce(refs, F.lit("")), F.coalesce(conflict, F.lit("")))


def trimmed_notes(text: Column, most: int, notice: str = "[older notes left out]\n\n") -> Column:
    """The last `most` bytes of rendered notes, from the first heading among them if there is one; what is left of a parted
    character becomes a replacement character."""
    cut = F.substring(text.cast("binary"), F.octet_length(text) - most + 1, F.lit(most))
    at = F.instr(F.decode(cut, "ISO-8859-1"), "\n## [")
    kept = F.make_valid_utf8(F.when(at > 0, F.substring(cut, at + 1, F.lit(most))).otherwise(cut).cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.lit(notice), kept))


def lines_page(text: Column, offset: int = 1, limit: int = 200, most: int = 500, most_bytes: int = 10 << 20) -> tuple[Column, Column, Column]:
    """A page of lines, how many lines follow it, and an error for a text that is too large."""
    size = min(limit if limit > 0 else 200, most)
    large = F.octet_length(text) > most_bytes
    left = F.greatest(F.size(lines_of(text)) - F.lit(max(offset, 1) - 1 + size), F.lit(0))
    return F.when(~large, page_of_lines(text, offset, limit, most)), F.when(~large, left), F.when(large, F.lit("too large"))


def lines_or(mode: Column, text: Column, given: Column, start: int, end: int) -> Column:
    """A field of a record: `preserve` takes its lines from the source text (or what is given where it doesn't have
    them), `supplement` takes those and then what is given, `generate` only what is given."""
    own = line_range(text, start, end)
    kept = F.when(own != "", own).otherwise(given)
    both = F.concat_ws("\n", F.when(own != "", own), F.when(given != "", given))
    return F.when(mode == "preserve", kept).when(mode == "supplement", both).otherwise(given)
