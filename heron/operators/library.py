"""The experience library: search within a scope, front matter, change detection, copies."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron.operators.vectors import search

OWN_K, OWN_MIN, PUBLIC_K, PUBLIC_MIN = 5, 0.3, 10, 0.4


def search_own(items: DataFrame, query: Sequence[float], owner: Column, k: int = OWN_K, min_score: float = OWN_MIN, **how) -> DataFrame:
    """The scope is applied before the search, so that k rows come out where there are as many."""
    return search(items, query, k, min_score=min_score, prefilter=owner, **how)


def search_public(items: DataFrame, query: Sequence[float], active: Column, k: int = PUBLIC_K, min_score: float = PUBLIC_MIN, **how) -> DataFrame:
    return search(items, query, k, min_score=min_score, prefilter=active, **how)


def orphans(vectors: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Vectors whose parent is gone."""
    return vectors.join(parents.select(key), key, "left_anti")


def changed(items: DataFrame, previous: DataFrame, key: str, content: Column) -> DataFrame:
    """Items that are new or whose SHA-256 differs from the one kept (key, fingerprint)."""
    own = items.withColumn("fingerprint", F.sha2(content, 256))
    old = previous.select(key, F.col("fingerprint").alias("_old"))
    return own.join(old, key, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("fingerprint"))).drop("_old")


def copy_to(private: DataFrame, public: DataFrame, owner: Column, dedupe: bool = False, key: str = "source_id") -> DataFrame:
    """Public items appended to private ones; with `dedupe` those that the owner copied before are left out."""
    new = public.withColumn("owner", owner)
    if dedupe:
        new = new.join(private.select("owner", key).distinct(), ["owner", key], "left_anti")
    return private.unionByName(new)


def title_or_head(title: Column, content: Column, most: int = 100) -> Column:
    """A missing or blank title becomes the head of the content, in code points."""
    return F.coalesce(F.when(F.trim(title) != "", title), F.substring(content, 1, most))


FRONT = "name string, description string, body string, error string"


#: A key in quotes, or plain: a colon in it has no space behind it, and a # none in front of it.
_KEY = re.compile(
    r"""(?:"(?P<double>(?:[^"\\]|\\.)*)"|'(?P<single>(?:[^']|'')*)'|(?P<plain>(?:[^\s\-?:,\[\]{}#&*!|>'"%@`]|[\-?:](?=\S))(?:[^\s:#]|:(?=\S)|(?<=\S)\#|[ \t]+(?=[^\s#]))*?))[ \t]*:(?:[ \t]+(?P<value>.*))?"""
)
#: Plain values that mean none.
_NULLS = ("", "~", "null", "Null", "NULL")


def _key(line: str) -> tuple[str, str] | None:
    """The key and the value of a line of a mapping."""
    own = _KEY.fullmatch(line)
    if not own:
        return None
    if own["double"] is not None:
        key = json.loads(f'"{own["double"]}"')
    else:
        key = own["plain"] if own["single"] is None else own["single"].replace("''", "'")
    return key, own["value"] or ""


def _scalar(value: str, more: list[str]) -> str:
    """The text of a value and of the indented lines behind it: block (| and >), quoted or plain, as YAML has them."""
    head = re.fullmatch(r"([|>])([+-]?)\d?([+-]?)(?:\s+#.*)?", value)
    if head:
        first = next((x for x in more if x.strip()), "")
        indent = len(first) - len(first.lstrip(" "))
        lines = [x[indent:] for x in more]
        while lines and not lines[-1].strip():
            lines.pop()
        if head[1] == "|":
            text = "\n".join(lines)
        else:  # single line ends fold to spaces, blank lines stay as line ends
            text = re.sub(r"(?<=[^\n])\n(?=[^\n])", " ", "\n".join(lines))
            text = re.sub(r"(?<=[^\n])\n(\n+)(?=[^\n])", r"\1", text)
        chomp = head[2] or head[3]
        return text if chomp == "-" or not text else text + "\n" * (1 if not chomp else 1 + len(more) - len(lines))
    value = " ".join([value, *(x.strip() for x in more if x.strip())]).strip()
    if value[:1] in ("'", '"'):
        closed = re.fullmatch(r"'((?:[^']|'')*)'(?:\s+#.*)?" if value[0] == "'" else r'"((?:[^"\\]|\\.)*)"(?:\s+#.*)?', value)
        if not closed:
            raise ValueError("a quote is not closed")
        return closed[1].replace("''", "'") if value[0] == "'" else json.loads(f'"{closed[1]}"')
    if value[:1] in ("[", "{"):
        if value.count("[") != value.count("]") or value.count("{") != value.count("}"):
            raise ValueError("a bracket is not closed")
        return value
    value = re.sub(r"(?:^|\s+)#.*$", "", value)
    if value[:1] in ("&", "*", "!", "%", "@", "`", "]", "}", ",", "|", ">") or re.match(r"[-?](?:\s|$)", value):
        raise ValueError("not a plain value")
    if re.search(r":(?:\s|$)", value):
        raise ValueError("a mapping within a value")
    return "" if value in _NULLS else value


def parse_front_matter(raw: str | None) -> tuple[str | None, str | None, str | None, str | None]:
    """name, description, body, error. The text starts with a line of three dashes; a YAML mapping follows up to the next
    such line. Of the two keys a missing one, and one that is null, is empty, and a list or a mapping is an error; other
    keys are only checked. A key that comes twice is an error."""
    lines = (raw or "").replace("\r\n", "\n").split("\n")
    end = next((i for i, x in enumerate(lines[1:], 1) if x == "---"), None) if lines[0] == "---" else None
    if end is None:
        return None, None, None, "no front matter"
    found: dict[str, str] = {}
    i = 1
    try:
        while i < end:
            line, i = lines[i], i + 1
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            own = _key(line)
            if not own or line[0].isspace():
                raise ValueError("not a key and a value")
            name, value = own
            if name in found:
                raise ValueError("a key comes twice")
            begun = i
            blank = not value or value.startswith("#")
            while i < end and (not lines[i].strip() or lines[i][0] == " " or (blank and re.match(r"-(?:\s|$)", lines[i]))):
                i += 1
            more = lines[begun:i]
            nested = blank and any(_key(x.strip()) or re.match(r"-(?:\s|$)", x.lstrip()) for x in more)
            if name in ("name", "description") and (nested or value[:1] in ("[", "{")):
                raise ValueError(f"{name} is no text")
            found[name] = "" if nested else _scalar("" if blank else value, more)
    except ValueError as e:
        return None, None, None, f"no YAML: {e}"
    return found.get("name", ""), found.get("description", ""), "\n".join(lines[end + 1 :]).lstrip("\n"), None


def _front(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [parse_front_matter(x) for x in b.column("raw").to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.record_batch([*b.columns, *(pa.array(c, pa.string()) for c in columns)], names=["doc_id", "raw", "name", "description", "body", "error"])


def _parsed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "raw").mapInArrow(_front, f"doc_id long, raw string, {FRONT}")


def front_matter(docs: DataFrame) -> DataFrame:
    """docs (doc_id, raw) with name, description, body, or the error; a row for each row, whatever its id."""
    return _parsed(docs).drop("raw")


def ingested(docs: DataFrame) -> DataFrame:
    """docs (doc_id, raw): doc_id, title, description, body. The title is the front matter's name, or else the head of
    the body; a text without front matter is all body."""
    parsed = _parsed(docs).drop("body")
    plain = F.replace("raw", F.lit("\r\n"), F.lit("\n"))
    body = F.when(F.col("error").isNull(), F.regexp_replace(plain, r"(?s)\A---\n(?:.*?\n)?---(?:\n+|\z)", "")).otherwise(plain)
    return parsed.select("doc_id", title_or_head(F.col("name"), body).alias("title"), "description", body.alias("body"))


def recall(items: DataFrame, asked: DataFrame, key: str = "item_id", owner: str = "owner") -> DataFrame:
    """asked (key, owner) with the item if it is the owner's, else with `error`."""
    found = asked.join(items.withColumn("_found", F.lit(True)), [key, owner], "left")
    return found.withColumn("error", F.when(F.col("_found").isNull(), F.lit("not found"))).drop("_found")


def updated(items: DataFrame, updates: DataFrame, fields: list[str], text: str = "description", key: str = "item_id", owner: str = "owner", order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The items with the fields of `updates` (key, owner, fields), where they are the owner's; and those whose `text`
    changed or that have none yet, which alone are embedded again (key, text). Where an item came from stays. Of several
    updates of an item the last by `order` (columns of the updates) counts, or without an order the greatest."""
    last = F.max_by(F.struct(*fields), F.struct(*(order or fields)))
    new = updates.groupBy(key, owner).agg(last.alias("_new"))
    joined = items.join(new, [key, owner], "left")
    out = joined.select(*[F.when(F.col("_new").isNull(), F.col(c)).otherwise(F.col(f"_new.{c}")).alias(c) if c in fields else F.col(c) for c in items.columns])
    stale = joined.where(F.col("_new").isNotNull() & ~F.col(f"_new.{text}").eqNullSafe(F.col(text))).select(key, F.col(f"_new.{text}").alias(text))
    return out, stale


def deliveries(asked: DataFrame, files: DataFrame, at: Column) -> DataFrame:
    """asked (delivery_id, sender, receiver, session_id, paths array): the audit row of each delivery, its paths as JSON.
    It has to have paths, and all of them among the files (path); else it has an error and delivers nothing."""
    each = asked.select("delivery_id", F.explode("paths").alias("path"))
    absent = each.join(files.select("path"), "path", "left_anti").groupBy("delivery_id").agg(F.count("*").alias("_absent"))
    out = asked.join(absent, "delivery_id", "left")
    error = F.when(F.coalesce(F.size("paths"), F.lit(0)) <= 0, "no paths").when(F.col("_absent") > 0, F.concat(F.col("_absent").cast("string"), F.lit(" missing")))
    return out.select("delivery_id", "sender", "receiver", "session_id", F.when(error.isNull(), F.to_json("paths")).alias("paths"), error.alias("error"), at.alias("created_at"))
