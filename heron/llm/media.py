"""Media columns: payloads as baseline JPEG, and their dimensions and thumbnail hashes read back from the images.

Cases: a null or empty text is one unit of spaces; a text of any length is one image, as a step of its own (65,535 pixels
each way hold more than a Spark value can); equal texts give equal values, repeated ids rows of their own; a column of
images that came from elsewhere may hold nulls and damaged images, which give null features and the reason in `error`;
other columns pass through media_features and are never read by text_media; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import steps, utf8


def _store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches):
        texts = utf8(b.column("text"))
        media = jpeg.encode([t.ljust(max(1, -(-len(t) // jpeg.UNIT)) * jpeg.UNIT) for t in texts])
        yield pa.record_batch([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8), media (the image that has the text, padded with spaces to units of 192)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, thumbnail_hash string, error string"


def _one(data: bytes | None, image: jpeg.Image | None, error: str | None) -> tuple:
    if data is None:
        return (None,) * 9
    stored = (len(data), hashlib.sha256(data).hexdigest())
    if image is None:
        return (None, None, None, *stored, None, None, None, error)
    own = (None, None, None)
    if len(image.comment) == 8 and len(image.blocks) == 3:
        p = jpeg.payload(image)
        own = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    return (*own, *stored, image.width, image.height, f"{jpeg.difference_hash(jpeg.thumbnail(image)):016x}", None)


def _images(datas: list[bytes | None]) -> list[tuple]:
    try:
        good = iter(jpeg.decode([d for d in datas if d is not None]))
        return [_one(d, d is not None and next(good) or None, None) for d in datas]
    except (ValueError, KeyError, IndexError) as e:  # some image is damaged: each by itself shows which
        return [_images([d])[0] for d in datas] if len(datas) > 1 else [_one(datas[0], None, str(e) or type(e).__name__)]


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches, "media"):
        rows = _images(b.column("media").to_pylist())
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        keep = [n for n in b.schema.names if n != "media"]
        yield pa.record_batch([b.column(n) for n in keep] + [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=keep + [x.split()[0] for x in FEATURES.split(", ")])


def media_features(media: DataFrame) -> DataFrame:
    """Decodes the images of `media`: dimensions, thumbnail hash, sizes and digests in place of that column. Columns
    with the names of these are left out."""
    made = {x.split()[0] for x in FEATURES.split(", ")}
    kept = [f for f in media.schema.fields if f.name not in made and f.name != "media"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [FEATURES])
    return media.select(*[F.col(f"`{f.name}`") for f in kept], "media").mapInArrow(_features, schema)


def media_digests(docs: DataFrame) -> DataFrame:
    return media_features(text_media(docs)).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.format_string("%dx%d:%s", "width", "height", "thumbnail_hash").alias("feature")
    )
