"""Exact vector search: every vector is scored, so results have a fixed order (score, then id) and full recall."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from heron.functions import vectors as V

DEFAULT_K = 5


def search(vectors: DataFrame, query: Sequence[float], k: int = DEFAULT_K, id_column: str = "vec_id", vector: str = "embedding", min_score: float | None = None, metric: str = "cosine", prefilter: Column | None = None) -> DataFrame:
    """id, score of the k best: similarity for cosine, distance (least first) for other metrics. The query is a literal,
    so there is no join; each task keeps k rows. Vectors of another dimension than the query's are left out. `prefilter`
    holds before the cut, so that k rows come out where there are as many; drop_deleted works after it."""
    vectors = vectors if prefilter is None else vectors.where(prefilter)
    k = k if k > 0 else DEFAULT_K
    cosine = metric == "cosine"
    score = V.cosine_similarity(vector, query) if cosine else V.distance(metric)(vector, query)
    scored = vectors.where(V.valid_embedding(vector)).select(F.col(id_column), score.alias("score")).where(F.col("score").isNotNull() & ~F.isnan("score"))
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score if cosine else F.col("score") <= min_score)
    return scored.orderBy(F.desc("score") if cosine else F.asc("score"), id_column).limit(k)


def search_each(vectors: DataFrame, query: Sequence[float], group: str, k: int = DEFAULT_K, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best of every group, one after another without a common ranking. Spark cuts each task's rows to k a group
    before it shuffles them."""
    scored = vectors.where(V.valid_embedding(vector)).select(group, id_column, V.cosine_similarity(vector, query).alias("score")).where(F.col("score").isNotNull() & ~F.isnan("score"))
    best = Window.partitionBy(group).orderBy(F.desc("score"), id_column)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= (k if k > 0 else DEFAULT_K))


def drop_deleted(hits: DataFrame, deleted: DataFrame, id_column: str = "vec_id") -> DataFrame:
    """After the cut, so that fewer than k may stay; call it before search for a full k."""
    return hits.join(deleted.select(id_column).distinct(), id_column, "left_anti")


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame, id_column: str = "vec_id") -> DataFrame:
    """Hits with their chunk (id_column, doc_id, ...) and document; a hit without either is left out. The k rows of a
    search are small enough for Spark to broadcast by itself; those of many queries need not be."""
    return hits.join(chunks, id_column).join(documents, "doc_id")


def statistics(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    v = F.col(vector)
    return vectors.agg(
        F.min(F.size(v)).alias("min_dim"),
        F.max(F.size(v)).alias("max_dim"),
        F.count_if(F.forall(v, lambda x: x == 0)).alias("zero_vectors"),
        F.count_if(~V.valid_embedding(v)).alias("invalid_vectors"),
        F.count("*").alias("n"),
    )


#: Vectors that a task holds at a time (about: a hash deals them), and queries that are multiplied with them at once.
VECTOR_BLOCK, QUERY_STEP = 16384, 256
#: Vectors that a task sorts (about).
TASK_ROWS = 200_000
#: Of a similarity, so that equal vectors tie wherever they stand in a product.
DIGITS = 12
#: A kernel takes the queries' ids and unit vectors and the block's, and gives (query, vector) places with their scores.
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero vector becomes NaN, which is similar to nothing."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def _above(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sims = np.round(q @ x.T, DIGITS)
    i, j = np.nonzero(sims > threshold)
    keep = q_ids[i] != ids[j]
    return i[keep], j[keep], sims[i[keep], j[keep]]


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, itself: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of the block for each query, the least ids among ties."""
    sims = np.round(q @ x.T, DIGITS)
    sims[np.isnan(sims)] = -np.inf
    if not itself:
        sims[q_ids[:, None] == ids[None, :]] = -np.inf
    if len(ids) > k:
        least = np.partition(sims, len(ids) - k, axis=1)[:, len(ids) - k, None]
        i, j = np.nonzero((sims >= least) & (sims > -np.inf))
    else:
        i, j = np.nonzero(sims > -np.inf)
    score = sims[i, j]
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k], score[rank < k]


def _meet(batches: Iterable[pa.RecordBatch], kernel: Kernel) -> Iterator[pa.RecordBatch]:
    """Rows (group, dim, block, side, id, v) in this order: the vectors of a block (side 0) are held, and the queries
    behind them (side 1) stream past in steps."""
    key, held, block = None, [], None
    for b in batches:
        group = b.column(0).dictionary_encode()
        names = group.dictionary.to_pylist()
        code = np.stack([group.indices.to_numpy(), *[b.column(c).to_numpy() for c in (1, 2, 3)]])
        cuts = (np.flatnonzero((code[:, 1:] != code[:, :-1]).any(0)) + 1).tolist()
        ids, v = b.column(4).to_numpy(), b.column(5)
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
        place = np.append(0, np.cumsum(pa.compute.list_value_length(v).to_numpy(zero_copy_only=False)))
        out = []
        for s, e in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            own = (names[code[0, s]], *code[1:3, s].tolist())
            if own != key:
                key, held, block = own, [], None
            x = unit(flat[place[s] : place[e]].reshape(e - s, -1))
            if code[3, s] == 0:
                held.append((ids[s:e], x))
                continue
            if block is None and held:
                block, held = (np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])), []
            if block is None:
                continue
            for k in range(0, e - s, QUERY_STEP):
                q_ids = ids[s + k : min(s + k + QUERY_STEP, e)]
                i, j, score = kernel(q_ids, x[k : k + QUERY_STEP], *block)
                if len(i):
                    out.append((np.full(len(i), code[0, s]), q_ids[i], block[0][j], score))
        if out:
            g, hit, own, score = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.record_batch([group.dictionary.take(pa.array(g)), pa.array(hit), pa.array(own), pa.array(score)], names=["group", "hit_id", "vec_id", "score"])


def _met(vectors: DataFrame, queries: DataFrame, kernel: Kernel, id_column: str, vector: str, scope: str | None, group: str | None, block: int) -> DataFrame:
    """group, hit_id, vec_id, score: every query against all vectors, or those of its `scope` (a column of both), the
    kernel's choice from each block. Vectors are dealt once, into blocks of bounded size by a hash of the id within their
    scope or `group` (a column of theirs); only the queries are copied, once for each block that they meet. Nothing passes
    through the driver, a task holds one block, and a scope or group of any size is many tasks'. Only what needs more than
    one block is counted out to all tasks, so the vectors are shuffled and sorted once, in their own width and by
    partitions that don't grow with the table."""
    narrow = all(isinstance(df.schema[vector].dataType, ArrayType) and isinstance(df.schema[vector].dataType.elementType, FloatType) for df in (vectors, queries))

    def side(df: DataFrame, name: str | None, number: int) -> DataFrame:
        own = F.lit("") if name is None else F.col(name).cast("string")
        return df.where(V.valid_embedding(vector) & F.col(id_column).isNotNull() & own.isNotNull()).select(own.alias("_g"), F.size(vector).alias("_dim"), F.lit(number).alias("_side"), F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<float>" if narrow else "array<double>").alias("v"))

    x, q = side(vectors, scope or group, 0), side(queries, scope, 1)
    cells = x.groupBy("_g", "_dim").agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    large = F.broadcast(cells.where("_n > 1"))  # a row for each `block` vectors at most
    columns = ["_g", "_dim", "_block", "_side", "id", "v"]
    x = x.join(large, ["_g", "_dim"], "left").withColumn("_block", F.coalesce(F.pmod(F.xxhash64("id"), "_n").cast("int"), F.lit(0))).select(columns)
    q = q.drop("_g").join(cells, ["_dim"]) if group and not scope else q.join(large, ["_g", "_dim"], "left")
    q = q.withColumn("_block", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).select(columns)
    keys = ["_g", "_dim", "_block"]
    parts = -(-vectors.count() // TASK_ROWS)
    more = [parts] if parts > int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    rows = x.unionByName(q).repartition(*more, *keys).sortWithinPartitions(*keys, "_side")
    return rows.mapInArrow(partial(_meet, kernel=kernel), "group string, hit_id long, vec_id long, score double")


def similar_to_set(vectors: DataFrame, queries: DataFrame, threshold: float = 0.8, id_column: str = "vec_id", vector: str = "embedding", scope: str | None = None, block: int = VECTOR_BLOCK) -> DataFrame:
    """hit_id, vec_id, score: pairs above the threshold (strictly) of a query set against all rows, or against those of
    the query's `scope` (a column of both). Only vectors of one dimension are compared."""
    return _met(vectors, queries, partial(_above, threshold=threshold), id_column, vector, scope, None, block).select("hit_id", "vec_id", "score")


def best_of(partial_hits: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k best of each key's rows, with their rank. Spark cuts each task's rows to k a key before it shuffles them."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return partial_hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def met_best(vectors: DataFrame, queries: DataFrame, k: int, scope: str, itself: bool, block: int = VECTOR_BLOCK) -> DataFrame:
    """hit_id, vec_id, score: the k best of each block for every query within its scope, to be merged by best_of."""
    return _met(vectors, queries, partial(_best, k=k, itself=itself), "vec_id", "embedding", scope, None, block).select("hit_id", "vec_id", "score")


def nearest_to_each(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_K, id_column: str = "vec_id", vector: str = "embedding", group: str | None = None, itself: bool = False, block: int = VECTOR_BLOCK) -> DataFrame:
    """(group,) hit_id, vec_id, score, rank: for each query the k most similar vectors, or those of each `group` of the
    vectors, least ids first among ties. A task puts out k rows for a query and block, which are merged by query; there is
    no row for each pair. A query that is among the vectors finds itself only with `itself`. A zero vector, and one of
    another dimension, is similar to nothing; an invalid one and one without an id are left out."""
    k = k if k > 0 else DEFAULT_K
    met = _met(vectors, queries, partial(_best, k=k, itself=itself), id_column, vector, None, group, block)
    return best_of(met, k, "group", "hit_id").withColumnRenamed("group", group) if group else best_of(met.drop("group"), k, "hit_id")


def _decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        blobs = b.column(1).to_pylist()
        yield pa.record_batch([b.column(0), pa.array([None if x is None or len(x) % 4 else np.frombuffer(x, "<f4").tolist() for x in blobs], pa.list_(pa.float32()))], names=["chunk_id", "embedding"])


def decode_blobs(df: DataFrame) -> DataFrame:
    """(chunk_id, blob) of little-endian 32-bit floats as arrays; null where the length is no multiple of four."""
    return df.select(F.col("chunk_id").cast("long"), "blob").mapInArrow(_decode, "chunk_id long, embedding array<float>")


def _encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = b.column(1)
        raw, ends = v.flatten().cast(pa.float32()).to_numpy(zero_copy_only=False).astype("<f4").tobytes(), np.cumsum(pa.compute.list_value_length(v).fill_null(0).to_numpy(zero_copy_only=False)) * 4
        blobs = [raw[a:e] for a, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(ends) else []
        yield pa.record_batch([b.column(0), pa.array([x if ok else None for x, ok in zip(blobs, v.is_valid().to_pylist(), strict=True)], pa.binary())], names=["chunk_id", "blob"])


def encode_blobs(df: DataFrame) -> DataFrame:
    """(chunk_id, embedding) as blobs of little-endian 32-bit floats; a null stays null."""
    return df.select(F.col("chunk_id").cast("long"), F.col("embedding").cast("array<float>")).mapInArrow(_encode, "chunk_id long, blob binary")


def with_embeddings(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], size: int, batch: int = 10, content: str = "content", name: str = "embedding") -> DataFrame:
    """Chunks with the vectors that `embed` gives for their texts, `batch` at a time in the tasks. A null text has none.
    An answer of another length than asked for, or a vector that is empty, of another `size`, or not finite, fails."""
    schema = StructType([*chunks.schema.fields, StructField(name, ArrayType(DoubleType()))])

    def run(batches: Iterable[pa.RecordBatch], target: pa.Schema) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(content).to_pylist()
            some = [i for i, t in enumerate(texts) if t is not None]
            out: list = [None] * len(texts)
            for k in range(0, len(some), batch):
                part = some[k : k + batch]
                got = embed([texts[i] for i in part])
                if len(got) != len(part):
                    raise ValueError(f"{len(part)} texts were sent and {len(got)} vectors came back")
                for i, v in zip(part, got, strict=True):
                    if len(v) != size or not np.isfinite(v).all():
                        raise ValueError("a vector is not valid")
                    out[i] = [float(x) for x in v]
            yield pa.record_batch([*b.columns, pa.array(out, pa.list_(pa.float64()))], schema=target)

    return chunks.mapInArrow(partial(run, target=to_arrow_schema(schema)), schema)
