"""Two-stage search: vectors lie clustered in folders, a search reads the nearest clusters and scores what it finds exactly.

Centres come from Lloyd steps over a sample of about FIT rows: each task sums up the unit vectors that are nearest to each
centre, and the sums of a centre are added by key. Every vector is then dealt to its nearest centre and written by cluster;
vectors that come later are a delta, which every search takes whole until the next clustering.

`probes` clusters are read for a query (three quarters of all by default; data in clumps needs a few); with `exact` those too that may hold something better. With c a centre, t the angle
from the query to it, and r that to its farthest vector, no vector of the cluster has a cosine above cos(max(0, t - r)): so
what lies below the k-th best found so far is left unread, and the result is that of a full search.

Cases: invalid and zero vectors, and those of another dimension than the centres', are similar to nothing and lie in no
cluster; a vector of the delta replaces that of its id, and a deletion (a null vector) takes it away; ties go by id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heron.functions import vectors as V
from heron.operators.relational import upsert
from heron.operators.vectors import DEFAULT_K, VECTOR_BLOCK, best_of, met_best, nearest_to_each, search, unit

#: Rows that centres are fitted on (about), and the most centres; both bound what the driver holds.
FIT, MOST = 200_000, 4096
#: Tasks that write one cluster.
SPLIT = 8
#: Slack of the bounds for the products' last digits.
SLACK = 1e-9


def _matrix(v: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of this dimension and their rows."""
    rows = np.flatnonzero(pa.compute.list_value_length(v).fill_null(0).to_numpy(zero_copy_only=False) == dim)
    x = unit(v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim).astype(float))
    good = np.isfinite(x).all(1)
    return x[good], rows[good]


def _sums(batches: Iterable[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(centres.shape), np.zeros(len(centres), np.int64)
    for b in batches:
        x, _ = _matrix(b.column(0), centres.shape[1])
        near = (x @ centres.T).argmax(1) if len(x) else np.zeros(0, np.int64)
        np.add.at(total, near, x)
        n += np.bincount(near, minlength=len(centres))
    own = np.flatnonzero(n)
    yield pa.record_batch([pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array(list(total[own]), pa.list_(pa.float64()))], names=["cluster", "n", "total"])


def _added(rows: pa.Table) -> pa.Table:
    total = np.sum(np.stack(rows["total"].to_pylist()), axis=0)
    return pa.table({"cluster": rows["cluster"][:1], "n": [sum(rows["n"].to_pylist())], "total": pa.array([total.tolist()], pa.list_(pa.float64()))})


def fit_centres(vectors: DataFrame, n: int, rounds: int = 5, id_column: str = "vec_id", vector: str = "embedding", sample: int = FIT) -> np.ndarray:
    """Up to `n` unit vectors, from the first vectors by a hash of their ids."""
    valid = vectors.where(V.valid_embedding(vector) & F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    every = valid.count()
    if every > sample:
        valid = valid.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * sample / every))
    first = valid.orderBy(F.xxhash64("id"), "id").limit(min(n, MOST)).collect()
    if not first:
        return np.zeros((0, 0))
    dim = max(set(len(r.v) for r in first), key=[len(r.v) for r in first].count)
    centres = unit(np.array([r.v for r in first if len(r.v) == dim], float))
    centres = np.unique(centres[np.isfinite(centres).all(1)], axis=0)
    for _ in range(rounds if len(centres) else 0):
        sums = valid.select("v").mapInArrow(partial(_sums, centres=centres), "cluster int, n long, total array<double>")
        for r in sums.groupBy("cluster").applyInArrow(_added, "cluster int, n long, total array<double>").collect():  # a row a centre
            moved = unit(np.array([r.total]))[0]
            if np.isfinite(moved).all():
                centres[r.cluster] = moved
    return centres


def _near(batches: Iterable[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, rows = _matrix(b.column(1), centres.shape[1])
        sims = x @ centres.T
        near = sims.argmax(1) if len(x) else np.zeros(0, np.int64)
        taken = b.take(pa.array(rows))
        yield pa.record_batch([*taken.columns, pa.array(near.astype(np.int32)), pa.array(sims[np.arange(len(near)), near])], names=["vec_id", "embedding", "cluster", "near"])


def _probe(batches: Iterable[pa.RecordBatch], centres: np.ndarray, reach: np.ndarray, number: np.ndarray, probes: int, rest: bool) -> Iterator[pa.RecordBatch]:
    """Queries (vec_id, embedding, kth) with each of their nearest clusters; or with those of the others that may hold a
    vector as good as the k-th."""
    for b in batches:
        x, rows = _matrix(b.column(1), centres.shape[1])
        if not len(x):
            continue
        sims = x @ centres.T
        order = np.argsort(-sims, axis=1, kind="stable")
        first = np.zeros(sims.shape, bool)
        np.put_along_axis(first, order[:, :probes], True, axis=1)
        if rest:
            kth = b.column(2).fill_null(-2.0).to_numpy(zero_copy_only=False)[rows]
            first = ~first & (bounds(sims, reach) >= kth[:, None])
        i, j = np.nonzero(first)
        taken = b.take(pa.array(rows[i]))
        yield pa.record_batch([taken.column(0), taken.column(1), pa.array(number[j])], names=["vec_id", "embedding", "cluster"])


def bounds(sims: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The most that a vector of each cluster can have in common with a query, from the query's cosine to the centre and the
    least cosine of the cluster's vectors to it."""
    angle = np.arccos(np.clip(sims, -1, 1)) - np.arccos(np.clip(reach, -1, 1))
    return np.cos(np.maximum(angle, 0)) + SLACK


class ClusteredVectors:
    """Vectors (vec_id, embedding) in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/clusters").orderBy("cluster").collect()  # a row a cluster, MOST at most
        self.number = [r.cluster for r in rows]
        self.centres = np.array([r.centre for r in rows], float) if rows else np.zeros((0, 0))
        self.reach = np.array([r.reach for r in rows], float)

    @classmethod
    def write(cls, vectors: DataFrame, path: str, n: int, rounds: int = 5, id_column: str = "vec_id", vector: str = "embedding") -> ClusteredVectors:
        """Fits up to n centres and writes every vector by its cluster."""
        spark = vectors.sparkSession
        centres = fit_centres(vectors, n, rounds, id_column, vector)
        rows = vectors.where(V.valid_embedding(vector) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
        placed = rows.mapInArrow(partial(_near, centres=centres), "vec_id long, embedding array<double>, cluster int, near double")
        dealt = placed.repartition("cluster", F.pmod(F.xxhash64("vec_id"), F.lit(SPLIT)))  # a large cluster is several tasks'
        dealt.write.partitionBy("cluster").parquet(f"{path}/base")
        stats = spark.read.schema(placed.schema).parquet(f"{path}/base").groupBy("cluster").agg(F.count("*").alias("n"), F.min("near").alias("reach"))
        own = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, centre array<double>")
        own.join(stats, "cluster").coalesce(1).write.parquet(f"{path}/clusters")
        return cls(spark, path)

    def probes(self, given: int | None) -> int:
        """Three quarters of the clusters where none is given: vectors without any structure need as many for a recall of 0.9."""
        return -(-3 * len(self.number) // 4) if given is None else given

    def add(self, delta: DataFrame, place: int) -> None:
        """Vectors that come or go (a null embedding) after the clustering; of an id's rows that of the greatest place counts."""
        rows = delta.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.lit(place).cast("long").alias("place"))
        rows.write.parquet(f"{self.path}/delta/{place:020d}-{uuid.uuid4().hex}")

    def delta(self) -> DataFrame:
        from heron.sources.commits import Storage

        schema = "vec_id long, embedding array<double>, place long"
        names = Storage(self.spark).names(f"{self.path}/delta")
        none = self.spark.createDataFrame([], schema)
        if not names:
            return none.select("vec_id", "embedding")
        return upsert(none, self.spark.read.schema(schema).parquet(*[f"{self.path}/delta/{n}" for n in names]), ["vec_id"], ["place"]).select("vec_id", "embedding")

    def base(self, clusters: Sequence[int] | None = None) -> DataFrame:
        """The clustered vectors that no delta has replaced; of some clusters, whose folders alone are read."""
        rows = self.spark.read.schema("vec_id long, embedding array<double>, near double, cluster int").parquet(f"{self.path}/base")
        rows = rows if clusters is None else rows.where(F.col("cluster").isin(list(clusters)))
        return rows.join(self.delta().select("vec_id"), "vec_id", "left_anti").select("vec_id", "embedding", "cluster")

    def search(self, query: Sequence[float], k: int = DEFAULT_K, probes: int | None = None, exact: bool = False) -> DataFrame:
        """vec_id, score of the k best for one query."""
        probes = self.probes(probes)
        q = unit(np.array([query], float))
        sims = (q @ self.centres.T)[0] if self.centres.size and self.centres.shape[1] == len(query) and np.isfinite(q).all() else np.zeros(0)
        order = np.argsort(-sims, kind="stable")
        chosen = [self.number[i] for i in order[:probes].tolist()]
        fresh = self.delta()
        found = search(self.base(chosen).drop("cluster").unionByName(fresh), query, k)
        if not exact or not len(sims):
            return found
        scores = sorted((r.score for r in found.collect()), reverse=True)  # k rows
        kth = scores[-1] if len(scores) == (k if k > 0 else DEFAULT_K) else -2.0
        more = np.flatnonzero(bounds(sims, self.reach) >= kth)
        every = sorted({*chosen, *(self.number[i] for i in more.tolist())})
        return search(self.base(every).drop("cluster").unionByName(fresh), query, k)

    def nearest_to_each(self, queries: DataFrame, k: int = DEFAULT_K, probes: int | None = None, exact: bool = False, itself: bool = False, block: int = VECTOR_BLOCK) -> DataFrame:
        """hit_id, vec_id, score, rank: the k best for each query (vec_id, embedding)."""
        base, fresh, probes = self.base(), self.delta(), self.probes(probes)
        asked = queries.where(V.valid_embedding("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))

        def probed(rows: DataFrame, rest: bool) -> DataFrame:
            number = np.array(self.number, np.int32)
            own = rows.mapInArrow(partial(_probe, centres=self.centres, reach=self.reach, number=number, probes=probes, rest=rest), "vec_id long, embedding array<double>, cluster int")
            return met_best(base, own, k, "cluster", itself, block)

        none = F.lit(None).cast("double").alias("kth")
        found = probed(asked.withColumn("kth", none), False).unionByName(nearest_to_each(fresh, asked, k, itself=itself, block=block).select("hit_id", "vec_id", "score"))
        best = best_of(found, k, "hit_id")
        if not exact:
            return best
        place = f"{self.path}/found/{uuid.uuid4().hex}"  # it is read twice
        best.write.parquet(place)
        best = self.spark.read.schema(best.schema).parquet(place)
        kth = best.where(F.col("rank") == k).select(F.col("hit_id").alias("vec_id"), F.col("score").alias("kth"))
        more = probed(asked.join(kth, "vec_id", "left"), True)
        return best_of(best.drop("rank").unionByName(more), k, "hit_id")
