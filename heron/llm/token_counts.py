"""Delta-maintained rollups of token counts by source, language and tokenizer version.

A rollup is a folder. A batch of signed changes is aggregated and written to the folder of its id; Spark's commit puts
the mark of success there last. A batch whose mark exists is skipped, and one that broke off is overwritten, so a batch
counts once however often it is delivered. Totals are the sums over marked batches; compact() folds batches into
a base that names them, so that delivering one of them again is still without effect.

Changes are rows: insert (+1 document, +tokens), delete (-1, -tokens), revise (0, new - old).

Cases: null source, language or version is a group of its own; a group whose documents are all gone has a row of zeros;
a null or empty text has no tokens; a text of any length is counted whole; repeated rows count each, and a deletion takes
away all rows of its id; a row without an id counts, and no deletion finds it; an empty batch is a batch; other columns are
never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codec import codec
from .common import shared_dir, steps, strings, written

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens")


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _folders(self, kind: str) -> list[str]:
        files, p = self._hadoop(f"{self.path}/{kind}")
        if not files.exists(p):
            return []
        found = [s.getPath() for s in files.listStatus(p) if s.isDirectory()]
        return sorted(f"{self.path}/{kind}/{x.getName()}" for x in found if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))

    def _base(self) -> str | None:
        return (self._folders("base") or [None])[-1]

    def _folded(self, ids: list[str]) -> set[str]:
        """Those of the ids that the base has."""
        base = self._base()
        if not base or not ids:
            return set()
        return {r.id for r in self.spark.read.parquet(f"{base}/batches").where(F.col("id").isin(ids)).collect()}  # no more than were asked for

    def _open(self) -> list[str]:
        """The ids of the committed batches that are not in the base."""
        ids = [x.rpartition("/")[2] for x in self._folders("batch")]
        folded = self._folded(ids)  # left where compact() broke off before it deleted them
        return [x for x in ids if x not in folded]

    def has(self, batch_id: str) -> bool:
        """Whether this batch counts."""
        return batch_id in self._open() or bool(self._folded([batch_id]))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds signed changes (KEYS, SUMS); False if this batch counts already."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if self.has(batch_id):
            return False
        sums = changes.groupBy(*KEYS).agg(*(F.sum(c).cast("long").alias(c) for c in SUMS))
        sums.write.mode("overwrite").parquet(f"{self.path}/batch/{batch_id}")
        return True

    def totals(self) -> DataFrame:
        """KEYS and the sums of all committed batches."""
        base = self._base()
        paths = [f"{self.path}/batch/{x}" for x in self._open()] + ([f"{base}/sums"] if base else [])
        if not paths:
            return self.spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in KEYS] + [T.StructField(c, T.LongType()) for c in SUMS]))
        return self.spark.read.parquet(*paths).groupBy(*KEYS).agg(*(F.sum(c).cast("long").alias(c) for c in SUMS))

    def compact(self) -> None:
        """Folds all batches into a new base; their folders go once it stands."""
        ids, old, base = self._open(), self._folders("batch"), self._base()
        path = f"{self.path}/base/{len(self._folders('base')):08d}"
        self.totals().write.mode("overwrite").parquet(f"{path}/sums")
        batches = self.spark.createDataFrame([(x,) for x in ids], "id string")
        if base:
            batches = batches.unionByName(self.spark.read.parquet(f"{base}/batches"))
        batches.write.mode("overwrite").parquet(f"{path}/batches")
        files, mark = self._hadoop(f"{path}/_SUCCESS")
        files.create(mark, True).close()
        for x in old:
            files, p = self._hadoop(x)
            files.delete(p, True)


def inserts(counts: DataFrame) -> DataFrame:
    """counts: KEYS, n_tokens of a document a row."""
    return counts.select(*KEYS, F.lit(1).alias("n_docs"), F.col("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(counts: DataFrame, old: str, new: str) -> DataFrame:
    return counts.select(*KEYS, F.lit(0).alias("n_docs"), (F.col(new) - F.col(old)).alias("n_tokens"))


def _count(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode = codec(path).encode
    for b in steps(batches, limit=1 << 20):
        n = [len(x) // 4 for x in encode(strings(b.column("text")))]
        keep = [c for c in b.schema.names if c != "text"]
        yield pa.record_batch([*(b.column(c) for c in keep), pa.array(n, pa.int64())], names=[*keep, "exact"])


def token_counts(docs: DataFrame, path: str, version: str) -> DataFrame:
    """doc_id, KEYS, estimate (a quarter of the bytes, as known on arrival), exact (the tokens of the whole text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.lit(version).alias("tokenizer"), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4).alias("estimate"), "text")
    return rows.mapInArrow(partial(_count, path=path), "doc_id long, source string, lang string, tokenizer string, estimate long, exact long")


def maintained_totals(docs: DataFrame, withdrawn: DataFrame, path: str, version: str) -> DataFrame:
    """A rollup kept through four deliveries: arrivals with estimates, revisions by exact counts (delivered twice), and
    the documents of `withdrawn` (doc_id) deleted. Its totals are those of the documents that are left."""
    counts = written(token_counts(docs, path, version), "counts")
    rollup = Rollup(docs.sparkSession, shared_dir(docs.sparkSession, "rollup"))
    rollup.commit("arrivals", inserts(counts.withColumn("n_tokens", F.col("estimate"))))
    revised = revisions(counts, "estimate", "exact")
    rollup.commit("revisions", revised)
    rollup.commit("revisions", revised)
    gone = counts.join(withdrawn.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    rollup.commit("withdrawals", deletes(gone.withColumn("n_tokens", F.col("exact"))))
    return rollup.totals()
