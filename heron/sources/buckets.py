"""A table of vectors by knowledge base and hash bucket, whose upserts rewrite only the buckets that they touch.

    data/version=<v>/<group>=<g>/bucket=<b>/   the rows of a cell, as version v wrote them
    manifest/<v>/                              (group, bucket, version): where each cell of version v lies

Cells that an upsert doesn't touch are carried over in the manifest, so their files stay as they are. A manifest is made
under another name and renamed to its version's, which fails if another writer was faster: that writer's upsert stands, and
the other one has to be done again. Readers take the newest manifest; group and bucket are partition columns, so that filters
on them, and joins with a filtered table of groups, leave out files.

What passes through the driver is a row a cell: groups times buckets, like the partitions of any table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from heron.operators.relational import upsert
from heron.sources.commits import Storage

BUCKETS = 16


class Conflict(RuntimeError):
    """Another writer published the version first."""


class BucketTable:
    def __init__(self, spark: SparkSession, root: str, schema: StructType, group: str = "kb_id", key: str = "chunk_id", buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.group, self.key, self.buckets = spark, root.rstrip("/"), schema, group, key, buckets
        self.storage = Storage(spark)
        self.stored = StructType([*[f for f in schema.fields if f.name != group], StructField("version", LongType()), schema[group], StructField("bucket", IntegerType())])

    def version(self) -> int:
        """The newest, 0 for an empty table."""
        return max((int(n) for n in self.storage.names(f"{self.root}/manifest")), default=0)

    def cells(self, version: int | None = None) -> DataFrame:
        """group, bucket, version."""
        v = self.version() if version is None else version
        schema = StructType([self.schema[self.group], StructField("bucket", IntegerType()), StructField("version", LongType())])
        return self.spark.read.schema(schema).parquet(f"{self.root}/manifest/{v:020d}") if v else self.spark.createDataFrame([], schema)

    def _folders(self, cells: list) -> DataFrame:
        paths = sorted({f"{self.root}/data/version={r.version}/{self.group}={r[self.group]}/bucket={r.bucket}" for r in cells})
        rows = self.spark.read.schema(self.stored).option("basePath", f"{self.root}/data").parquet(*paths) if paths else self.spark.createDataFrame([], self.stored)
        return rows

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version (by default the newest), with `bucket`."""
        return self._folders(self.cells(version).collect()).select(*self.schema.names, "bucket")

    def _placed(self, rows: DataFrame) -> DataFrame:
        own = rows.where(F.col(self.group).isNotNull() & F.col(self.key).isNotNull())
        return own.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def upsert(self, delta: DataFrame, order: list[str] | None = None) -> int:
        """The next version: rows of the delta replace those of their (group, key); of several the last by `order` counts.
        Rows without a group or a key are left out. Returns the version."""
        placed = self._placed(delta)
        return self._rewrite(placed, lambda old: upsert(old, placed, [self.group, "bucket", self.key], order))

    def delete(self, gone: DataFrame) -> int:
        """The next version without the rows of these (group, key)."""
        placed = self._placed(gone.select(self.group, self.key))
        return self._rewrite(placed, lambda old: old.join(placed, [self.group, "bucket", self.key], "left_anti"))

    def _rewrite(self, touching: DataFrame, change) -> int:
        at = self.version()
        cells = self.cells(at)
        touched = {tuple(r) for r in touching.select(self.group, "bucket").distinct().collect()}
        known = cells.collect()
        old = self._folders([r for r in known if (r[self.group], r.bucket) in touched]).select(*self.schema.names, "bucket")
        stamp = uuid.uuid4().int >> 66  # of this attempt, so that two writers of one version don't meet
        folder = f"{self.root}/data/version={stamp}"
        change(old).repartition(self.group, "bucket").write.partitionBy(self.group, "bucket").parquet(folder)
        new = self.spark.read.schema(self.stored).option("basePath", f"{self.root}/data").parquet(folder).select(self.group, "bucket", F.lit(stamp).cast("long").alias("version")).distinct()
        kept = [r for r in known if (r[self.group], r.bucket) not in touched]
        draft = f"{self.root}/drafts/{uuid.uuid4().hex}"
        self.spark.createDataFrame(kept, cells.schema).unionByName(new).coalesce(1).write.parquet(draft)
        name = f"{self.root}/manifest/{at + 1:020d}"
        self.storage.files(name).mkdirs(self.storage.path(name).getParent())
        if not self.storage.rename(draft, name):
            self.storage.delete(draft)
            self.storage.delete(folder)
            raise Conflict(f"version {at + 1} was published by another writer")
        return at + 1
