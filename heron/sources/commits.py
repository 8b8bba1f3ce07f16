"""Commits that count once: the tables of a batch become visible together, by one manifest that can be created only once.

Data goes to a folder of its own first. The manifest is written under a temporary name and renamed to that of (stream,
batch), which fails if it is there: so a batch that is delivered again publishes nothing twice, and of two writers one loses.
A writer that breaks off before the rename has published nothing; one that breaks off behind it has published all. On file
systems whose rename without overwriting is not atomic (plain object stores) two writers need a lock of their own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


class Storage:
    """The few calls on a shared folder that Spark's readers and writers don't make."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def files(self, name: str):
        return self.path(name).getFileSystem(self.conf)

    def exists(self, name: str) -> bool:
        return self.files(name).exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        """What lies in a folder, but for hidden files; nothing if there is none."""
        if not self.exists(folder):
            return []
        found = (x.getPath().getName() for x in self.files(folder).listStatus(self.path(folder)))
        return sorted(n for n in found if not n.startswith((".", "_")))

    def write(self, name: str, text: str) -> None:
        out = self.files(name).create(self.path(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def delete(self, name: str) -> None:
        self.files(name).delete(self.path(name), True)

    def rename(self, name: str, to: str) -> bool:
        """False if there is something under the new name."""
        option = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(option, 1)
        options[0] = option.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(name).toUri(), self.conf)
        try:
            context.rename(self.path(name), self.path(to), options)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or self.exists(to):
                return False
            raise
        return True


class Commits:
    """The batches that were published under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.storage = spark, root.rstrip("/"), Storage(spark)

    def _manifest(self, stream: str, batch: int) -> str:
        return f"{self.root}/commits/{stream}/{batch:020d}.json"

    def has(self, stream: str, batch: int) -> bool:
        return self.storage.exists(self._manifest(stream, batch))

    def commit(self, stream: str, batch: int, tables: dict[str, DataFrame]) -> bool:
        """Whether this call published the batch; if not, it had been published, and nothing is left of this call."""
        if self.has(stream, batch):
            return False
        folder = f"{self.root}/data/{stream}-{batch:020d}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
        draft = f"{self.root}/drafts/{uuid.uuid4().hex}.json"
        self.storage.write(draft, json.dumps({"folder": folder, "tables": {n: df.schema.json() for n, df in tables.items()}}))
        name = self._manifest(stream, batch)
        self.storage.files(name).mkdirs(self.storage.path(name).getParent())
        if self.storage.rename(draft, name):
            return True
        self.storage.delete(draft)
        self.storage.delete(folder)
        return False

    def batches(self, stream: str) -> list[int]:
        return [int(n.partition(".")[0]) for n in self.storage.names(f"{self.root}/commits/{stream}")]

    def read(self, name: str, schema: StructType | None = None) -> DataFrame:
        """A table's rows of all batches and streams. Manifests are a row a batch; `schema` is that of a table without any."""
        if not self.storage.names(f"{self.root}/commits"):
            return self.spark.createDataFrame([], schema or StructType())
        manifests = self.spark.read.schema("folder string, tables map<string, string>").json(f"{self.root}/commits/*/*.json")
        found = [r for r in manifests.collect() if name in r.tables]
        if not found:
            return self.spark.createDataFrame([], schema or StructType())
        own = StructType.fromJson(json.loads(found[0].tables[name]))
        return self.spark.read.schema(own).parquet(*[f"{r.folder}/{name}" for r in found])

    def orphans(self) -> list[str]:
        """Folders of writers that broke off, which nothing reads; a writer at work has one too."""
        known = set()
        if self.storage.names(f"{self.root}/commits"):
            known = {r.folder for r in self.spark.read.schema("folder string").json(f"{self.root}/commits/*/*.json").collect()}
        return [x for x in (f"{self.root}/data/{n}" for n in self.storage.names(f"{self.root}/data")) if x not in known]


def publish_stream(stream: DataFrame, commits: Commits, name: str, tables: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str) -> StreamingQuery:
    """Every micro-batch as the tables that `tables` makes of it, each batch once, also if Spark delivers it again or the
    checkpoint is lost and the source gives the same batches."""
    return stream.writeStream.foreachBatch(lambda df, batch: commits.commit(name, batch, tables(df))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
