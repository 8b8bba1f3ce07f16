"""Notes in JSON lines that are appended to, and now and then rewritten as a whole.

    notes/<version>/    JSON lines, as many files as there were appends
    versions/<version>  made when a version is whole; the newest one is read

A rewrite writes the next version beside the old one and makes its mark last, under a name that can be made only once: a
reader sees the old notes or the new ones, and of two rewrites at a time one fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from heron.sources.commits import Storage
from heron.sources.files import append_notes, read_notes


class Notes:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.storage = spark, root.rstrip("/"), Storage(spark)

    def version(self) -> int:
        """0 for notes that were never rewritten."""
        return max((int(n) for n in self.storage.names(f"{self.root}/versions")), default=0)

    def _folder(self, version: int) -> str:
        names = self.storage.names(f"{self.root}/versions/{version:020d}") if version else ["first"]
        return f"{self.root}/notes/{names[0]}"

    def append(self, notes: DataFrame) -> None:
        append_notes(notes, self._folder(self.version()))

    def read(self, schema: str | StructType) -> tuple[DataFrame, DataFrame]:
        """The notes, and the lines that are none."""
        folder = self._folder(self.version())
        if not self.storage.exists(folder):
            full = StructType.fromDDL(schema) if isinstance(schema, str) else schema
            return self.spark.createDataFrame([], full), self.spark.createDataFrame([], "value string")
        return read_notes(self.spark, folder, schema)

    def rewrite(self, notes: DataFrame) -> int:
        """These notes take the place of all others, also where they were read from them. Returns the version."""
        at, name = self.version() + 1, uuid.uuid4().hex
        notes.write.json(f"{self.root}/notes/{name}")
        draft, mark = f"{self.root}/drafts/{name}", f"{self.root}/versions/{at:020d}"
        self.storage.write(f"{draft}/{name}", "")
        self.storage.files(mark).mkdirs(self.storage.path(mark).getParent())
        if not self.storage.rename(draft, mark):
            self.storage.delete(draft)
            self.storage.delete(f"{self.root}/notes/{name}")
            raise RuntimeError(f"version {at} of the notes was written by somebody else")
        return at
