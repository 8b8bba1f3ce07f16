"""What a session needs besides its own settings."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import heron


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that their Python workers can import it wherever the
    driver was started."""
    context = spark.sparkContext
    if getattr(context, "_heron_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(heron.__file__))
    path = os.path.join(tempfile.mkdtemp(), "heron.zip")  # read by the driver alone, which serves it to the executors
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("heron", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._heron_shipped = True
