"""Session helpers: package shipping and shared scratch folders."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    Kernels are pickled by reference, so that a worker's caches outlive a task;
    therefore the workers must be able to import the package wherever they run.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="veldra-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "veldra.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(_PACKAGE.rglob("*.py")):
            archive.write(file, os.path.join(_PACKAGE.name, file.relative_to(_PACKAGE)))
    context.addPyFile(str(target))


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share, the one named by ``spark.checkpoint.dir``."""
    root = checkpoint_root(spark)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder, also set as the checkpoint directory of the context.

    A session without one is refused, unless it runs in this process alone
    (a local master), where a folder that is deleted at exit serves.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):  # local-cluster has executors of its own
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="veldra-shared-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame, written to the shared folder and read from there: its lineage is cut and any executor may be lost."""
    path = scratch(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


class Scratch:
    """Stored frames that are needed only until a later one is stored: leaving the context deletes them.

    ``keep`` stores a frame that stays.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def store(self, frame: DataFrame, label: str) -> DataFrame:
        path = scratch(self.spark, label)
        self.paths.append(path)
        frame.write.parquet(path)
        return self.spark.read.parquet(path)

    def keep(self, frame: DataFrame, label: str) -> DataFrame:
        return stored(frame, label)

    def __exit__(self, *_: object) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in self.paths:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
