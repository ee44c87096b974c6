"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    A local session without the setting (tests on one machine) gets a temporary folder of its own. A cluster without it is
    an error, as its machines would each write to their own disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        path = "file://" + (folder := tempfile.mkdtemp(prefix="glossalith-"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_MADE: list[Workspace] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the workspaces that are made inside, for callers that write the result before they leave."""
    before = len(_MADE)
    try:
        yield
    finally:
        while len(_MADE) > before:
            _MADE.pop().delete()


class Workspace:
    """Tables written to the shared folder.

    A written table cuts lineage and survives lost executors: a retried task rereads files, not shuffle output. The
    tables stay as long as a lazy result may read them, and go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _MADE.append(self)
        path, files = self._located(self.root)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def save(self, df: DataFrame, name: str, **options: object) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.options(**{"compression": "zstd"} | options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        for name in names:
            self._remove(f"{self.root}/{name}")

    def delete(self) -> None:
        self._remove(self.root)

    def _remove(self, folder: str) -> None:
        path, files = self._located(folder)
        files.delete(path, True)

    def _located(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())
