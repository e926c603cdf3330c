"""Intermediate tables in the folder that driver and executors share.

`spark.checkpoint.dir` names that folder.  Where it is unset a temp folder is made on a
local master (tests, a laptop); on a cluster that is an error, as nobody else sees a folder
of the driver's machine.
A table written here survives the loss of any executor and cuts the lineage.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {KEY} to a folder that driver and executors share")
    found = tempfile.mkdtemp(prefix="plexmill-")
    atexit.register(shutil.rmtree, found, ignore_errors=True)
    spark.conf.set(KEY, found)
    return found


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: str = "4m") -> None:
    """Let no batch of rows that passes to Python hold more than a few megabytes, one row at least.

    Left as it is where the session sets it.  Rows of whole texts differ in size by orders of
    magnitude, so a number of rows bounds nothing.
    """
    if not spark._jsparkSession.sessionState().conf().contains(BATCH):
        spark.conf.set(BATCH, most)


def rereadable(docs: DataFrame) -> bool:
    """Whether `docs` is a scan of files with projections and filters only, so that it gives
    the same rows in the same partitions whenever it is read, by whatever executor."""

    def plain(node) -> bool:
        if node.getClass().getSimpleName() not in ("LogicalRelation", "Project", "Filter") or not node.deterministic():
            return False
        below = node.children()
        return all(plain(below.apply(i)) for i in range(below.size()))

    return plain(docs._jdf.queryExecution().optimizedPlan())


#: Folders of this process's runs, removed at its end.
_folders: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _folders:
        with contextlib.suppress(Exception):  # the session may have ended before; what is left is in one folder
            _remove(spark, path)


class Workspace:
    """A folder of one run of an operator.

    Tables no longer needed can be dropped; the rest stays as long as the process, since results read from it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        bound_batches(spark)
        _folders.append((spark, self.path))
        self._n = 0

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write `df` as Parquet and return a DataFrame that reads it."""
        self._n += 1
        to = f"{self.path}/{self._n:03d}-{name}"
        schema = df.schema
        df.write.parquet(to, partitionBy=partition_by)
        out = self.spark.read.schema(schema).parquet(to)
        out._plexmill_path = to
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_plexmill_path", None)
        if path:
            _remove(self.spark, path)
