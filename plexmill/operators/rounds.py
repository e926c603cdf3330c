"""Cutting the lineage between the rounds of an iterative operator."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    """`spark.checkpoint.dir`; where it is unset a folder of this machine is made, on a local master only: executors of a
    cluster could not see it."""
    sc = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="plexmill-rounds-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        df.sparkSession.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the folder that all executors share."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(_folder(df))
    return df.checkpoint()


def dealt(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that is dealt out by key, never broadcast.

    Sizes are estimated by the bytes of compressed files, or of the plan that a checkpoint came from.  A file of 5 MB may
    hold a million names, so a side that grows with the tables would be sent to the driver whole.
    """
    return df.hint("merge")


#: Tables of this process, removed at its end.
_tables: list[tuple] = []


@atexit.register
def _remove_tables() -> None:
    for spark, path in _tables:
        with contextlib.suppress(Exception):  # the session may have ended before
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_folder(df: DataFrame) -> str:
    """A folder of its own in the shared one, removed at the end of the process."""
    path = f"{_folder(df)}/rounds-{uuid.uuid4().hex}"
    _tables.append((df.sparkSession, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in that folder, for rounds that join a frame with what was made of itself.

    A checkpoint keeps the size estimated for its plan, and the estimates of such joins are squared each round, until
    planning takes longer than the work; a table has the size of its files.
    """
    path = new_folder(df)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
