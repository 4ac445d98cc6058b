"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir); one of our own only where it is unset and all
    run on this machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="stepspan-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() into the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


_staged: list[tuple[SparkSession, str]] = []


def staged(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, for what is read several times by some of its columns."""
    path = f"{shared_folder(df.sparkSession)}/stepspan-table-{uuid.uuid4().hex}"
    _staged.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _staged:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may have ended before; the folder goes with the cluster's
            return
