"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_staged: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir); one of our own only where it is unset and
    all run on this machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="stepspan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/stepspan-{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written as a table in the shared folder and read back: cuts the lineage, survives lost executors, and forgets
    how rows were dealt out, so that later joins on a hot key get exchanges that AQE can split."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stepspan_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(hadoop).delete(target, True)


def unstage(*frames: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_stepspan_path", None):
            drop_path(df.sparkSession, path)
            _staged[:] = [x for x in _staged if x[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in _staged:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before; the folder goes with the cluster's
            return


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch than Spark's default, since a row here holds a whole text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@contextlib.contextmanager
def batches_within(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of about so many bytes meanwhile, where rows differ much in size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def maybe_broadcast(small: DataFrame, rows: int, most: int) -> DataFrame:
    """A broadcast hint behind a check of the counted rows; beyond it the join stays a shuffle join."""
    return F.broadcast(small) if rows <= most else small


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
