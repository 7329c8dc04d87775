"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import gc
from collections.abc import Iterable

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .. import session
from ..session import shared_dir


#: Rows of an Arrow batch: whole texts travel, so the default of 10,000 rows could be any size.
BATCH_ROWS = 1000


def tune(spark: SparkSession) -> SparkSession:
    """Keeps Arrow batches of texts small, unless the session has a size of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def keep(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    A lost executor then costs its running tasks only, never what was written.
    """
    tune(df.sparkSession)
    return session.keep(df)


def free(*tables: DataFrame | None) -> None:
    """Deletes tables that ``keep`` has given and that nothing will read again; others are left alone."""
    for df in tables:
        path = getattr(df, "kept_path", None)
        if path:
            release(df.sparkSession, [path.rpartition("/")[2]])


def spent(*sent: Broadcast) -> None:
    """Takes broadcast values off every disk and out of memory, once the tables made with them are written."""
    for value in sent:
        value.destroy()


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done: it does so when the driver collects garbage, which a driver with little to do hardly ever does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(spark: SparkSession) -> set[str]:
    """The tables that ``keep`` has written in this application and that are still there."""
    folder, fs = _folder(spark)
    return {f.getPath().getName() for f in fs.listStatus(folder)} if fs.exists(folder) else set()


def release(spark: SparkSession, names: Iterable[str] | None = None) -> None:
    """Deletes those tables that ``keep`` wrote, or all of this application."""
    folder, fs = _folder(spark)
    if names is None:
        fs.delete(folder, True)
    else:
        for name in names:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, name), True)


def _folder(spark: SparkSession):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, with as many underscores behind as no column of ``taken`` has (in any case)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def slices(spark: SparkSession) -> int:
    """Into how many slices a hash space is cut: the session's shuffle partitions, which follow the input."""
    return max(1, int(tune(spark).conf.get("spark.sql.shuffle.partitions")))
