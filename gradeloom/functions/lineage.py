"""Where iterative operators cut their lineage."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame

#: Spark removes the shuffle files of a statement when it ends; where it doesn't know the setting, they go when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows can be long lists, so row groups are small and their size is looked at often.
_OPTIONS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "4", "compression": "zstd"}
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def cut(df: DataFrame) -> DataFrame:
    """Write a result to the folder that ``spark.checkpoint.dir`` names and go on from there, so lost executors cost no recomputation.

    It is written as Parquet, a fraction of the serialized rows of a checkpoint, and the shuffles that made it are given up at once. ``forget``
    deletes it, at the latest the end of the session does. Only a local session without that setting (a test) gets a temporary folder; on a
    cluster it is an error.
    """
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    path = f"{sc.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**_OPTIONS).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def forget(*frames: DataFrame | None) -> None:
    """Delete what ``cut`` wrote for frames that nothing will read again."""
    for df in frames:
        if df is not None and (path := _folders.pop(df, None)):
            files, at = _files(df.sparkSession, path)
            files.delete(at, True)


def _files(spark, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at
