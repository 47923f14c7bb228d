"""The folder that all executors share: where lineage is cut and intermediate tables are kept."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where none is set, as in tests."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="sitefold-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


_made: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet, for what only this application reads: what still lies there when
    the driver ends is removed."""
    if not _made:
        atexit.register(_sweep, spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def _sweep(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        for path in sorted(_made):
            remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder once and read from there: a lost executor costs no earlier work."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing needs any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jvm.org.apache.spark.deploy.SparkHadoopUtil.get().conf()).delete(at, True)
    _made.discard(path)
