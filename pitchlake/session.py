"""Session helpers: shared checkpoint folder, materialised intermediate tables, table loading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without it (tests) gets a temporary folder, which
    goes when the process ends; elsewhere each executor would write to its own disk, so its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="pitchlake-")
    atexit.register(shutil.rmtree, folder, True)
    sc.setCheckpointDir("file://" + folder)
    return sc._jsc.sc().getCheckpointDir().get()


def _app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/pitchlake/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back, for results used several times.

    The table lives until ``release`` or ``cleanup``.
    """
    spark = df.sparkSession
    path = f"{_app_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table of a ``materialize`` result that nothing reads any more; other frames are left alone."""
    path = getattr(df, "_written", None)
    if path is not None:
        _delete(df.sparkSession, path)


def cleanup(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application: after its results have been written."""
    _delete(spark, _app_dir(spark))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a step of a loop: a table in the shared folder, which survives the loss of executors.

    A written table also forgets the constraints that the optimiser inferred; over many steps with self-joins these grow
    faster than the data.
    """
    return materialize(df, "step")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
