"""Stage boundaries, and this package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that driver and executors share. A local one is made only in local mode, where they share it too."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("on a cluster, name a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="stages-"))
    return sc._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame) -> DataFrame:
    """df computed once for the several branches that read it, as a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df, staged, and broadcast where a count finds no more rows than `most`."""
    df = staged(df)
    return broadcast(df) if df.count() <= most else df


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each SparkContext, so that its functions unpickle there."""
    sc = spark.sparkContext
    if getattr(sc, "_sedra_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="sedra-"), "sedra_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, dirs, files in os.walk(top):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._sedra_shipped = True
