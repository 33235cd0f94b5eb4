"""Cutting lineage where all executors can read the result again."""

from __future__ import annotations

import atexit
import gc
import re
import shutil

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, on one machine only, one below the warehouse, which goes with the application. On a cluster it has to be set.
    """
    if place := spark.conf.get("spark.checkpoint.dir", None):
        return place.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    place = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints/{spark.sparkContext.applicationId}"
    if place.startswith(("/", "file:")) and place not in _OURS:
        _OURS.add(place)
        atexit.register(shutil.rmtree, "/" + place.removeprefix("file:").lstrip("/"), ignore_errors=True)
    return place


_OURS: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many leading underscores as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def added_prefix(df: DataFrame) -> str:
    """Two underscores, or as many as no column of ``df`` begins with."""
    out = "__"
    while any(c.startswith(out) for c in df.columns):
        out += "_"
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is, that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files that only lineage before a cut has needed; it acts on what the driver's collectors find."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
