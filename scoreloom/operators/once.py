"""Evaluating a table once where several passes read it, and measuring a small table before it is broadcast."""

from __future__ import annotations

import atexit
import re
import shutil

from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of group statistics up to which they are broadcast.
BROADCAST_ROWS = 10_000
_OURS: set[str] = set()


def once(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that ``spark.checkpoint.dir`` names, so that lost executors cost no second evaluation.

    Where that is unset, on one machine only, the folder is one below the warehouse that goes with the application; on a cluster
    it has to be set. Spark removes a checkpoint that nothing refers to if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    _set_place(df.sparkSession)
    return df.checkpoint()


def once_packed(df: DataFrame) -> tuple[RDD, int]:
    """The values of a binary column as an RDD of bytes, checkpointed likewise, and how many bytes they are. Python tasks get them as they are, without a row around them."""
    _set_place(df.sparkSession)
    packed = df.rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)  # else Spark evaluates it anew to write it
    packed.checkpoint()
    held = packed.map(len).sum()
    packed.unpersist()
    return packed, held


def _set_place(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            place = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_once/{spark.sparkContext.applicationId}"
            if place.startswith(("/", "file:")) and place not in _OURS:
                _OURS.add(place)
                atexit.register(shutil.rmtree, "/" + place.removeprefix("file:").lstrip("/"), ignore_errors=True)
        spark.sparkContext.setCheckpointDir(place)


def if_small(stats: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``stats``, marked for a broadcast and evaluated already if it has ``most`` rows or fewer; else as it is, for a join by shuffle."""
    rows = stats.limit(most + 1).collect()
    if len(rows) > most:
        return stats
    return F.broadcast(stats.sparkSession.createDataFrame(rows, stats.schema))
