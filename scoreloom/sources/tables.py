"""Reading and writing tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LEADS = "monthly_income double, employment_tenure double, age int, employment_type string, acquisition_channel string, marital_status string, gender string, converted int, income_bin string"
PORTFOLIO = "cliente_id long, banda int, ingreso_recurrente double, edad int, antiguedad_laboral double, num_productos int, score_comportamiento int, ratio_deuda_ingreso double, meses_ultimo_atraso int, `default` int, prob_default double"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A headed CSV file under a declared schema; columns that the file lacks are null (by name)."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: tuple[str, ...]) -> None:
    """Writes a partitioned table, or replaces those of its partitions that ``df`` has rows of; others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_bucketed(df: DataFrame, name: str, keys: tuple[str, ...], buckets: int, path: str | None = None) -> None:
    """Saves a table dealt out and sorted by ``keys`` into ``buckets``; tables of the same buckets and keys join without an exchange.

    Rows are dealt to as many tasks as buckets first, so that a bucket is one file.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def scratch_folder(spark: SparkSession) -> str:
    """A new name below the folder that ``spark.checkpoint.dir`` names, or below the warehouse on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
