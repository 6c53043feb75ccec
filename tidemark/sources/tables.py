"""Reading the driver's tables with only the columns a query names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """:func:`table` for steps that cost far more than reading: a scan with fewer splits than
    the cluster has cores (few files or row groups) is spread over them by its first column."""
    df = table(spark, folder, name, *columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, columns[0]) if df.rdd.getNumPartitions() < cores else df
