"""Reading Parquet tables for work that is heavy per row."""

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when a table scan yields far fewer partitions than there are.

    A small table in one row group is read by one task; text work on it would
    leave the other cores idle. Large tables already have more partitions than
    cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores)


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(table.select(*columns) if columns else table)
