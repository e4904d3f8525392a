"""Tables as input of per-row work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.session import bound_batches


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out evenly where its files give fewer splits than there are cores. A large
    table has more splits than that, and then nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder, whatever its number of splits."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of a folder for per-row work, these columns of it alone."""
    rows = table(spark, sf_dir, name)
    return spread(rows.select(*columns) if columns else rows)
