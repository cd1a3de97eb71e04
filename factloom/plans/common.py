"""Access to the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Tables whose rows cost enough work to be spread when they come in fewer splits than there are cores.
SPREAD = frozenset({"documents", "lineitem", "events", "pages", "conversations"})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in SPREAD else df


def spread(df: DataFrame) -> DataFrame:
    """Distribute a scan that has fewer splits than the session has cores.

    A table of one row group would keep one core busy. Large tables have more splits than cores and are left alone, so no
    shuffle is added at scale. Filters and column pruning pass through to the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
