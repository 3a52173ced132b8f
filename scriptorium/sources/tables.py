"""Reading input tables.

A scan is left as Spark plans it.  Only a caller who knows that an input comes
in fewer splits than the cluster has cores (a single unsplittable row group,
say) asks for more partitions, by number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Session setting with the number of partitions a table scan is dealt into; unset: as scanned.
SCAN_PARTITIONS = "spark.scriptorium.scanPartitions"


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", partitions: int | None = None) -> DataFrame:
    """The table at ``path``, dealt round-robin into ``partitions`` only if asked for."""
    df = spark.read.format(fmt).load(path)
    return df.repartition(partitions) if partitions else df
