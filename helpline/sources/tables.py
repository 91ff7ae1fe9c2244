"""Readers for the operational tables.

Production reads JDBC (``spark.read.jdbc`` with a partition column so the scan is
split over executors); tests and bench read Parquet. Column selection happens
right after the read so Catalyst prunes the scan (``ReadSchema``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None,
               spread_by: str | None = None) -> DataFrame:
    """Parquet table, pruned to ``columns``. ``spread_by`` names a key to
    hash-partition a coarse scan by (see ``functions.columns.spread``); a
    table that already scans in many tasks is left as read."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    df = df.select(*columns) if columns else df
    if spread_by:
        from helpline.functions.columns import spread
        df = spread(df, spread_by)
    return df


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str,
              lower: int, upper: int, num_partitions: int, properties: dict | None = None) -> DataFrame:
    """Parallel JDBC scan: ``num_partitions`` range predicates on an integer key."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower,
                           upperBound=upper, numPartitions=num_partitions,
                           properties=properties or {})
