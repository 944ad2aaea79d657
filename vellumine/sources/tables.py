"""Readers of the parquet tables; timestamps without zone are read as session-zone (UTC) timestamps where asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; only the columns a plan uses reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_timestamps(df: DataFrame, *columns: str) -> DataFrame:
    """Cast TIMESTAMP_NTZ columns to TIMESTAMP, which event-time operators need."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})
