"""Readers for the columnar tables that every query starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``; lazily, so filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
