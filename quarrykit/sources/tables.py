"""Parquet tables by name, with column pruning left to the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrykit.plans.storage import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
