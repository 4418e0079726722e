"""Read the catalogue tables of one data folder through Spark's readers only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; the path may be of any file system that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temp views of the tables for SQL text queries."""
    for n in names or NAMES:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
