"""One place that turns a table's name into a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, a file or a folder, on any store Spark reads.

    Naive timestamps stay ``timestamp_ntz``: both sides of an oracle comparison are naive then.
    """
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
