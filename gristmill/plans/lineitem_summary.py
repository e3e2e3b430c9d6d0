"""Scan, filter, partial and final aggregation over ``lineitem``: the slice that proves the harness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.sources import read_table

SQL = """
SELECT l_returnflag, l_linestatus,
       round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       round(avg(l_discount), 6) AS avg_discount,
       count(*) AS n_rows
FROM lineitem
WHERE l_shipdate <= TIMESTAMP '2000-12-31 00:00:00'
GROUP BY l_returnflag, l_linestatus
"""


def lineitem_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, revenue and discount by return flag and line status. The filter and six columns reach the scan."""
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        read_table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") <= F.expr("timestamp_ntz'2000-12-31 00:00:00'"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum(revenue), 2).alias("revenue"),
            F.round(F.avg("l_discount"), 6).alias("avg_discount"),
            F.count("*").alias("n_rows"),
        )
    )
