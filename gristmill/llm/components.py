"""Connected components of a table of links, by large-star and small-star rounds: min-aggregations and joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import forget, written


def is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each v of ``edges`` (v, u) has one u, which is no v itself."""
    ends = edges.select(F.col("v").alias("x"), F.lit(1).alias("v"), F.lit(0).alias("u")).unionByName(edges.select(F.col("u").alias("x"), F.lit(0).alias("v"), F.lit(1).alias("u")))
    both = ends.groupBy("x").agg(F.sum("v").alias("v"), F.max("u").alias("u")).where("v > 1 OR v > 0 AND u > 0")
    return not both.limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b), longs, in either direction and repeated as they may be, to (id, root): every id that has a
    link, with the least id reachable. An empty table gives an empty result."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    while not is_forest_of_stars(edges):
        both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.where("u > v").join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
        before, edges = edges, written(small.where("v <> u").distinct(), "edges")
        forget(before)
    return edges.select(F.col("v").alias("id"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct())
