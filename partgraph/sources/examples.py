"""Small graphs to try things on, and a quiet session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partgraph.graph import UNREACHED, Graph

# Ten vertices in five components.
TEN_EDGES = [(1, 2, 1), (2, 3, 1), (3, 1, 1), (3, 4, 1), (5, 6, 1), (7, 6, 1)]


def ten_vertices(spark: SparkSession) -> Graph:
    return Graph.from_rows(spark, [(i, i) for i in range(1, 11)], TEN_EDGES)


def weighted_edges(spark: SparkSession) -> DataFrame:
    """A small directed graph with weights: the shortest way from 1 to 2 goes through 3."""
    rows = [(1, 2, 4.0), (1, 3, 1.0), (3, 2, 2.0), (2, 4, 5.0), (5, 1, 1.0)]
    return spark.createDataFrame(rows, "src long, dst long, value double")


def weighted(spark: SparkSession) -> Graph:
    return Graph.from_edges(weighted_edges(spark), lambda i: F.lit(UNREACHED))


def odd_even(spark: SparkSession, vertices: int = 5000, edges: int = 10_000) -> Graph:
    """Vertices 1..n of their own id; chains of the odd and of the even ones, and edges of equal parity up to ``edges``."""
    v = spark.range(1, vertices + 1).select("id", F.col("id").alias("value"))
    chain = spark.range(3, vertices + 1).select((F.col("id") - 2).alias("src"), F.col("id").alias("dst"))
    more = spark.range(max(0, edges - (vertices - 2))).withColumn("src", F.pmod(F.xxhash64("id"), F.lit(vertices)) + 1)
    other = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(vertices)) + 1
    same = F.when((other - F.col("src")) % 2 == 0, other).otherwise(F.when(other > 1, other - 1).otherwise(other + 1))
    return Graph(v, chain.unionByName(more.select("src", same.alias("dst"))))


def quiet(spark: SparkSession) -> None:
    """Only errors are logged from here on."""
    spark.sparkContext.setLogLevel("ERROR")
