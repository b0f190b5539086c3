"""Graphs cut from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partgraph.graph import Graph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src order, dst part, value least quantity) of all of lineitem; parts have negative ids."""
    rows = read(spark, sf_dir, "lineitem")
    pairs = rows.select(F.col("l_orderkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst"), F.col("l_quantity").alias("value"))
    return pairs.groupBy("src", "dst").agg(F.min("value").alias("value"))


def order_part(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.from_edges(order_part_edges(spark, sf_dir), lambda i: i)


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed: customer - order - part - supplier - nation - customer, and region - nation, which nothing leads to.

    The ids of a kind are 6 * key + its number; weights are least quantities, or 1.
    """
    names = ("customer", "orders", "lineitem", "supplier", "nation")
    c, o, li, s, n = (read(spark, sf_dir, name) for name in names)

    def key(name: str, kind: int) -> Column:
        return (F.col(name).cast("long") * 6 + kind).alias("end")

    def edges(rows: DataFrame, src: Column, dst: Column, weight: Column) -> DataFrame:
        return rows.select(src.alias("src"), dst.alias("dst"), weight.cast("double").alias("value"))

    one = F.lit(1.0)
    least = F.col("l_quantity")
    order, part, supplier, nation = key("l_orderkey", 1), key("l_partkey", 2), key("l_suppkey", 3), 4
    every = edges(o, key("o_custkey", 0), key("o_orderkey", 1), one)
    every = every.unionByName(edges(li, order, part, least)).unionByName(edges(li, part, supplier, least))
    every = every.unionByName(edges(s, key("s_suppkey", 3), key("s_nationkey", nation), one))
    every = every.unionByName(edges(c, key("c_nationkey", nation), key("c_custkey", 0), one))
    every = every.unionByName(edges(n, key("n_regionkey", 5), key("n_nationkey", nation), one))
    return Graph.from_edges(every.groupBy("src", "dst").agg(F.min("value").alias("value")), lambda i: i)


def customer_nation(spark: SparkSession, sf_dir: str) -> Graph:
    c = read(spark, sf_dir, "customer")
    return Graph.from_edges(c.select("c_custkey", (-1 - F.col("c_nationkey")).cast("long")), lambda i: i)


def region_tree(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers - nations (negative ids) - regions (ids from -1000 down)."""
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    a = s.select(F.col("s_suppkey").cast("long").alias("a"), (-1 - F.col("s_nationkey")).cast("long").alias("b"))
    b = n.select((-1 - F.col("n_nationkey")).cast("long").alias("a"), (-1000 - F.col("n_regionkey")).cast("long").alias("b"))
    return Graph.from_edges(a.unionByName(b), lambda i: i)


def same_day_orders(spark: SparkSession, sf_dir: str) -> Graph:
    """All orders; edges between a customer's successive orders of one day."""
    from pyspark.sql import Window as W

    o = read(spark, sf_dir, "orders")
    day = W.partitionBy("o_custkey", "o_orderdate").orderBy("o_orderkey")
    pairs = o.withColumn("next", F.lead("o_orderkey").over(day)).where(F.col("next").isNotNull())
    return Graph.from_frames(o.select("o_orderkey", F.col("o_orderkey").alias("value")), pairs.select("o_orderkey", "next"))
