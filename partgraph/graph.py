"""A property graph as two DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The distance of what is not reached, in output too.
UNREACHED = 1.7976931348623157e308


@dataclass(frozen=True)
class Graph:
    """vertices (id, value) and edges (src, dst[, value]).

    Integer ids become long, so that both sides of every join hash alike; string
    ids stay. Null ids and repeated vertex ids are refused by ``validated``, which
    the iterations call. Edges may be parallel or loops. An edge whose source is no
    vertex is never expanded; a message to no vertex fails the run.
    """

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def from_frames(vertices: DataFrame, edges: DataFrame) -> Graph:
        """From frames whose first columns are id, value and src, dst[, value]."""
        v = vertices.select(_id(vertices, 0).alias("id"), F.col(vertices.columns[1]).alias("value"))
        e = [_id(edges, 0).alias("src"), _id(edges, 1).alias("dst")]
        if len(edges.columns) > 2:
            e.append(F.col(edges.columns[2]).alias("value"))
        return Graph(v, edges.select(*e))

    @staticmethod
    def from_rows(spark: SparkSession, vertices: Iterable[tuple], edges: Iterable[tuple], value: str = "long", edge_value: str | None = "long") -> Graph:
        """From rows (id, value) and (src, dst[, value]) in memory; ids are long."""
        v = spark.createDataFrame(list(vertices), f"id long, value {value}")
        e = spark.createDataFrame(list(edges), "src long, dst long" + (f", value {edge_value}" if edge_value else ""))
        return Graph(v, e)

    @staticmethod
    def from_edges(edges: DataFrame, value: Callable[[Column], Column]) -> Graph:
        """Vertices are the distinct end points, with ``value`` of their id."""
        e = Graph.from_frames(edges.select(F.col(edges.columns[0]), F.lit(0)), edges).edges
        ids = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
        return Graph(ids.withColumn("value", value(F.col("id"))), e)

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    def map_vertices(self, value: Callable[[Column, Column], Column]) -> Graph:
        """Values anew from (id, value)."""
        return Graph(self.vertices.select("id", value(F.col("id"), F.col("value")).alias("value")), self.edges)

    def map_edges(self, value: Callable[[Column, Column, Column], Column]) -> Graph:
        """Edge values anew from (src, dst, value); without one it is null."""
        old = F.col("value") if "value" in self.edges.columns else F.lit(None)
        return Graph(self.vertices, self.edges.select("src", "dst", value(F.col("src"), F.col("dst"), old).alias("value")))

    def without_edge_values(self) -> Graph:
        return Graph(self.vertices, self.edges.select("src", "dst"))

    def undirected(self) -> Graph:
        """With the reverse of each edge; repeats are kept."""
        swapped = [F.col("dst").alias("src"), F.col("src").alias("dst"), *(F.col(c) for c in self.edges.columns[2:])]
        return Graph(self.vertices, self.edges.unionByName(self.edges.select(*swapped)))

    def transform(self, operation: Callable[..., Graph], *args, **kwargs) -> Graph:
        """Apply a custom operation on graphs."""
        return operation(self, *args, **kwargs)

    def run_partition_centric(self, program, update, max_iterations: int, **options) -> Graph:
        """The graph with the vertices of a partition-centric iteration and the same edges."""
        from partgraph.plans.iterate import iterate

        return Graph(iterate(self, program, update, max_iterations, **options).vertices, self.edges)

    def validated(self) -> Graph:
        """This graph, or ValueError for null ids or repeated vertex ids."""
        check_vertices(self.vertices)
        check_edges(self.edges)
        return self


def check_vertices(vertices: DataFrame) -> None:
    """ValueError for a null or repeated id."""
    keys = [c for c in ("part", "id") if c in vertices.columns]
    repeated = vertices.groupBy(*keys).count().where(F.col("id").isNull() | (F.col("count") > 1)).limit(1).collect()
    if repeated:
        row = repeated[0]
        raise ValueError("null vertex id" if row["id"] is None else f"repeated vertex id {row['id']!r}")


def check_edges(edges: DataFrame) -> None:
    """ValueError for a null end."""
    if not edges.where(F.col("src").isNull() | F.col("dst").isNull()).isEmpty():
        raise ValueError("null edge end")


def _id(frame: DataFrame, at: int) -> Column:
    name = frame.columns[at]
    integer = isinstance(frame.schema[name].dataType, T.IntegralType)
    return F.col(name).cast("long") if integer else F.col(name)
