"""Connected components and single-source shortest paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partgraph.functions.kernels import ComponentsKernel, ShortestPathsKernel
from partgraph.functions.programs import MIN, NativeProgram
from partgraph.graph import UNREACHED, Graph
from partgraph.operators.star_components import star_components
from partgraph.operators.superstep import NO_VERTEX
from partgraph.plans.iterate import Result, iterate
from partgraph.plans.lineage import cut


@dataclass(frozen=True)
class ConnectedComponents:
    """Every vertex gets the least initial value of its weakly connected component.

    mode: "kernel" solves each partition first (fewest supersteps where partitions
    follow the graph), "native" sends values along edges without Python, "star"
    links components by alternating star steps, in about log(vertices) rounds for
    graphs of any diameter; it has no supersteps, so max_iterations bounds its
    rounds. placement: "hash" or "range", see ``iterate``.
    """

    max_iterations: int
    mode: str = "kernel"
    num_partitions: int | None = None
    placement: str = "hash"

    def run(self, graph: Graph) -> DataFrame:
        return self.result(graph).vertices

    def result(self, graph: Graph) -> Result:
        plain = graph.without_edge_values()
        if self.mode == "star":
            return self._star(plain)
        both = plain.undirected()
        both = Graph(both.vertices, both.edges.distinct())
        program = ComponentsKernel() if self.mode == "kernel" else NativeProgram(lambda value, _: value)
        return iterate(both, program, MIN, self.max_iterations, self.num_partitions, "connected components", self.placement)

    def _star(self, graph: Graph) -> Result:
        graph.validated()
        links = graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
        missing = ends.join(graph.vertices, "id", "left_anti").limit(1).collect()
        if missing:
            raise ValueError(f"{NO_VERTEX}: {missing[0]['id']}")
        stars = star_components(links, cut, max(self.max_iterations, 2))
        named = graph.vertices.join(stars.select(F.col("node").alias("id"), "root"), "id", "left")
        named = named.withColumn("root", F.coalesce("root", "id"))
        least = named.groupBy("root").agg(F.min("value").alias("least"))
        return Result(named.join(least, "root").select("id", F.col("least").alias("value")), 0, True)


@dataclass(frozen=True)
class ShortestPaths:
    """Least sum of edge values from ``source`` along directed edges; UNREACHED where there is no way.

    Initial vertex values are overwritten. A source that is no vertex reaches
    nothing. "native" mode takes negative edge values, "kernel" refuses them.
    placement: "hash" or "range", see ``iterate``.
    """

    source: int
    max_iterations: int
    mode: str = "kernel"
    num_partitions: int | None = None
    placement: str = "hash"

    def initial(self, graph: Graph) -> Graph:
        return graph.map_vertices(lambda i, _: F.when(i == F.lit(self.source), F.lit(0.0)).otherwise(F.lit(UNREACHED)))

    def run(self, graph: Graph) -> DataFrame:
        return self.result(graph).vertices

    def result(self, graph: Graph) -> Result:
        if "value" not in graph.edges.columns:
            raise ValueError("edges need a value")
        start = self.initial(graph.map_edges(lambda _s, _d, value: value.cast("double")))
        # The sentinel is never added to.
        native = NativeProgram(lambda value, weight: F.when(value < UNREACHED, value + weight), "double")
        program = ShortestPathsKernel() if self.mode == "kernel" else native
        return iterate(start, program, MIN, self.max_iterations, self.num_partitions, "shortest paths", self.placement)
