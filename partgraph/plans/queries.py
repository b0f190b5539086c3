"""Queries over the driver's tables, one or more for each operator, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partgraph.functions.programs import MAX, MIN, Context, NativeProgram, PartitionProgram, VertexUpdate
from partgraph.graph import UNREACHED, Graph
from partgraph.operators import superstep
from partgraph.operators.algorithms import ConnectedComponents, ShortestPaths
from partgraph.plans import graphs
from partgraph.plans.iterate import iterate
from partgraph.plans.lineage import shared_folder
from partgraph.sources import examples
from partgraph.sources.edge_list import read_edges, write_vertices

ROUNDS = 1000
Query = Callable[[SparkSession, str], DataFrame]

_EDGES = "select l_orderkey as a, -1 - l_partkey as b, min(l_quantity) as w from lineitem group by 1, 2"
_TRADE = """select a, b, min(w) as w from (
  select o_custkey * 6 as a, o_orderkey * 6 + 1 as b, 1.0::double as w from orders
  union all select l_orderkey * 6 + 1, l_partkey * 6 + 2, l_quantity from lineitem
  union all select l_partkey * 6 + 2, l_suppkey * 6 + 3, l_quantity from lineitem
  union all select s_suppkey::bigint * 6 + 3, s_nationkey::bigint * 6 + 4, 1.0 from supplier
  union all select c_nationkey::bigint * 6 + 4, c_custkey::bigint * 6, 1.0 from customer
  union all select n_regionkey::bigint * 6 + 5, n_nationkey::bigint * 6 + 4, 1.0 from nation) group by 1, 2"""


def _labels(result: DataFrame, value: str = "label") -> DataFrame:
    return result.select("id", F.col("value").alias(value))


# --- graph building -------------------------------------------------------------


def graph_from_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.order_part(spark, sf_dir).vertices


def undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.order_part(spark, sf_dir).without_edge_values().undirected().edges


def map_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.order_part(spark, sf_dir).map_edges(lambda s, d, v: v * 2 + F.pmod(s, F.lit(7))).edges


def map_vertices_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The start of shortest paths: 0 for the source, which the accessor names, UNREACHED for the rest."""
    g = graphs.trade(spark, sf_dir)
    paths = ShortestPaths(_customer(spark, sf_dir), ROUNDS)
    return paths.initial(g).vertices.withColumn("is_source", F.col("id") == paths.source)


def custom_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph operation of the user's, applied like the library's: edges turned round, weights scaled."""

    def turned(g: Graph, factor: int) -> Graph:
        back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("value") * factor).alias("value"))
        return Graph(g.vertices, back)

    return graphs.trade(spark, sf_dir).transform(turned, 3).edges


def edge_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade graph's edges written as text and read again as an edge list."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    graphs.trade(spark, sf_dir).edges.write.options(sep=" ").csv(path)
    return read_edges(spark, path, weighted=True)


def vertex_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of suppliers, nations and regions by the text sink."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    write_vertices(ConnectedComponents(ROUNDS, "star").run(graphs.region_tree(spark, sf_dir)), path)
    return spark.read.schema("id long, label long").csv(path, sep=" ")


def rows_of_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph from rows in memory: components of the ten-vertex example."""
    return _labels(ConnectedComponents(10, "native").run(examples.ten_vertices(spark)))


# --- parts of a superstep ---------------------------------------------------------


def rich_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graphs.order_part(spark, sf_dir)
    return superstep.expand(g.vertices, g.edges)


def rich_edges_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that the second superstep expands: those of the vertices that the first one changed."""
    g = graphs.order_part(spark, sf_dir)
    both = Graph(g.vertices, g.undirected().edges)
    active = superstep.combine(_first_messages(g), g.vertices, MIN)
    return superstep.expand(active, both.edges)


def _first_messages(g: Graph) -> DataFrame:
    both = g.without_edge_values().undirected()
    return superstep.messages(superstep.expand(both.vertices, both.edges), NativeProgram(lambda v, _: v), 1)


def vertex_update_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graphs.order_part(spark, sf_dir)
    return superstep.combine(_first_messages(g), g.vertices, MIN)


def solution_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graphs.order_part(spark, sf_dir)
    return superstep.apply_updates(g.vertices, superstep.combine(_first_messages(g), g.vertices, MIN))


class _Counted(VertexUpdate):
    """The sum of the messages, set where there are two or more: a rule that no aggregate of the library has."""

    def update(self, vertex_id: Any, value: Any, messages: Iterator[Any]) -> None:
        n = total = 0
        for m in messages:
            n, total = n + 1, total + m
        if n > 1:
            self.set_new_value(total)


def vertex_update_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graphs.order_part(spark, sf_dir)
    return superstep.update(_first_messages(g), g.vertices, _Counted(), 1)


class _Stepping(PartitionProgram):
    """Tells every target the superstep's number, and 1000 more where ``init`` ran."""

    message_type = "long"
    base = 0

    def init(self, context: Context) -> None:
        self.base = 1000

    def pre_superstep(self, context: Context) -> None:
        self.number = context.superstep

    def process(self, batches: Iterator[pd.DataFrame], context: Context) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["dst_id"], "msg": self.base + self.number})


class _Take(VertexUpdate):
    def update(self, vertex_id: Any, value: Any, messages: Iterator[Any]) -> None:
        self.set_new_value(next(messages))


def superstep_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the hooks and the superstep's number leave behind after one superstep and after three."""
    g = graphs.region_tree(spark, sf_dir).without_edge_values().undirected()
    after = [iterate(g, _Stepping(), _Take(), n).vertices.withColumnRenamed("value", f"after_{n}") for n in (1, 3)]
    return after[0].join(after[1], "id")


def missing_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each region that is taken out of the graph's vertices, whether a run names it as a missing target."""
    g = graphs.region_tree(spark, sf_dir)
    found = []
    for region in (-1000, -1003):
        less = Graph(g.vertices.where(F.col("id") != region), g.edges)
        try:
            iterate(less, NativeProgram(lambda v, _: v), MIN, 1)
            error = ""
        except Exception as e:
            error = str(e)
        found.append((region, f"{superstep.NO_VERTEX}: {region}" in error))
    return spark.createDataFrame(found, "region long, named boolean")


# --- components --------------------------------------------------------------------


def _components(graph: Callable[[SparkSession, str], Graph], mode: str) -> Query:
    return lambda spark, sf_dir: _labels(ConnectedComponents(ROUNDS, mode).run(graph(spark, sf_dir)))


def _other_values(spark: SparkSession, sf_dir: str) -> Graph:
    return graphs.same_day_orders(spark, sf_dir).map_vertices(lambda i, _: F.pmod(i * 7919, F.lit(10007)))


def _odd_even(placement: str) -> Query:
    """5,000 vertices and 10,000 edges, two components."""
    return lambda spark, _: _labels(ConnectedComponents(5000, "kernel", 4, placement).run(examples.odd_even(spark)))


# --- shortest paths -------------------------------------------------------------------


def _customer(spark: SparkSession, sf_dir: str) -> int:
    """The first customer's id in the trade graph."""
    return graphs.read(spark, sf_dir, "customer").agg(F.min("c_custkey")).first()[0] * 6


def _paths(mode: str, directed: bool) -> Query:
    """Directed: from the first customer through the trade graph. Undirected: from the first order."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        if directed:
            return _labels(ShortestPaths(_customer(spark, sf_dir), ROUNDS, mode).run(graphs.trade(spark, sf_dir)), "distance")
        g = graphs.order_part(spark, sf_dir)
        source = g.edges.agg(F.min("src")).first()[0]
        return _labels(ShortestPaths(source, ROUNDS, mode).run(g.undirected()), "distance")

    return query


# --- user programs --------------------------------------------------------------------


class _Spread(PartitionProgram):
    """Sends along each edge the largest value of its source seen in the batch."""

    message_type = "long"

    def process(self, batches: Iterator[pd.DataFrame], context: Context) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best = batch.groupby("dst_id", as_index=False)["src_value"].max()
            yield best.rename(columns={"dst_id": "id", "src_value": "msg"})


class _Larger(VertexUpdate):
    def update(self, vertex_id: Any, value: Any, messages: Iterator[Any]) -> None:
        best = max(messages)
        if best > value:
            self.set_new_value(best)


def user_program_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graphs.customer_nation(spark, sf_dir).without_edge_values().undirected()
    return _labels(g.run_partition_centric(_Spread(), _Larger(), ROUNDS).vertices)


def user_program_max_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graphs.order_part(spark, sf_dir).without_edge_values().undirected()
    return _labels(iterate(g, NativeProgram(lambda v, _: v), MAX, ROUNDS).vertices)


QUERIES: dict[str, Query] = {
    "graph_from_edges": graph_from_edges,
    "undirected_edges": undirected_edges,
    "map_edges": map_edges,
    "map_vertices_init": map_vertices_init,
    "rich_edges": rich_edges,
    "rich_edges_active": rich_edges_active,
    "vertex_update_min": vertex_update_min,
    "vertex_update_udf": vertex_update_udf,
    "solution_upsert": solution_upsert,
    "custom_operation": custom_operation,
    "edge_list_file": edge_list_file,
    "vertex_file": vertex_file,
    "rows_of_example": rows_of_example,
    "superstep_hooks": superstep_hooks,
    "missing_target": missing_target,
    "odd_even_range": _odd_even("range"),
    "cc_order_part": _components(graphs.order_part, "native"),
    "kernel_cc_order_part": _components(graphs.order_part, "kernel"),
    "star_cc_order_part": _components(graphs.order_part, "star"),
    "cc_customer_nation": _components(graphs.customer_nation, "native"),
    "kernel_cc_customer_nation": _components(graphs.customer_nation, "kernel"),
    "cc_region_tree": _components(graphs.region_tree, "native"),
    "kernel_cc_region_tree": _components(graphs.region_tree, "kernel"),
    "cc_with_isolated": _components(graphs.same_day_orders, "native"),
    "kernel_cc_with_isolated": _components(graphs.same_day_orders, "kernel"),
    "cc_value_labels": _components(_other_values, "native"),
    "kernel_cc_value_labels": _components(_other_values, "kernel"),
    "star_cc_value_labels": _components(_other_values, "star"),
    "sssp_order_part": _paths("native", False),
    "kernel_sssp_order_part": _paths("kernel", False),
    "sssp_directed": _paths("native", True),
    "kernel_sssp_directed": _paths("kernel", True),
    "user_program_max": user_program_max,
    "user_program_max_native": user_program_max_native,
}

def _cc_sql(edges: str, vertices: str = "select distinct a as id, a as value from u", best: str = "min", sign: str = "<") -> str:
    return f"""
with recursive e as ({edges}),
u as (select a, b from e union all select b, a from e),
v as ({vertices}),
w(id, label) using key (id) as (
  select id, value from v
  union
  select u.b, {best}(w.label) from w join u on u.a = w.id join recurring.w r on r.id = u.b
  group by u.b, r.label having {best}(w.label) {sign} r.label)
select id, label from w"""


def _sssp_sql(directed: bool) -> str:
    edges, source = (_TRADE, "(select min(c_custkey) * 6 from customer)") if directed else (_EDGES, "(select min(a) from e)")
    both = "select a, b, w from e" + ("" if directed else " union all select b, a, w from e")
    return f"""
with recursive e as ({edges}),
u as ({both}),
v as (select a as id from e union select b from e),
d(id, distance) using key (id) as (
  select id, case when id = {source} then 0.0::double else {UNREACHED!r}::double end from v
  union
  select u.b, min(d.distance + u.w) from d join u on u.a = d.id join recurring.d r on r.id = u.b
  where d.distance < {UNREACHED!r}::double
  group by u.b, r.distance having min(d.distance + u.w) < r.distance)
select id, distance from d"""


_VERTICES = "select a as id from e union select b from e"
_UNDIRECTED = "select a, b from e union all select b, a from e"
_CC = _cc_sql(_EDGES)
_CUSTOMER = _cc_sql("select distinct c_custkey::bigint as a, (-1 - c_nationkey)::bigint as b from customer")
_REGION = _cc_sql(
    "select s_suppkey::bigint as a, (-1 - s_nationkey)::bigint as b from supplier union all "
    "select (-1 - n_nationkey)::bigint, (-1000 - n_regionkey)::bigint from nation"
)
_SAME_DAY = (
    "select x.o_orderkey as a, y.o_orderkey as b from orders x join orders y on x.o_custkey = y.o_custkey "
    "and x.o_orderdate = y.o_orderdate and x.o_orderkey < y.o_orderkey"
)
_ISOLATED = _cc_sql(_SAME_DAY, "select o_orderkey as id, o_orderkey as value from orders")
_VALUES = _cc_sql(_SAME_DAY, "select o_orderkey as id, o_orderkey * 7919 % 10007 as value from orders")
_CUSTOMER_MAX = _CUSTOMER.replace("min(w.label)", "max(w.label)").replace("< r.label", "> r.label")
_MAX = _cc_sql(_EDGES, best="max", sign=">")
_REGION_VERTICES = (
    "select s_suppkey::bigint as id from supplier union select (-1 - n_nationkey)::bigint from nation "
    "union select (-1000 - n_regionkey)::bigint from nation union select (-1 - s_nationkey)::bigint from supplier"
)
_UPDATE = (
    f"with e as ({_EDGES}), u as ({_UNDIRECTED}), "
    "m as (select b as id, min(a) as value from u group by b having min(a) < b)"
)

ORACLE_SQL: dict[str, str] = {
    "graph_from_edges": f"with e as ({_EDGES}) select id, id as value from ({_VERTICES})",
    "undirected_edges": f"with e as ({_EDGES}) select a as src, b as dst from ({_UNDIRECTED})",
    "map_edges": f"select a as src, b as dst, w * 2 + a % 7 as value from ({_EDGES})",
    "map_vertices_init": f"with e as ({_TRADE}), c as (select min(c_custkey) * 6 as k from customer) select id, "
    f"case when id = k then 0.0::double else {UNREACHED!r}::double end as value, id = k as is_source from ({_VERTICES}), c",
    "custom_operation": f"select b as src, a as dst, w * 3 as value from ({_TRADE})",
    "edge_list_file": f"select a as src, b as dst, w as value from ({_TRADE})",
    "vertex_file": _REGION,
    "rows_of_example": "select * from (values (1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5), (7, 5), (8, 8), (9, 9), (10, 10)) t(id, label)",
    "superstep_hooks": f"select id, 1001 as after_1, 3 as after_3 from ({_REGION_VERTICES})",
    "missing_target": "select * from (values (-1000, true), (-1003, true)) t(region, named)",
    "odd_even_range": "select range as id, 2 - range % 2 as label from range(1, 5001)",
    "rich_edges": f"select a as src_id, a as src_value, w as edge_value, b as dst_id from ({_EDGES})",
    "rich_edges_active": f"with e as ({_EDGES}), u as (select a, b, w from e union all select b, a, w from e), "
    "m as (select b as id, min(a) as value from u group by b having min(a) < b) "
    "select m.id as src_id, m.value as src_value, u.w as edge_value, u.b as dst_id from m join u on u.a = m.id",
    "vertex_update_min": f"{_UPDATE} select id, value from m",
    "vertex_update_udf": f"with e as ({_EDGES}), u as ({_UNDIRECTED}) select b as id, sum(a)::bigint as value from u group by b having count(*) > 1",
    "solution_upsert": f"{_UPDATE}, v as ({_VERTICES}) select v.id, coalesce(m.value, v.id) as value from v left join m using (id)",
    "cc_order_part": _CC,
    "kernel_cc_order_part": _CC,
    "star_cc_order_part": _CC,
    "cc_customer_nation": _CUSTOMER,
    "kernel_cc_customer_nation": _CUSTOMER,
    "cc_region_tree": _REGION,
    "kernel_cc_region_tree": _REGION,
    "cc_with_isolated": _ISOLATED,
    "kernel_cc_with_isolated": _ISOLATED,
    "cc_value_labels": _VALUES,
    "kernel_cc_value_labels": _VALUES,
    "star_cc_value_labels": _VALUES,
    "sssp_order_part": _sssp_sql(False),
    "kernel_sssp_order_part": _sssp_sql(False),
    "sssp_directed": _sssp_sql(True),
    "kernel_sssp_directed": _sssp_sql(True),
    "user_program_max": _CUSTOMER_MAX,
    "user_program_max_native": _MAX,
}
