"""The partition-centric iteration: a semi-naive fixpoint driven by eager supersteps."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partgraph.functions.programs import Combine, NativeProgram, PartitionProgram, VertexUpdate
from partgraph.graph import Graph, check_edges, check_vertices
from partgraph.operators import superstep as step
from partgraph.plans.lineage import cut, measured_cut, settings
from partgraph.plans.placement import Hashed, Ranged

#: Supersteps whose updates are laid over the state before it is written anew.
OVERLAY = 4
#: Supersteps that run as one job where program and rule allow: FIRST_CHAIN, then twice as many each time, up to CHAIN.
FIRST_CHAIN, CHAIN = 2, 8
#: Out-edges beyond which a vertex is a hub, and how many hubs there may be: with more edges the bar is raised.
HUB_DEGREE, MOST_HUBS = 100_000, 100_000


@dataclass(frozen=True)
class Result:
    """vertices (id, value), the supersteps run, and whether nothing was left to do."""

    vertices: DataFrame
    supersteps: int
    converged: bool


def split_hubs(edges: DataFrame, degree: int) -> tuple[DataFrame, DataFrame | None]:
    """(edges, hubs): the sources of more than ``degree`` edges, or None.

    At most edges / degree vertices can have so many, so the bar is raised until
    that is MOST_HUBS: the table of hubs is of bounded size by arithmetic.
    """
    total = edges.count()
    bar = max(degree, math.ceil(total / MOST_HUBS))
    if total <= bar:
        return edges, None
    hubs = cut(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bar).select("src"))
    return edges, None if hubs.isEmpty() else hubs


def iterate(
    graph: Graph,
    program: PartitionProgram | NativeProgram,
    rule: Combine | VertexUpdate,
    max_iterations: int,
    num_partitions: int | None = None,
    name: str = "partition-centric iteration",
    placement: str = "hash",
    hub_degree: int = HUB_DEGREE,
) -> Result:
    """Run supersteps until no vertex changes or ``max_iterations`` are done.

    In a superstep the out-edges of the active vertices are expanded, the program
    sends messages from each partition, and the rule updates their targets, which
    are the next active ones; at first all vertices are. Edges, state and updates
    are partitioned and sorted by vertex once, so a superstep shuffles its messages
    only and sorts no edges or vertices again. That needs adaptive execution off and
    as many shuffle partitions as there are partitions, and no broadcasts but the
    hubs'; these hold within the loop and are put back after it. Each update is a checkpoint; the state is written anew
    every OVERLAY supersteps, so a superstep of few changes writes little. Where the
    program has no hooks, the rule is an aggregate and every edge leads to a vertex, up
    to CHAIN supersteps are one job instead (``_chained``). All vertices are returned.

    ``placement``: "hash" deals vertices by a hash of their id; "range" keeps ids
    that are near each other in one partition, so that a kernel goes far within it
    where ids follow the graph. The out-edges of a hub, a vertex of more than
    ``hub_degree``, are dealt over all partitions and meet its value by broadcast.
    """
    if max_iterations < 1:
        raise ValueError("max_iterations must be 1 or more")
    spark = graph.spark
    parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    context = spark.sparkContext
    wanted = {
        "spark__sql__adaptive__enabled": "false",
        "spark__sql__shuffle__partitions": parts,
        "spark__sql__requireAllClusterKeysForCoPartition": "false",
        "spark__sql__autoBroadcastJoinThreshold": -1,
    }
    raw = graph.edges.persist()
    try:
        check_edges(raw)
        raw, hubs = split_hubs(raw, hub_degree)
        with settings(spark, **wanted):
            vertices = graph.vertices.persist()
            place = Hashed(parts) if placement == "hash" else Ranged.of(vertices, parts)
            state = cut(place.vertices(vertices))
            vertices.unpersist()
            check_vertices(state)
            light = raw if hubs is None else raw.join(F.broadcast(hubs), "src", "left_anti")
            edges = place.edges(light).persist()
            heavy = None
            if hubs is not None:
                heavy = raw.join(F.broadcast(hubs), "src").repartition(parts, "src", "dst").persist()
            active, number, overlaid, done = state, 0, 0, False
            try:
                plain = heavy is None and isinstance(rule, Combine) and (isinstance(program, NativeProgram) or program.chained)
                if plain and step.targets_known(edges, state):
                    return _chained(state, edges, place, program, rule, max_iterations, name)
                while number < max_iterations:
                    number += 1
                    context.setJobDescription(f"{name}, superstep {number}")
                    rich = step.expand(active, edges)
                    if heavy is not None:
                        few = active.join(F.broadcast(hubs.withColumnRenamed("src", "id")), "id", "left_semi")
                        rich = rich.unionByName(step.expand(F.broadcast(few), heavy))
                    msgs = place.messages(step.messages(rich, program, number))
                    if isinstance(rule, Combine):
                        changed = step.combine(msgs, state, rule)
                    else:
                        changed = step.update(msgs, state, rule, number)
                    active = measured_cut(changed)
                    if active.isEmpty():
                        done = True
                        break
                    state, overlaid = step.apply_updates(state, active), overlaid + 1
                    if overlaid == OVERLAY:
                        state, overlaid = measured_cut(state), 0
                # The result must not be planned anew under other settings.
                if overlaid:
                    state = measured_cut(state)
            finally:
                edges.unpersist()
                if heavy is not None:
                    heavy.unpersist()
                context.setJobDescription(None)
    finally:
        raw.unpersist()
    return Result(state.select("id", F.col("value")), number, done)


def _chained(
    state: DataFrame, edges: DataFrame, place: Hashed | Ranged, program: PartitionProgram | NativeProgram, rule: Combine, most: int, name: str
) -> Result:
    """The same supersteps, up to CHAIN of them planned one by one and run as one job, so that a superstep costs a stage.

    The state has how many supersteps ``ago`` a value was set (as it is counted, every
    superstep has the same generated code), which tells the active vertices and, after
    the job, how many supersteps had any. Within a chain states are cached and can be
    made again; the last one is a checkpoint. Supersteps after the last change find no
    active vertex and change nothing. A join of the state with changes need not read
    all of them, so a message to no vertex could go unseen: every target must be one.
    """
    context = state.sparkSession.sparkContext
    state, number, length = state.withColumn("ago", F.lit(0)), 0, FIRST_CHAIN
    while True:
        end, held = min(number + length, most), []
        context.setJobDescription(f"{name}, supersteps {number + 1} to {end}")
        try:
            while number < end:
                active = state.where(F.col("ago") == 0).drop("ago")
                number += 1
                msgs = place.messages(step.messages(step.expand(active, edges), program, number))
                changed = step.combine(msgs, state, rule)
                state = step.apply_updates(state, changed)
                if number < end:
                    # A leaf for the planner, else plans double with each superstep.
                    state = state.checkpoint(eager=False).persist()
                    held.append(state)
            state = measured_cut(state)
        finally:
            for frame in held:
                frame.unpersist()
        least = state.agg(F.min("ago")).first()[0]
        last = 0 if least is None else number - least
        if last < number or number == most:
            return Result(state.select("id", "value"), min(last + 1, number), last < number)
        length = min(2 * length, CHAIN)
