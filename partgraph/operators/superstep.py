"""The parts of one superstep, each a function from frames to a frame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partgraph.functions.programs import Combine, Context, NativeProgram, PartitionProgram, VertexUpdate


#: What a message to an id that is no vertex is told, before the id.
NO_VERTEX = "a message was sent to an id that is no vertex"


def keys_of(frame: DataFrame) -> list[str]:
    """The columns that frames of one iteration are joined by."""
    return [c for c in ("part", "id") if c in frame.columns]


def expand(active: DataFrame, edges: DataFrame) -> DataFrame:
    """Rich edges (src_id, src_value, edge_value, dst_id): the out-edges of the active vertices."""
    value = F.col("e.value") if "value" in edges.columns else F.lit(None).cast("long")
    same = F.col("v.id") == F.col("e.src")
    if "part" in edges.columns:
        same = (F.col("v.part") == F.col("e.part")) & same
    joined = active.alias("v").join(edges.alias("e"), same)
    return joined.select(
        F.col("v.id").alias("src_id"), F.col("v.value").alias("src_value"), value.alias("edge_value"), F.col("e.dst").alias("dst_id")
    )


def messages(rich: DataFrame, program: PartitionProgram | NativeProgram, superstep: int) -> DataFrame:
    """(id, msg) that the program sends from each partition of rich edges."""
    id_type = rich.schema["dst_id"].dataType.simpleString()
    if isinstance(program, NativeProgram):
        msg = program.message(F.col("src_value"), F.col("edge_value")).cast(program.message_type)
        return rich.select(F.col("dst_id").alias("id"), msg.alias("msg")).where(F.col("msg").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = Context(superstep, TaskContext.get().partitionId())
        if superstep == 1:
            program.init(context)
        program.pre_superstep(context)
        yield from program.process(batches, context)
        program.post_superstep(context)

    return rich.mapInPandas(run, f"id {id_type}, msg {program.message_type}")


def check_target(known: Column, target: Column, result: Column) -> Column:
    """``result``, or an error that names the target where there is no such vertex."""
    error = F.concat(F.lit(NO_VERTEX + ": "), target.cast("string"))
    return F.when(known, result).otherwise(F.raise_error(error))


def targets_known(edges: DataFrame, state: DataFrame) -> bool:
    """Whether every edge leads to a vertex."""
    return edges.select(F.col("dst").alias("id")).distinct().join(state, "id", "left_anti").isEmpty()


def combine(msgs: DataFrame, state: DataFrame, rule: Combine) -> DataFrame:
    """(id, value) of the vertices that change, by an aggregate with partial sums before the shuffle."""
    keys = keys_of(msgs)
    best = msgs.groupBy(*keys).agg(rule.combined(F.col("msg")).alias("msg"))
    s = state.select(*keys, "value", F.lit(True).alias("known"))
    joined = best.join(s, keys, "left")
    change = check_target(F.col("known").isNotNull(), F.col("id"), rule.better(F.col("msg"), F.col("value")))
    return joined.where(change).select(*keys, F.col("msg").cast(state.schema["value"].dataType).alias("value"))


def update(msgs: DataFrame, state: DataFrame, rule: VertexUpdate, superstep: int) -> DataFrame:
    """(id, value) of the vertices whose value the rule sets.

    Messages are sorted by target and streamed through the rule, so a target of
    any number of messages costs no memory.
    """
    keys = keys_of(msgs)
    s = state.select(*keys, "value", F.lit(True).alias("known"))
    joined = msgs.join(s, keys, "left")
    value = check_target(F.col("known").isNotNull(), F.col("id"), F.col("value"))
    rows = joined.select(*keys, value.alias("value"), "msg")
    rows = (rows if "part" in keys else rows.repartition("id")).sortWithinPartitions("id")
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = Context(superstep, TaskContext.get().partitionId())
        if superstep == 1:
            rule.init(context)
        rule.pre_superstep(context)
        flat = (row for batch in batches for row in zip(batch["id"], batch["value"], batch["msg"], strict=True))
        ids, values = [], []
        ahead = next(flat, None)
        while ahead is not None:
            vertex, old = ahead[0], ahead[1]

            def of_vertex(first=ahead, vertex=vertex) -> Iterator:
                nonlocal ahead
                ahead = first
                while ahead is not None and ahead[0] == vertex:
                    msg, ahead = ahead[2], next(flat, None)
                    yield msg

            stream = of_vertex()
            rule._fresh = None
            rule.update(vertex, old, stream)
            for _ in stream:  # what the rule left unread
                pass
            if rule._fresh:
                ids.append(vertex)
                values.append(rule._fresh[0])
            if len(ids) >= 10_000:
                yield pd.DataFrame({"id": ids, "value": values})
                ids, values = [], []
        rule.post_superstep(context)
        if ids:
            yield pd.DataFrame({"id": ids, "value": values})

    changed = rows.select("id", "value", "msg").mapInPandas(run, f"id {kinds['id']}, value {kinds['value']}")
    # A vertex stays where it was.
    return changed if "part" not in keys else changed.join(state.select("part", "id"), "id").select("part", "id", "value")


def apply_updates(state: DataFrame, updated: DataFrame) -> DataFrame:
    """The state with the new values; vertices without one keep theirs. A column ``ago`` counts from the last new value."""
    keys = keys_of(state)
    new = updated.select(*keys, F.col("value").alias("new"), F.lit(True).alias("hit"))
    value = F.when(F.col("hit"), F.col("new")).otherwise(F.col("value"))
    ago = [F.when(F.col("hit"), F.lit(0)).otherwise(F.col("ago") + 1).alias("ago")] if "ago" in state.columns else []
    return state.join(new, keys, "left").select(*keys, value.alias("value"), *ago)
