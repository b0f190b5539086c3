"""What a user writes: a program for partitions and a rule for vertices."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Context:
    """superstep counts from 1; partition is the number of the physical partition."""

    superstep: int
    partition: int


class PartitionProgram:
    """Works once a superstep on the out-edges of the active vertices of one partition.

    ``process`` gets batches with columns src_id, src_value, edge_value, dst_id and
    yields batches with columns id and msg, delivered in the same superstep. The
    hooks run in every partition, ``init`` in superstep 1 only, also where the
    partition is empty. A program is sent to the workers anew each superstep: what
    it sets on itself does not last.
    """

    #: Spark type of the message, as DDL.
    message_type = "long"
    #: True where there are no hooks and no messages without edges: supersteps may then run beyond the last change.
    chained = False

    def init(self, context: Context) -> None: ...

    def pre_superstep(self, context: Context) -> None: ...

    def process(self, batches: Iterator[pd.DataFrame], context: Context) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def post_superstep(self, context: Context) -> None: ...


class VertexUpdate:
    """Called once a superstep for each vertex that has messages.

    ``update`` sees the id, the value and a single-pass iterator of messages, and
    may call ``set_new_value`` once. A vertex whose value was set, be it to the
    same value, is active in the next superstep.
    """

    def init(self, context: Context) -> None: ...

    def pre_superstep(self, context: Context) -> None: ...

    def update(self, vertex_id: Any, value: Any, messages: Iterator[Any]) -> None:
        raise NotImplementedError

    def post_superstep(self, context: Context) -> None: ...

    _fresh: list | None = None

    def set_new_value(self, value: Any) -> None:
        if self._fresh:
            raise RuntimeError("set_new_value can be called once per update")
        self._fresh = [value]


@dataclass(frozen=True)
class Combine:
    """A rule without Python: messages are combined by an aggregate and replace the value where ``better``."""

    name: str

    def combined(self, msg: Column) -> Column:
        return {"min": F.min, "max": F.max}[self.name](msg)

    def better(self, msg: Column, value: Column) -> Column:
        return msg < value if self.name == "min" else msg > value


MIN, MAX = Combine("min"), Combine("max")


@dataclass(frozen=True)
class NativeProgram:
    """A program without Python: the message along each edge, or null for none."""

    message: Any  # Callable[[Column, Column], Column] of (src_value, edge_value)
    message_type: str = "long"
