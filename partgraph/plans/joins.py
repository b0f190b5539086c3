"""A join whose hot keys the adaptive planner can split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on equal columns, of which the left's are kept.

    ``right`` is an aggregate by those columns, most often of ``left`` itself. A
    plain join would take over the aggregate's partitioning, and the planner splits
    a hot key only where both sides are shuffled for the join. Joining by a struct
    of the columns gives each side a shuffle of its own (the aggregate's is small).
    Null columns are equal to each other, as they are in the aggregate.
    """
    key = "join_key"
    while key in left.columns or key in right.columns:
        key += "_"
    joined = left.withColumn(key, F.struct(*on)).join(right.withColumn(key, F.struct(*on)).drop(*on), key, how)
    return joined.drop(key)
