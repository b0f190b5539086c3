"""Where vertices and their out-edges live during an iteration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers tried for each partition when looking for one that hashes to it.
TRIES = 64


@dataclass(frozen=True)
class Hashed:
    """By a hash of the id."""

    parts: int

    def vertices(self, frame: DataFrame) -> DataFrame:
        return frame.repartition(self.parts, "id").sortWithinPartitions("id")

    def edges(self, frame: DataFrame) -> DataFrame:
        return frame.repartition(self.parts, "src").sortWithinPartitions("src")

    def messages(self, frame: DataFrame) -> DataFrame:
        return frame


@dataclass(frozen=True)
class Ranged:
    """By ranges of ids, of about equally many vertices each.

    Frames get a column ``part``, a number whose hash leads to the range's partition,
    computed from the id alone; they are hash-partitioned by it and joined by (part,
    id), which keeps the co-partitioning. (Partitioning frames by range one by one
    would not: each would have bounds of its own.)
    """

    parts: int
    bounds: tuple
    salts: tuple[int, ...]

    @staticmethod
    def of(vertices: DataFrame, parts: int) -> Ranged:
        if not isinstance(vertices.schema["id"].dataType, T.LongType):
            raise ValueError("range placement needs integer ids")
        wanted = [i / parts for i in range(1, parts)]
        bounds = sorted({int(b) for b in vertices.approxQuantile("id", wanted, 0.1 / parts)} if wanted else set())
        tried = vertices.sparkSession.range(TRIES * parts).select(F.col("id").cast("int").alias("salt"))
        found = tried.groupBy(F.pmod(F.hash("salt"), F.lit(parts)).alias("part")).agg(F.min("salt").alias("salt"))
        salts = {r["part"]: r["salt"] for r in found.collect()}
        if len(salts) < parts:
            raise RuntimeError("found no number for some partition")
        return Ranged(parts, tuple(bounds), tuple(salts[i] for i in range(parts)))

    def part(self, vertex: Column) -> Column:
        """The number for an id, by a search tree over the bounds."""

        def tree(bounds: Sequence, first: int) -> Column:
            if not bounds:
                return F.lit(self.salts[first])
            mid = len(bounds) // 2
            above = tree(bounds[mid + 1 :], first + mid + 1)
            return F.when(vertex <= F.lit(bounds[mid]), tree(bounds[:mid], first)).otherwise(above)

        return tree(self.bounds, 0)

    def vertices(self, frame: DataFrame) -> DataFrame:
        dealt = frame.withColumn("part", self.part(F.col("id"))).repartition(self.parts, "part")
        return dealt.sortWithinPartitions("part", "id")

    def edges(self, frame: DataFrame) -> DataFrame:
        dealt = frame.withColumn("part", self.part(F.col("src"))).repartition(self.parts, "part")
        return dealt.sortWithinPartitions("part", "src")

    def messages(self, frame: DataFrame) -> DataFrame:
        return frame.withColumn("part", self.part(F.col("id"))).repartition(self.parts, "part")
