"""Edge lists in text: "from to[ weight]", one edge a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_edges(spark: SparkSession, path: str, weighted: bool = False, sep: str = r"\s+", comment: str = "%") -> DataFrame:
    """(src, dst[, value double]) of a file or folder; blank lines and those that begin with ``comment`` are left out.

    ``sep`` is a pattern. A line whose first fields are no numbers fails the read and
    is named in the error; further columns (a time, say) are ignored.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    lines = lines.where((F.col("line") != "") & ~F.startswith("line", F.lit(comment)))
    fields = F.split("line", sep)
    kinds = {"src": "long", "dst": "long"} | ({"value": "double"} if weighted else {})
    made = [F.get(fields, F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(kinds.items())]
    rows = lines.select("line", *made)
    good = F.lit(True)
    for name in kinds:
        good &= F.col(name).isNotNull()
    error = F.raise_error(F.concat(F.lit("this line is no edge: "), F.col("line")))
    return rows.where(F.when(good, True).otherwise(error)).select(*kinds)


def write_vertices(vertices: DataFrame, path: str, sep: str = " ") -> None:
    """(id, value) as text, one vertex a line."""
    vertices.select("id", "value").write.mode("errorifexists").options(sep=sep).csv(path)
