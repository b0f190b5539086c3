"""Mixing sources to target weights by systematic sampling (operator 2)."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partgraph.llm.common import documents, unused, written

#: Weights dealt to the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source and no document is repeated more often than this.
MOST_COPIES = 3
#: Hexadecimal digits of the hash of doc_id that make the slices of one (source, size) group: 256 slices, so that a
#: hot group is not one task.
SLICE_DIGITS = 2


def offset_of(seed: int) -> float:
    """The one random offset of the systematic sample, in [0, 1)."""
    return random.Random(seed).random()


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """From (source, source_size), one row a source, the words each should give.

    All sizes together are shared by weight; a share above ``most`` times its
    source's size stops there and the excess is shared again by weight until none
    is above. That fixpoint is min(cap, level * weight) for one level, found here
    by sorting on cap / weight: the first source whose level is below its ratio
    sets it. A source of size 0 gets 0.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    whole = W.partitionBy(F.lit(1))
    order = [F.col("ratio"), F.col("source").asc_nulls_last()]
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    t = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    t = t.withColumn("all_size", F.sum("source_size").over(whole).cast("double")).withColumn(
        "all_weight", F.sum("weight").over(whole)
    )
    t = t.withColumn(
        "level",
        (F.col("all_size") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    t = t.withColumn("chosen", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole))
    target = F.least(F.col("cap"), F.coalesce(F.col("chosen.level") * F.col("weight"), F.col("cap")))
    return t.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 7) -> DataFrame:
    """Copies of each document so that sources meet their target weights.

    A document's expected copies are target / size of its source. Within a source
    the documents stand in order of (size, slice, doc_id), a slice being the first digits of
    doc_id's MD5; the prefix sum
    of the expected copies plus one random offset crosses an integer boundary once
    for each copy emitted. Standing by size makes the words taken come within
    about one long document of the target. The prefix sum is distributed: counts
    of (source, size, slice) are summed first, rows are numbered within a slice
    only.

    Returns the columns of ``docs`` with size, source_size, target, copies and
    taken (copies * size); rows with 0 copies stay. Columns of those names in the
    input are replaced. Null text: size 0, never copied unless its source has
    words. Null source: a source of its own, last in order. Equal doc_ids: each
    row counts; equal rows are interchangeable. A source of no words: target 0,
    no copies. Other columns stay, whatever their names. A text of any length is
    counted in its row. No rows: no rows.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    return _sample(docs.drop(*made).withColumn("size", n_words(F.col("text"))), weights, most, seed)


def slice_of(doc_id: Column) -> Column:
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, SLICE_DIGITS)


def _sample(d: DataFrame, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """``mix`` of rows that have their size."""
    src, slot, below, ahead, rank, n = (unused(d, x) for x in ("src", "slot", "below", "ahead", "rank", "n"))
    # A struct is never null, so the joins below keep a null source.
    base = d.withColumns({src: F.struct(F.col("source").cast("string").alias("source")), slot: slice_of(F.col("doc_id"))})
    slots = base.groupBy(src, "size", slot).agg(F.count(F.lit(1)).alias(n))
    by_size = slots.groupBy(src, "size").agg(F.sum(n).alias("docs"))
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    by_size = by_size.withColumn(below, F.coalesce(F.sum("docs").over(before(W.partitionBy(src).orderBy("size"))), zero))
    sizes = by_size.groupBy(src).agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    targets = source_targets(sizes.select(F.col(src)["source"].alias("source"), "source_size"), weights, most)
    targets = targets.withColumn(src, F.struct("source")).drop("source")
    by_size = by_size.drop("docs").join(targets, src)
    slots = slots.withColumn(ahead, F.coalesce(F.sum(n).over(before(W.partitionBy(src, "size").orderBy(slot))), zero))
    slots = slots.drop(n).join(by_size, [src, "size"])
    within = W.partitionBy(src, "size", slot).orderBy("doc_id")
    rows = base.withColumn(rank, F.row_number().over(within)).join(slots, [src, "size", slot])
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col(below) + F.col(ahead) + F.col(rank)
    u = F.lit(offset_of(seed))
    copies = (F.floor(each * place + u) - F.floor(each * (place - 1) + u)).cast("long")
    rows = rows.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.drop(src, slot, below, ahead, rank)


def emit(mixed: DataFrame) -> DataFrame:
    """One row for each copy of ``mix``'s result, numbered in ``copy`` from 1 (``copy_`` if the input has a ``copy``)."""
    numbers = F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return mixed.withColumn(unused(mixed, "copy"), F.explode(numbers))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 2 over all documents; texts are counted once, and only (doc_id, source, size) go on."""
    d = written(documents(spark, sf_dir).select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    return _sample(d, WEIGHTS, MOST_COPIES, 7).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = rf"""
with d as (
  select doc_id, source,
         length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[^w]', '', 'g'))::bigint size
  from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
w as (select source, source_size, 3.0::double * source_size cap,
             [5.0, 2.0, 1.0][1 + ((row_number() over (order by source nulls last) - 1) % 3)::int]::double weight from s),
r as (select *, cap / weight ratio, (sum(source_size) over ())::double all_size, sum(weight) over () all_weight from w),
l as (select *, (all_size - coalesce(sum(cap) over b, 0)) / (all_weight - coalesce(sum(weight) over b, 0)) as level
      from r window b as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
c as (select min({{'ratio': ratio, 'level': level}}) filter (level <= ratio) chosen from l),
t as (select source, source_size, least(cap, coalesce(chosen.level * weight, cap)) target from l, c),
p as (select doc_id, size, source_size, target,
             case when source_size > 0 then target / source_size else 0.0 end each_,
             row_number() over (partition by d.source order by size, left(md5(coalesce(doc_id::varchar, '')), {SLICE_DIGITS}), doc_id) place
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       ((floor(each_ * place + {offset_of(7)!r}) - floor(each_ * (place - 1) + {offset_of(7)!r})) * size)::bigint taken
from p
"""
