"""Benchmark decontamination: size-partitioned MinHash containment search (operator 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partgraph.llm.common import cut, documents, row_key, table, unused

#: Words of a shingle, and the share of an item's shingles that makes a find. An item of fewer words is one shingle.
WIDTH, THRESHOLD = 5, 0.8
#: Items of up to so many bytes of text in all are sent to every task, as sketches and as shingles (a shingle starts
#: at every second byte at most, and is held with some 35 bytes: 70 MB); beyond, the documents' shingles and texts are
#: shuffled to them.
MOST_BROADCAST = 4 << 20

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words: runs of ASCII letters, digits and anything beyond ASCII."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _BREAK), "")


def windows(w: str, width: Column | int) -> Column:
    """The slices of ``width`` words of the column of words ``w``, in order of place."""
    width = F.lit(width) if isinstance(width, int) else width
    last = F.size(w) - width + 1
    at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.slice(w, i, width))


def own_width(w: str) -> Column:
    """Words of an item's shingles: WIDTH, or all that it has."""
    return F.least(F.size(w), F.lit(WIDTH))


def shingle_texts(slices: Column) -> Column:
    """Distinct shingles, as text; words hold no blank, so shingles of several widths stay apart."""
    return F.array_distinct(F.transform(slices, lambda x: F.array_join(x, " ")))


def shingle_hashes(slices: Column) -> Column:
    """64-bit hashes of shingles, in order of place."""
    return F.transform(slices, lambda x: F.xxhash64(x))


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, hash): the MinHash sketch of each item.

    Items are partitioned by size, doubling. An item of a partition whose largest
    size is u keeps the floor((1 - threshold) * u) + 1 smallest of its shingle
    hashes: a text that contains ``threshold`` of the item lacks at most
    (1 - threshold) * u shingles and so has one of these. The search over sketches
    thus misses nothing, and short items have short sketches.
    """
    by = items.select("item_id", F.array_sort(F.array_distinct(shingle_hashes(windows("w", own_width("w"))))).alias("hashes"))
    by = by.withColumn("part", F.floor(F.log2(F.greatest(F.size("hashes"), F.lit(1)))))
    largest = by.groupBy("part").agg(F.max(F.size("hashes")).alias("largest"))
    # A small slack keeps (1 - threshold) * largest from rounding below its whole value.
    keep = F.floor((1 - threshold) * F.col("largest") + 1e-9).cast("int") + 1
    kept = F.slice("hashes", F.lit(1), keep)
    return by.join(largest, "part").select("item_id", F.explode(kept).alias("hash"))


def find_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and a test item of which it holds ``threshold`` or more.

    Containment is the share of the item's distinct five-word shingles, as text,
    that stand in the document; an item of under five words is one shingle of all of
    them. Every shingle of every document, of each width that items have, probes the
    items' sketches; pairs that meet are verified on the texts. Plain LSH over
    signatures of the documents can't reach full recall here: an item is a few
    thousandths of a long document, so their signatures all but never agree.

    Returns key (a row's ``row_key``), doc_id, item_id, n_item, n_shared,
    containment, once for rows equal in doc_id and text. Null and empty texts hold
    nothing, items without words are never found. Several items of one item_id are
    one each. Equal rows, null ids, ties: as others. Other columns are left out. A
    text of any length is cut into words within its row. Empty tables: no pairs.
    """
    d = docs.select(row_key().alias("key"), "text")
    # An item is known by its id and text's hash, so that a null or repeated id stays one item.
    i = items.select(
        F.struct("item_id", F.xxhash64("text").alias("h")).alias("item_id"),
        words(F.col("text")).alias("w"),
        F.octet_length(F.col("text").cast("string")).cast("long").alias("n_bytes"),
    )
    i = i.where(F.size("w") >= 1).dropDuplicates(["item_id"])
    facts = i.agg(F.sum("n_bytes").alias("bytes"), F.collect_set(own_width("w")).alias("widths")).first()
    widths = sorted(facts["widths"]) or [WIDTH]
    sketch = sketches(i, threshold).groupBy("hash").agg(F.collect_set("item_id").alias("found"))
    of_text = F.flatten(F.array(*[windows("w", n) for n in widths])) if len(widths) > 1 else windows("w", widths[0])
    probes = d.select("key", words(F.col("text")).alias("w")).select("key", F.explode(shingle_hashes(of_text)).alias("hash"))
    small = (facts["bytes"] or 0) <= MOST_BROADCAST
    met = probes.join(F.broadcast(sketch) if small else sketch, "hash")
    # Kept, because the texts are chosen by them and then joined with them.
    pairs = cut(met.select("key", F.explode("found").alias("item_id")).distinct())
    # The texts of the documents met, once each; words are made after the join.
    texts = d.join(pairs.select("key").distinct(), "key").dropDuplicates(["key"])
    texts = texts.select("key", words(F.col("text")).alias("w")).select("key", shingle_texts(of_text).alias("has"))
    wanted = i.select("item_id", shingle_texts(windows("w", own_width("w"))).alias("wants"))
    wanted = wanted.select("item_id", "wants", F.size("wants").alias("n_item"))
    checked = pairs.join(F.broadcast(wanted) if small else wanted, "item_id").join(texts, "key")
    checked = checked.withColumn("n_shared", F.size(F.array_intersect("wants", "has")))
    share = F.col("n_shared") / F.col("n_item")
    return checked.where(share >= threshold).select(
        "key",
        F.col("key.doc_id").alias("doc_id"),
        F.col("item_id.item_id").alias("item_id"),
        F.col("n_item").cast("long").alias("n_item"),
        F.col("n_shared").cast("long").alias("n_shared"),
        share.alias("containment"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that hold a test item; all other rows and columns stay as they are, whatever their names."""
    name = unused(docs, "key")
    found = find_items(docs, items, threshold).select(F.col("key").alias(name)).distinct()
    return docs.withColumn(name, row_key()).join(found, name, "left_anti").drop(name)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it contains."""
    return find_items(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("key")


OP8_SQL = rf"""
with dw as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_BREAK}'), lambda x: x <> '') as w from documents),
iw as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_BREAK}'), lambda x: x <> '') as w from benchmark),
widths as (select distinct least(len(w), {WIDTH}) as k from iw where len(w) >= 1),
ds as (select distinct doc_id, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i+k-1], ' '))) as s
       from dw, widths where len(w) >= k),
its as (select distinct item_id, unnest(list_transform(generate_series(1, len(w) - least(len(w), {WIDTH}) + 1),
               lambda i: array_to_string(w[i:i+least(len(w), {WIDTH})-1], ' '))) as s
       from iw where len(w) >= 1),
n as (select item_id, count(*) as n_item from its group by item_id)
select doc_id, item_id, n_item::bigint as n_item, count(*)::bigint as n_shared, count(*) / n_item as containment
from ds join its using (s) join n using (item_id)
group by doc_id, item_id, n_item having count(*) / n_item >= {THRESHOLD}
"""
