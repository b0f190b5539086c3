"""Line dedup: suffix array over line ids by distributed prefix doubling (operator 5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partgraph.llm.common import cut, documents, kept_while, row_key, skew_join, unused

#: Shorter repeated runs than this many lines stay.
MIN_LINES = 2
#: A line of so many words or more is a passage of its own: later copies of it go, whatever its neighbours.
PASSAGE_WORDS = 50

_WORD = r"[^\x20\x09-\x0D]+"


def _lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _has_words(line: str, n: int) -> Column:
    """Whether ``line`` has ``n`` words; most lines are too short for it and not searched."""
    return F.when(F.char_length(line) >= 2 * n - 1, F.regexp_count(line, F.lit(_WORD)) >= n).otherwise(False)


def _place() -> Column:
    return F.struct("d", "pos")


def _ranked(classes: DataFrame, *by: str) -> DataFrame:
    """``classes``, distinct in ``by``, with a number that rises with it.

    They are dealt by range and sorted, so no task holds them all, and a task that
    runs again numbers them alike.
    """
    return classes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("new", F.monotonically_increasing_id())


def line_table(docs: DataFrame, passage_words: int | None) -> DataFrame:
    """(d, pos, i1, i2, solid, passage) of every line of every text that is not null.

    d is the row's key; i1 and i2 are 128 bits of the line, its id.
    """
    d = docs.where(F.col("text").isNotNull()).select(row_key().alias("d"), F.posexplode(_lines_of(F.col("text"))).alias("pos", "line"))
    passage = _has_words("line", passage_words) if passage_words else F.lit(False)
    rows = d.select(
        "d", "pos", F.xxhash64("line").alias("i1"), F.xxhash64(F.lit(1), "line").alias("i2"),
        (F.trim("line") != "").alias("solid"), passage.alias("passage"),
    )
    return rows


def whole_copies(lines: DataFrame, min_lines: int) -> DataFrame:
    """(d, n_lines) of the texts of ``min_lines`` or more lines that stand whole at a smaller key.

    They are one run each. Left out of the search, they change nothing there: what
    they repeat, their first copy holds.
    """
    texts = lines.groupBy("d").agg((F.max("pos") + 1).alias("n_lines"), F.max("solid").alias("solid"))
    texts = texts.where(F.col("solid") & (F.col("n_lines") >= min_lines)).select("d", "n_lines")
    firsts = texts.groupBy(F.col("d.digest").alias("digest")).agg(F.min("d").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("n > 1").drop("n")
    texts = skew_join(texts.withColumn("digest", F.col("d.digest")), firsts, ["digest"])
    return cut(texts.where("d != first").select("d", "n_lines"))


def suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """The suffix array of repeated text: tables (d, pos, rank, ns, passage) for depths of 1, 2, 4, ... lines.

    Texts are sequences of line ids and every line starts a suffix, which ends with
    its text. The table of depth k holds the suffixes whose first k lines stand
    elsewhere too, ranked by them: equal rank, equal lines. Prefix doubling makes
    the table of 2k from pairs of ranks k lines apart, until every suffix left
    differs from all others or ends. Suffixes that stand alone leave at once. Counts
    of a rank are summed before they are shuffled and joined back, and ranks come
    from a sort by range, so a line that holds a third of all rows is never gathered
    in one task. ns is the next line, from pos on, that is not blank.
    """
    classes = lines.groupBy("i1", "i2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = lines.join(_ranked(classes, "i1", "i2"), ["i1", "i2"])
    onward = W.partitionBy("d").orderBy("pos").rowsBetween(0, W.unboundedFollowing)
    ns = F.min(F.when(F.col("solid"), F.col("pos"))).over(onward)
    tables = [cut(rows.select("d", "pos", F.col("new").alias("rank"), ns.alias("ns"), "passage"))]
    while not tables[-1].isEmpty():
        step = 1 << len(tables) - 1
        ahead = F.first("rank").over(W.partitionBy("d").orderBy("pos").rangeBetween(step, step))
        pairs = tables[-1].withColumn("next", ahead).where(F.col("next").isNotNull())
        classes = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        rows = pairs.join(_ranked(classes, "rank", "next"), ["rank", "next"])
        tables.append(cut(rows.select("d", "pos", F.col("new").alias("rank"), "ns", "passage")))
    return tables[:-1]


def longest_copies(tables: list[DataFrame]) -> DataFrame | None:
    """(d, pos, length, ns, passage): for each suffix the longest run from it that starts at a smaller place too.

    Goes down the longest-common-prefix intervals, a power of two at a time. Members
    of an interval (its length and its smallest place, cls) are split by the rank of what follows. A member
    that is not the smallest of its part goes on within it. The smallest stays and
    goes along as well, as one to compare with (``own`` is false): a member of
    another part that shares a longer run with any of this part shares it with the
    smallest. The first interval, of no lines, holds every suffix and is not kept.
    At depth 1 only passages enter from it.
    """
    inside: DataFrame | None = None
    kind = tables[0].schema["d"].dataType if tables else None
    nowhere = F.struct(F.lit(None).cast(kind).alias("d"), F.lit(0).alias("pos")) if tables else None
    for number in range(len(tables) - 1, -1, -1):
        step, table = 1 << number, tables[number]
        fresh = table if number else table.where("passage")
        if inside is not None:
            fresh = fresh.join(inside.where("own").select("d", "pos"), ["d", "pos"], "left_anti")
        rows = fresh.select("d", "pos", F.lit(0).alias("length"), nowhere.alias("cls"), F.lit(True).alias("own"), "ns", "passage", "rank")
        if inside is not None:
            ahead = table.select("d", F.col("pos").alias("at"), "rank")
            deeper = inside.withColumn("at", F.col("pos") + F.col("length")).join(ahead, ["d", "at"], "left")
            rows = rows.unionByName(deeper.drop("at"))
        by = ["length", "cls", "rank"]
        parts = rows.where(F.col("rank").isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(_place()).alias("first"))
        rows = skew_join(rows, parts.where("n > 1").drop("n"), by, "left")
        is_first = _place() == F.col("first")
        kept = lambda length, cls, own: F.struct(length.alias("length"), cls.alias("cls"), own.alias("own"))
        same = kept(F.col("length"), F.col("cls"), F.col("own"))
        on = kept(F.col("length") + step, F.col("first"), F.col("own") & ~is_first)
        to = F.when(F.col("first").isNull(), F.array(same)).when(is_first, F.array(same, on)).otherwise(F.array(on))
        rows = rows.select("d", "pos", "ns", "passage", F.explode(to).alias("to"))
        inside = cut(rows.select("d", "pos", "ns", "passage", "to.*").where("length > 0"))
    return None if inside is None else inside.where("own").drop("own", "cls")


def removed_runs(docs: DataFrame, min_lines: int = MIN_LINES, passage_words: int | None = None) -> DataFrame:
    """(d, runs, n_runs, longest_run): for each text what is deleted; d is its ``row_key``.

    A run of ``min_lines`` or more lines, not all blank, goes where it stands at an
    earlier place too, by (doc_id, line); a line of ``passage_words`` words likewise,
    alone. runs are the maximal stretches of lines to delete, [start, end) in order;
    n_runs counts the repeated runs that do not lie in one that starts before them,
    and longest_run is the longest of them.
    """
    # The lines are written once, for the copies and the search.
    with kept_while(line_table(docs, passage_words), "lines") as lines:
        copies = whole_copies(lines, min_lines)
        tables = suffix_ranks(lines.join(copies.select("d"), "d", "left_anti").dropDuplicates(["d", "pos"]))
    found = longest_copies(tables)
    span = F.struct(F.lit(0).alias("start"), F.col("n_lines").alias("end"))
    whole = copies.select("d", F.array(span).alias("runs"), F.lit(1).alias("n_runs"), F.col("n_lines").alias("longest_run"))
    if found is None:
        return whole
    long = (F.col("length") >= min_lines) & (F.col("ns") < F.col("pos") + F.col("length"))
    counted = F.when(long, F.col("length")).when(F.col("passage"), 1)
    found = found.withColumn("counted", counted).where(F.col("counted").isNotNull())
    by_place = W.partitionBy("d").orderBy("pos")
    end = F.col("pos") + F.col("counted")
    earlier = F.max(end).over(by_place.rowsBetween(W.unboundedPreceding, -1))
    found = found.select(
        "d", "pos", "counted", end.alias("end"),
        F.coalesce(F.col("pos") > earlier, F.lit(True)).cast("int").alias("fresh"),
        F.coalesce(end > earlier, F.lit(True)).cast("int").alias("run"),
    )
    found = found.withColumn("stretch", F.sum("fresh").over(by_place))
    stretches = found.groupBy("d", "stretch").agg(
        F.min("pos").alias("start"), F.max("end").alias("end"), F.sum("run").cast("int").alias("run"), F.max("counted").alias("most")
    )
    runs = stretches.groupBy("d").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"),
        F.sum("run").cast("int").alias("n_runs"),
        F.max("most").alias("longest_run"),
    )
    return whole.unionByName(runs)


def dedup_lines(
    docs: DataFrame, min_lines: int = MIN_LINES, prefix: str = "", passage_words: int | None = None
) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from text.

    Lines end with a line feed and are compared exactly (by 128 bits). The first place of a run,
    by (doc_id, line), keeps it. With ``passage_words`` a later copy of a single line of
    so many words goes too, whatever its neighbours. Added, with ``prefix`` before their names (and
    replaced if the input has them): n_lines, n_removed, n_runs and longest_run as ``removed_runs`` counts them;
    text is the remaining lines joined. Null text stays null, with 0 lines and nothing removed; an empty
    text is one blank line; runs of blank lines only stay. Rows equal in doc_id and
    text are one document, all with its result. A null doc_id orders first. No rows
    give no rows. Other columns stay, whatever their names. A very long text is split within its row.
    """
    made = [prefix + name for name in ("n_lines", "n_removed", "n_runs", "longest_run")]
    docs = docs.drop(*made)
    key, info, mask = (unused(docs, x) for x in ("key", "info", "mask"))
    removed = removed_runs(docs, min_lines, passage_words)
    removed = removed.select(F.col("d").alias(key), F.struct("runs", "n_runs", "longest_run").alias(info))
    d = docs.withColumn(key, F.when(F.col("text").isNotNull(), row_key())).join(removed, key, "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    runs = F.coalesce(F.col(info)["runs"], none)
    length = F.transform(runs, lambda r: r["end"] - r["start"])
    d = d.withColumns(
        {
            made[0]: F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines_of(F.col("text")))).cast("long"),
            made[1]: F.aggregate(length, F.lit(0), lambda a, x: a + x).cast("long"),
            made[2]: F.coalesce(F.col(info)["n_runs"], F.lit(0)).cast("long"),
            made[3]: F.coalesce(F.col(info)["longest_run"], F.lit(0)).cast("long"),
        }
    )
    gaps = F.transform(
        runs,
        lambda r, i: F.concat(
            F.array_repeat(F.lit(False), r["start"] - F.when(i > 0, F.get(runs, i - 1)["end"]).otherwise(0)),
            F.array_repeat(F.lit(True), r["end"] - r["start"]),
        ),
    )
    d = d.withColumn(mask, F.flatten(gaps))
    kept = F.filter(_lines_of(F.col("text")), lambda _, i: ~F.coalesce(F.get(mask, i), F.lit(False)))
    text = F.when(F.col(info).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return d.withColumn("text", text).drop(key, mask, info)


def without_copied_lines(
    docs: DataFrame, min_lines: int = MIN_LINES, passage_words: int | None = None
) -> DataFrame:
    """``docs`` with the same columns after ``dedup_lines``.

    A document of which every line was a later copy goes; n_chars, if there is one,
    is set anew where text changed.
    """
    p = reduce(lambda p, _: p + "_" if any(c.lower().startswith(p) for c in docs.columns) else p, docs.columns, "dedup_")
    d = dedup_lines(docs, min_lines, p, passage_words).where((F.col(p + "n_removed") == 0) | (F.col(p + "n_removed") < F.col(p + "n_lines")))
    if "n_chars" in docs.columns:
        changed = F.when(F.col(p + "n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType))
        d = d.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return d.select(*docs.columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its lines, what was deleted, and a digest of the rest."""
    d = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), passage_words=PASSAGE_WORDS)
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return d.select("doc_id", "n_lines", "n_removed", "n_runs", "longest_run", digest)


#: Common prefixes of all pairs of places of one line, along their diagonals, to any depth.
OP5_SQL = rf"""
with l as (
  select doc_id, generate_subscripts(lines, 1) - 1 as pos, unnest(lines) as line
  from (select doc_id, string_split(text, chr(10)) as lines from documents where text is not null)),
s as (
  select doc_id, pos, line, len(regexp_extract_all(line, '{_WORD}')) >= {PASSAGE_WORDS} as passage,
         min(case when trim(line, ' ') <> '' then pos end) over (partition by doc_id order by pos rows between current row and unbounded following) as ns
  from l),
p as (select a.doc_id, a.pos, b.doc_id as other, a.pos - b.pos as diagonal
      from l a join l b on a.line = b.line and (b.doc_id, b.pos) < (a.doc_id, a.pos)),
i as (select *, pos - row_number() over (partition by doc_id, other, diagonal order by pos) as island from p),
c as (select doc_id, pos, max(pos) over (partition by doc_id, other, diagonal, island) - pos + 1 as length from i),
e as (select doc_id, pos, max(length) as length from c group by doc_id, pos),
q as (select doc_id, pos, case when length >= {MIN_LINES} and ns < pos + length then length when passage then 1 end as counted
      from e join s using (doc_id, pos)),
g as (select s.doc_id, s.pos, s.line, q.counted,
             coalesce(max(s.pos + q.counted) over (partition by s.doc_id order by s.pos) > s.pos, false) as gone,
             coalesce(max(s.pos + q.counted) over (partition by s.doc_id order by s.pos rows between unbounded preceding and 1 preceding)
                      >= s.pos + q.counted, false) as inner_run
      from s left join q on q.doc_id = s.doc_id and q.pos = s.pos),
k as (select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_removed,
             count(*) filter (counted is not null and not inner_run)::bigint as n_runs,
             coalesce(max(counted), 0)::bigint as longest_run,
             sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
      from g group by doc_id)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_runs, 0)::bigint as n_runs,
       coalesce(longest_run, 0)::bigint as longest_run, coalesce(kept_sha256, sha256('')) as kept_sha256
from documents left join k using (doc_id)
"""
