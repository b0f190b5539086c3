"""Chat formatting: minimum-cost role repair over a legal-turn automaton (operator 4)."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partgraph.llm.common import cut, small_batches, table

#: States of the automaton: what the last turn written is. 0: nothing yet.
STATES = ("start", "system", "user", "assistant")
#: Legal next turns. A conversation may end after LAST, or be empty.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
LAST = 3
MERGE, RELABEL, INSERT = 1, 2, 3
#: A conversation of more turns is worked on and written in parts of so many, so that a huge one is not one task.
PART = 4096


@lru_cache(maxsize=None)
def bridge(state: int, turn: int) -> tuple[int, ...] | None:
    """The fewest empty turns that lead from a state to one after which ``turn`` is legal; ties: smallest roles."""
    paths: list[tuple[int, tuple[int, ...]]] = [(state, ())]
    for _ in range(len(STATES)):
        for s, inserted in paths:
            if turn in NEXT[s]:
                return inserted
        paths = [(t, (*inserted, t)) for s, inserted in paths for t in NEXT[s]]
    return None


def ending(state: int) -> tuple[int, ...]:
    """The empty turns that close a conversation."""
    if state in (0, LAST):
        return ()
    inserted = bridge(state, LAST)
    return (*(inserted or ()), LAST)


@lru_cache(maxsize=None)
def moves(role: int) -> np.ndarray:
    """Cost of taking a turn of ``role`` (0: unknown) from each state to each state; infinity: impossible."""
    cost = np.full((4, 4), np.inf)
    for s in range(4):
        for t in (1, 2, 3):
            relabel = RELABEL * (role != t)
            if s == t:
                cost[s, t] = MERGE + relabel
            inserted = bridge(s, t)
            if inserted is not None:
                cost[s, t] = min(cost[s, t], INSERT * len(inserted) + relabel)
    return cost


def through(roles: list[int]) -> np.ndarray:
    """Least cost from each state to each state over a run of turns (min-plus product)."""
    total = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
    for r in roles:
        total = (total[:, :, None] + moves(r)[None]).min(axis=1)
    return total


def path(roles: Sequence[int], entry: int, leave: int) -> list[int]:
    """States after each turn of a least-cost way from ``entry`` to ``leave``; ties: the smaller state, earliest first."""
    togo = np.full((len(roles) + 1, 4), np.inf)
    togo[-1, leave] = 0
    for i in range(len(roles) - 1, -1, -1):
        togo[i] = (moves(roles[i]) + togo[i + 1]).min(axis=1)
    out, s = [], entry
    for i, r in enumerate(roles):
        s = int(np.argmin(moves(r)[s] + togo[i + 1]))
        out.append(s)
    return out


_short_path = lru_cache(maxsize=100_000)(path)


def plan(parts: list[np.ndarray]) -> list[tuple[int, int]]:
    """(entry, leave) of each part of a conversation on a least-cost way; ties: the smaller leave state."""
    togo = np.array([INSERT * len(ending(s)) for s in range(4)], float)
    after = [togo]
    for m in reversed(parts):
        togo = (m + togo).min(axis=1)
        after.append(togo)
    after.reverse()
    out, s = [], 0
    for i, m in enumerate(parts):
        t = int(np.argmin(m[s] + after[i + 1]))
        out.append((s, t))
        s = t
    return out


def _open(role: int) -> str:
    return f"<|im_start|>{STATES[role]}\n"


_CLOSE = "<|im_end|>\n"


def render(roles: list[int], texts: list[str], entry: int, leave: int, last: bool) -> tuple[str, dict[str, int]]:
    """The text of one part and counts of what was done. Markers within a text are broken up."""
    done = {"turns_out": 0, "cost": 0, "merges": 0, "relabels": 0, "insertions": 0}
    pieces: list[str] = []
    s = entry

    def insert(inserted: tuple[int, ...]) -> None:
        nonlocal s
        for role in inserted:
            pieces.append((_CLOSE if s else "") + _open(role))
            done["insertions"] += 1
            s = role

    states = _short_path(tuple(roles), entry, leave) if len(roles) <= 16 else path(roles, entry, leave)
    for role, text, t in zip(roles, texts, states, strict=True):
        text = text.replace("<|", "< |")
        inserted = bridge(s, t)
        done["relabels"] += role != t
        if s == t and (inserted is None or INSERT * len(inserted) >= MERGE):
            pieces.append("\n" + text)
            done["merges"] += 1
        else:
            insert(inserted or ())
            pieces.append((_CLOSE if s else "") + _open(t) + text)
            done["turns_out"] += 1
        s = t
    if last:
        insert(ending(s))
        pieces.append(_CLOSE if s else "")
    done["turns_out"] += done["insertions"]
    done["cost"] = MERGE * done["merges"] + RELABEL * done["relabels"] + INSERT * done["insertions"]
    return "".join(pieces), done


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list]]:
    """The columns of the runs of equal keys of rows sorted by them, also where a run spans batches."""
    kept: dict[str, list] = {}
    kept_key: tuple | None = None
    for batch in batches:
        columns = batch.to_pydict()
        key = list(zip(*(columns[k] for k in keys), strict=True))
        at = 0
        for i in range(1, len(key) + 1):
            if i < len(key) and key[i] == key[at]:
                continue
            if kept_key == key[at]:
                for name, values in columns.items():
                    kept[name] += values[at:i]
            else:
                if kept_key is not None:
                    yield kept
                kept, kept_key = {name: values[at:i] for name, values in columns.items()}, key[at]
            at = i
    if kept_key is not None:
        yield kept


_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}


def _batches(rows: Iterator[tuple], schema: str, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of a schema given as DDL."""
    fields = [f.split() for f in schema.split(", ")]
    while some := list(islice(rows, most)):
        columns = zip(*some, strict=True)
        arrays = [pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


_ROLE = {name: i for i, name in enumerate(STATES) if i}
RESULT = (
    "conv_id long, part long, turns_in long, turns_out long, cost long, merges long, relabels long, "
    "insertions long, text string"
)


_ORDER = ("turn", "role", "text")


def numbered(rows: DataFrame, part: int) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with part: their place in the conversation divided by ``part``.

    A conversation of up to ``part`` turns is part 0. The turns of longer ones are
    dealt by range and sorted; a turn's place is its place in its range and what
    stands before that range, so no task holds a conversation, be its turns
    numbered, without a number or all alike.
    """
    turns = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part)
    # A struct is never null, so a null conv_id is found like others.
    long = cut(turns.select(F.struct("conv_id").alias("c")))
    keyed = rows.withColumn("c", F.struct("conv_id"))
    zero = F.lit(0).cast("long")
    if long.isEmpty():
        return rows.withColumn("part", zero)
    short = keyed.join(long, "c", "left_anti").drop("c").withColumn("part", zero)
    most = keyed.join(long, "c").drop("c").withColumn("any", F.monotonically_increasing_id())
    order = ["conv_id", *_ORDER, "any"]
    dealt = most.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumns({"range": F.spark_partition_id(), "at": F.monotonically_increasing_id()}).drop("any"))
    counts = dealt.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    ahead = F.sum("n").over(W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(F.struct("conv_id", "range").alias("r"), (F.coalesce(ahead, zero) - F.col("first")).alias("shift"))
    placed = dealt.withColumn("r", F.struct("conv_id", "range")).join(counts, "r")
    placed = placed.withColumn("part", F.floor((F.col("at") + F.col("shift")) / part).cast("long"))
    return short.unionByName(placed.select(*short.columns))


def repair(turns: DataFrame, part: int = PART) -> DataFrame:
    """Conversations with the cheapest legal roles, rendered.

    ``turns`` has conv_id, turn, role and text. Legal: an optional system turn,
    then user and assistant in turn, ending with assistant. A turn is kept, merged
    into the one before (cost 1), given another role (cost 2, also what an unknown
    or null role costs), or preceded by an empty turn (cost 3 each); the sum is
    least. Ties go to the smaller role at the end of a part, then at the earliest
    turn. One row for each conversation of up to ``part`` turns, however they are
    numbered; one for each ``part`` turns of a longer one, to be read in order of
    part: costs of parts are combined as min-plus matrices, so no task holds more
    turns than that.

    Null conv_id: one conversation of its own. Null turn: before the others. Equal
    turns stand in order of role, then text; repeated rows are repeated turns. Null
    text: empty; a text of any length is one turn's. Extra columns are left out. No
    rows: no rows.
    """
    small_batches(turns.sparkSession)
    rows = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.trim(F.lower(F.col("role").cast("string"))).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = numbered(rows, part)
    rows = rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text")

    way_schema = "conv_id long, part long, way array<double>"
    plan_schema = "conv_id long, part long, entry int, leave int, last boolean"

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list[float]] = {}

        def rows_of() -> Iterator[tuple]:
            for run in _runs(batches, ["conv_id", "part"]):
                roles = tuple(_ROLE.get(r, 0) for r in run["role"])
                way = known.get(roles)
                if way is None:
                    way = through(list(roles)).ravel().tolist()
                    if len(roles) <= 16 and len(known) < 100_000:
                        known[roles] = way
                yield run["conv_id"][0], run["part"][0], way

        return _batches(rows_of(), way_schema)

    def plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[tuple]:
            for run in _runs(batches, ["conv_id"]):
                found = plan([np.array(w, float).reshape(4, 4) for w in run["way"]])
                for i, (entry, leave) in enumerate(found):
                    yield run["conv_id"][i], run["part"][i], entry, leave, i + 1 == len(found)

        return _batches(rows_of(), plan_schema)

    ways = rows.select("conv_id", "part", "role").mapInArrow(matrices, way_schema)
    ways = ways.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    plan_of = ways.mapInArrow(plans, plan_schema)
    # A struct is never null, so a null conv_id joins like others.
    key = F.struct("conv_id", "part")
    joined = rows.withColumn("k", key).join(plan_of.select(key.alias("k"), "entry", "leave", "last"), "k").drop("k")
    joined = joined.sortWithinPartitions("conv_id", "part", "turn", "role", "text")

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[tuple]:
            for run in _runs(batches, ["conv_id", "part"]):
                roles = [_ROLE.get(r, 0) for r in run["role"]]
                text, done = render(roles, run["text"], run["entry"][0], run["leave"][0], run["last"][0])
                yield run["conv_id"][0], run["part"][0], len(roles), *done.values(), text

        return _batches(rows_of(), RESULT, 200)

    return joined.mapInArrow(rendered, RESULT)


def to_messages(text: str) -> list[tuple[str, str]]:
    """(role, text) of a rendered conversation: the inverse of ``render``."""
    out = []
    for piece in text.split(_CLOSE)[:-1]:
        role, _, body = piece.removeprefix("<|im_start|>").partition("\n")
        out.append((role, body))
    return out


def to_json(text: str) -> str:
    return json.dumps([{"role": r, "content": t} for r, t in to_messages(text)], ensure_ascii=False)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, repaired and rendered."""
    return repair(table(spark, sf_dir, "conversations"))
