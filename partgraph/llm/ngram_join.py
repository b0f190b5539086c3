"""N-gram Jaccard join by prefix trees (operator 10)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partgraph.llm.common import (
    NONSPACE, cut, distinct_shingles, documents, kept_while, mix, release, row_key, skew_join, text_blocks, unused, utf8_column, with_text,
)
from partgraph.operators.star_components import star_components
from partgraph.plans.lineage import measured_cut

#: Slots of the fixed-size count sketch that orders shingles, and its slices.
SKETCH, SLICES = 1 << 18, 16
#: Sets of up to so many bytes meet in one prefix tree.
BLOCK = 8 << 20
#: Shingles that a pair must share in its prefixes, and one more for each LONGER of a set;
#: a shingle of more different sets than FEW links its sets by a star rather than pair by pair.
SHARED, LONGER, FEW = 4, 128, 32
#: A star is gathered in so many parts first, so that the sets of one shingle are not one task.
SALTS = 64
#: Sets that a task remembers, so as to give the shingles of a copy once.
REMEMBERED = 1 << 18


@dataclass(frozen=True)
class Join:
    """Two sets link when 100 * shared >= percent * union; sets are of ``width``-word shingles."""

    width: int = 4
    percent: int = 85

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """How many first shingles of a set share ``_shared`` with those of a linked one (or all that is needed, if less)."""
        return np.minimum(n, n - (self.percent * n + 99) // 100 + _shared(n))

    def needed(self, a, b):
        """The least overlap of linked sets of these sizes."""
        whole = 100 + self.percent
        return (self.percent * (a + b) + whole - 1) // whole

    def split(self, a: Column, b: Column) -> tuple[Column, Column]:
        """(few, many): linked sets of sizes a <= b share so many shingles of few sets in their prefixes, or so many of many sets."""
        whole = 100 + self.percent
        needed = F.floor((self.percent * (a + b) + whole - 1) / whole)
        shared = F.least(SHARED + F.floor(a / LONGER), needed)
        many = F.greatest(F.floor(shared / 2), F.lit(1))
        return shared + 1 - many, many


def _shared(n):
    """What a set of n shingles shares in its prefix with a linked one that is no smaller: long sets share a few by chance."""
    return SHARED + n // LONGER


def _sets(column: pa.Array, width: int):
    for a, b, data, offsets in text_blocks(column):
        bounds, hashes = distinct_shingles(data, offsets, NONSPACE, width)
        yield a, b, bounds, hashes


def _fingerprints(bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """128 bits (two columns) for each set; equal sets have equal ones."""
    n = np.diff(bounds).astype(np.uint64)
    out = np.empty((len(n), 2), np.uint64)
    for i, seed in enumerate((0x51ED270B, 0xB492B66FBE98F273)):
        sums = np.append(np.uint64(0), np.cumsum(mix(hashes ^ np.uint64(seed)), dtype=np.uint64))
        out[:, i] = mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ (n * np.uint64(0x9FB21C651E98DF25)))
    return out


def _binary(fingerprints: np.ndarray) -> pa.Array:
    n = len(fingerprints)
    offsets = pa.py_buffer(np.arange(0, 16 * n + 1, 16, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(fingerprints.tobytes())])


# --- the first pass: sizes, fingerprints, counts ------------------------------

_KEY = "struct<doc_id:long,digest:binary>"
_FIRST = f"k {_KEY}, n long, node binary, half long, slice int, counts binary"


def _describe(docs: DataFrame, join: Join) -> DataFrame:
    """A row (k, n, node, half of it) for each text, and the partition's part of the count sketch in slices."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _FIRST.split(", ")]
        sketch, kind = np.zeros(SKETCH, np.int64), None
        for batch in batches:
            kind = batch.column(0).type
            for a, b, bounds, hashes in _sets(batch.column(1), join.width):
                sketch += np.bincount((hashes >> np.uint64(46)).astype(np.int64), minlength=SKETCH)
                n = pa.array(np.diff(bounds).astype(np.int64))
                nothing = [pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())]
                node = _fingerprints(bounds, hashes)
                columns = [batch.column(0).slice(a, b - a), n, _binary(node), pa.array(node[:, 0].view(np.int64)), *nothing]
                yield pa.RecordBatch.from_arrays(columns, names)
        if sketch.any():
            parts = [zlib.compress(p.tobytes(), 1) for p in sketch.reshape(SLICES, -1)]
            empty = [pa.nulls(SLICES, k) for k in (kind, pa.int64(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names)

    return with_text(docs, row_key().alias("k")).mapInArrow(work, _FIRST)


def _sketch(described: DataFrame) -> np.ndarray:
    """The sum of the sketches: SKETCH counts, of fixed size whatever the input."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in pdf["counts"])
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    parts = described.where(F.col("slice").isNotNull()).select("slice", "counts")
    summed = parts.groupBy("slice").applyInPandas(add, "slice int, counts binary").collect()
    out = np.zeros((SLICES, SKETCH // SLICES), np.int64)
    for r in summed:
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return out.ravel()


def _count(sketch: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return sketch[(hashes >> np.uint64(46)).astype(np.int64)]


# --- candidates -----------------------------------------------------------------


def _prefixes(docs: DataFrame, join: Join, shared: Broadcast) -> DataFrame:
    """(token, node, n): the first shingles of each set in the global order, rare ones first; node is half its fingerprint.

    The order is (count of the sketch slot, hash): the same for all sets, which is
    all that the prefix filter needs; counts only make it selective. Copies that one
    task sees give their shingles once, as far as it remembers.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for batch in batches:
            for _, _, bounds, hashes in _sets(batch.column(0), join.width):
                nodes, n = _fingerprints(bounds, hashes), np.diff(bounds)
                new = np.zeros(len(n), bool)
                for i, node in enumerate(nodes):
                    if n[i] and (raw := node.tobytes()) not in known:
                        known.add(raw)
                        new[i] = True
                if len(known) > REMEMBERED:
                    known.clear()
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((_count(shared.value, hashes), row))  # stable: hashes stand in order already
                place = np.arange(len(hashes)) - bounds[row]
                keep = (place < join.prefix(n)[row]) & new[row]
                owner = row[keep]
                columns = [pa.array(hashes[order][keep].view(np.int64)), pa.array(nodes[owner, 0].view(np.int64)), pa.array(n[owner].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["token", "node", "n"])

    return with_text(docs).mapInArrow(work, "token long, node long, n int")


def _candidates(docs: DataFrame, join: Join, shared: Broadcast) -> DataFrame:
    """(a, b): links, between halves of fingerprints, whose components hold every pair of sets that can link.

    Sets that link share SHARED shingles of their prefixes and more if they are
    long (or all that they need, if less), and their sizes are within the threshold.
    About half of these are shingles of few sets, or the other half are of many
    (``Join.split``). Shingles of few sets are paired out and pairs counted: chance
    pairs share fewer, also of long sets, so they don't tie the corpus together.
    Sets with enough shingles of many sets meet in stars: all such sets of a shingle
    and of one or two neighbouring size classes are linked to the smallest, with one
    row a set; sets with fewer can't share enough and are left out. A star is made
    in two steps, within SALTS parts and between their centres, so that one
    shingle's sets are shared by as many tasks. Prefixes are written once and read
    for counts and rows.
    """
    with kept_while(_prefixes(docs, join, shared), "prefixes") as prefixes:
        tokens = prefixes.groupBy("token").agg(
            F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("rows")
        )
        tokens = tokens.where(F.col("least") != F.col("most")).select("token", (F.col("rows") > FEW).alias("many"))
        rows = cut(skew_join(prefixes, tokens, ["token"]))
    release(docs.sparkSession)
    # Every task gives the sets of its copies again: what counts as many is different sets, or it would grow with the tasks.
    often = rows.where("many").select("token", "node", "n").distinct()
    sets = often.groupBy("token").agg((F.count(F.lit(1)) > FEW).alias("many"))
    often = cut(skew_join(often, sets, ["token"]))
    release(docs.sparkSession)
    few = rows.where(~F.col("many")).unionByName(often.where(~F.col("many")))
    few = few.groupBy("token").agg(F.sort_array(F.collect_set(F.struct("n", "node"))).alias("sets"))
    size = lambda x: x["n"].cast("long")
    fits = lambda x, y: (x["n"] > 0) & (100 * size(x) >= join.percent * size(y))
    later = lambda x, i: F.filter(F.slice("sets", i + 2, F.size("sets")), lambda y: fits(x, y))
    pairs = F.flatten(F.transform("sets", lambda x, i: F.transform(later(x, i), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    met = few.select(F.explode(pairs).alias("p")).groupBy("p.x", "p.y").agg(F.count(F.lit(1)).alias("shared"))
    enough, _ = join.split(size(F.col("x")), size(F.col("y")))
    met = met.where(F.col("shared") >= enough).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    # A set's smallest partner asks for the least.
    _, enough = join.split(F.floor((join.percent * F.col("n").cast("long") + 99) / 100), F.col("n").cast("long"))
    often = often.where("many")
    rich = often.groupBy("node", "n").agg(F.count(F.lit(1)).alias("own")).where(F.col("own") >= enough)
    often = skew_join(often, rich.select("node", "n"), ["node", "n"])
    c = _size_class(F.col("n"), join.percent)
    salt = F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(SALTS)).alias("salt")
    many = often.select("token", "node", salt, F.explode(F.array(c, c + 1)).alias("c"))
    centres = many.groupBy("token", "c", "salt").agg(F.min("node").alias("centre"))
    hubs = centres.groupBy("token", "c").agg(F.min("centre").alias("hub"))
    near = many.join(centres, ["token", "c", "salt"]).select(F.col("node").alias("a"), F.col("centre").alias("b"))
    far = centres.join(hubs, ["token", "c"]).select(F.col("centre").alias("a"), F.col("hub").alias("b"))
    return met.unionByName(near.unionByName(far).where("a != b").distinct())


# --- the prefix tree --------------------------------------------------------------


class PrefixTree:
    """Sets as sequences in the global order, in a compressed trie whose nodes are numbered by level.

    The order is that of the prefix filter turned round, (count of the sketch slot,
    hash) falling, so that what many sets have comes first and similar sets share a
    long way from the root; shingles of one set of the tree only can't be shared
    and are left out, but count in the sizes.
    """

    def __init__(self, sets: list[np.ndarray], join: Join, sketch: np.ndarray | None = None):
        self.join = join
        lengths = np.array([len(s) for s in sets])
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        several = np.flatnonzero(counts > 1)
        weight = np.zeros(len(several), np.int64) if sketch is None else _count(sketch, values[several])
        rank = np.full(len(values), -1, np.int64)
        rank[several[np.lexsort((values[several], weight))[::-1]]] = np.arange(len(several))
        self.n_tokens = len(several)
        tokens, owner = rank[inverse], np.repeat(np.arange(len(sets)), lengths)
        keep = tokens >= 0
        tokens, owner = tokens[keep], owner[keep]
        order = np.lexsort((tokens, owner))
        tokens, owner = tokens[order], owner[order]
        bounds = np.searchsorted(owner, np.arange(len(sets) + 1))
        rows = [tokens[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.order = sorted(range(len(sets)), key=lambda i: rows[i].astype(">u4").tobytes())
        self.rows = [rows[i] for i in self.order]
        self.sizes = lengths[self.order]
        self._build()

    def _build(self) -> None:
        rows, g = self.rows, len(self.rows)
        shared = [0] * (g + 1)
        for i in range(1, g):
            p, q = rows[i - 1], rows[i]
            m = min(len(p), len(q))
            differ = np.flatnonzero(p[:m] != q[:m])
            shared[i] = int(differ[0]) if len(differ) else m
        # Nodes: (depth, first leaf, end leaf); a stack holds the open ones.
        depth, lo, hi, parent = [0], [0], [g], [-1]
        stack = [0]
        for i in range(g):
            last = -1
            while depth[stack[-1]] > shared[i]:
                last = stack.pop()
                hi[last] = i
            if last >= 0 and depth[stack[-1]] < shared[i]:
                depth.append(shared[i])
                lo.append(lo[last])
                hi.append(g)
                parent.append(stack[-1])
                parent[last] = len(depth) - 1
                stack.append(len(depth) - 1)
            if len(rows[i]) > depth[stack[-1]]:
                depth.append(len(rows[i]))
                lo.append(i)
                hi.append(g)
                parent.append(stack[-1])
                stack.append(len(depth) - 1)
        self.depth, self.lo, self.hi = np.array(depth), np.array(lo), np.array(hi)
        self.parent = np.array(parent)
        kids = np.argsort(self.parent, kind="stable")
        self.kids = kids
        self.kid_at = np.searchsorted(self.parent[kids], np.arange(len(depth) + 1))
        start = np.where(self.parent >= 0, self.depth[self.parent], 0)
        labels = [rows[a][s:d] for a, s, d in zip(self.lo, start, self.depth, strict=True)]
        self.label_at = np.append(0, np.cumsum([len(x) for x in labels]))
        self.labels = np.concatenate(labels) if labels else np.zeros(0, np.int64)
        self.last = np.array([x[-1] if len(x) else -1 for x in labels])
        index = np.stack([self.lo, np.maximum(self.hi, self.lo + 1)], axis=1).ravel()
        pad = np.append(self.sizes, self.sizes[-1:])
        self.least = np.minimum.reduceat(pad, index)[::2]
        self.most = np.maximum.reduceat(pad, index)[::2]
        self.longest = np.maximum.reduceat(np.append([len(r) for r in rows], 0), index)[::2]

    def probe(self, leaf: int, alive: np.ndarray) -> np.ndarray:
        """The alive leaves whose sets link with this one's.

        Goes down level by level with the overlap so far of every node reached, and
        leaves out subtrees without alive leaves, with sizes out of reach, or where
        the overlap so far and the shorter remaining length are too little.
        """
        row, size = self.rows[leaf], int(self.sizes[leaf])
        mask = np.zeros(self.n_tokens + 1, np.int64)
        mask[row] = 1
        living = np.append(0, np.cumsum(alive))
        nodes, overlap, found = np.array([0]), np.array([0]), []
        while len(nodes):
            # Sets that end at a node are its first leaves: they have no more tokens than its depth.
            for node, shared in zip(nodes[self._ends(nodes)], overlap[self._ends(nodes)], strict=True):
                leaves = self._ending(node)
                ok = alive[leaves] & (shared >= self.join.needed(size, self.sizes[leaves]))
                found.append(leaves[ok])
            counts = self.kid_at[nodes + 1] - self.kid_at[nodes]
            up = np.repeat(overlap, counts)
            nodes = self.kids[_ranges(self.kid_at[nodes], counts)]
            reach = (living[self.hi[nodes]] > living[self.lo[nodes]]) & (100 * self.most[nodes] >= self.join.percent * size)
            reach &= 100 * size >= self.join.percent * self.least[nodes]
            nodes, up = nodes[reach], up[reach]
            if not len(nodes):
                break
            lengths = self.label_at[nodes + 1] - self.label_at[nodes]
            at = _ranges(self.label_at[nodes], lengths)
            sums = np.append(0, np.cumsum(mask[self.labels[at]]))
            ends = np.cumsum(lengths)
            overlap = up + sums[ends] - sums[ends - lengths]
            left = np.minimum(
                len(row) - np.searchsorted(row, self.last[nodes], "right"), self.longest[nodes] - self.depth[nodes]
            )
            go = overlap + left >= self.join.needed(size, self.least[nodes])
            nodes, overlap = nodes[go], overlap[go]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def _ends(self, nodes: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_own"):
            lengths = np.array([len(r) for r in self.rows])
            self._lengths = lengths
            self._own = lengths[self.lo] == self.depth
        return self._own[nodes]

    def _ending(self, node: int) -> np.ndarray:
        leaves = np.arange(self.lo[node], self.hi[node])
        return leaves[self._lengths[leaves] == self.depth[node]]


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0].., start[1].. : the concatenated ranges."""
    total = int(count.sum())
    before = np.append(0, np.cumsum(count)[:-1])
    return np.arange(total) + np.repeat(start - before, count)


def link_sets(sets: list[np.ndarray], join: Join, sketch: np.ndarray | None = None) -> np.ndarray:
    """For each set the number of one set of its component, the same for all of it."""
    root = np.arange(len(sets))
    if len(sets) < 2:
        return root
    tree = PrefixTree(sets, join, sketch)
    alive = np.ones(len(sets), bool)
    of = np.arange(len(sets))
    # Sets already reached need no further probe against each other: only the
    # components matter, and each set is still probed against all not yet reached.
    for first in range(len(sets)):
        if not alive[first]:
            continue
        alive[first] = False
        queue = [first]
        while queue and alive.any():
            hits = tree.probe(queue.pop(), alive)
            alive[hits] = False
            of[hits] = first
            queue += hits.tolist()
    root[tree.order] = np.array(tree.order)[of]
    return root


# --- the join -----------------------------------------------------------------


def _size_class(n, percent: int):
    """Linked sets are of one size class or of neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / percent)) + F.lit(1e-9))


def _tasks(members: DataFrame, join: Join) -> DataFrame:
    """``members`` (node, comp, n) with the prefix tree each goes to.

    A candidate component that fits in BLOCK bytes is one tree. A larger one is cut
    by size class and then by hash into blocks that fit; each pair of blocks of one
    class or of neighbouring classes is a tree, so that every pair of sets that can
    link meets, and no tree is unbounded.
    """
    sized = members.groupBy("comp").agg(F.sum("n").alias("total"))
    m = members.join(sized, "comp")
    small = m.where(F.col("total") * 8 <= BLOCK)
    small = small.select("node", "comp", F.lit(0).cast("long").alias("tree"), F.lit(True).alias("whole"))
    large = m.where(F.col("total") * 8 > BLOCK).withColumn("c", _size_class(F.col("n"), join.percent))
    blocks = large.groupBy("comp", "c").agg(F.ceil(F.sum("n") * 16 / BLOCK).alias("blocks"))
    near = [(blocks.select("comp", (F.col("c") - k).alias("c"), F.col("blocks").alias(f"b{k + 1}"))) for k in (-1, 0, 1)]
    for other in near:
        large = large.join(other, ["comp", "c"], "left")
    own = F.pmod(F.xxhash64(F.lit(7), "node"), F.col("b1"))
    name = lambda c, a, d, b: F.xxhash64(c, a, d, b)
    c = F.col("c")
    same = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("b1") - 1), lambda t: name(c, F.least(own, t), c, F.greatest(own, t))
    )
    nothing = F.array().cast("array<bigint>")
    up = F.when(
        F.col("b2").isNotNull(),
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("b2") - 1), lambda t: name(c, own, c + 1, t)),
    )
    down = F.when(
        F.col("b0").isNotNull(),
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("b0") - 1), lambda t: name(c - 1, t, c, own)),
    )
    trees = F.array_distinct(F.concat(same, F.coalesce(up, nothing), F.coalesce(down, nothing)))
    large = large.select("node", "comp", F.explode(trees).alias("tree"), F.lit(False).alias("whole"))
    return small.unionByName(large)


def components(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    Sets are of 64-bit hashes of distinct shingles (a text shorter than the width
    is one shingle); a set is known by 128 bits, and equal sets are one node. Every
    pair of nodes that links shares
    one of its first shingles in a global order (the prefix filter, which is exact);
    nodes that share one form a candidate component, found by stars of one link a
    node. Each candidate component, or each pair of blocks of a large one, is a
    prefix tree in which all links are found by overlap of the whole sets. No
    candidate or partner is left out; links between sets of one component that are
    already connected are not looked for again.

    component_id is the smallest doc_id that is reachable. Null and empty texts:
    0 shingles, their own component. A null doc_id takes part, but is nobody's
    smallest. Repeated rows repeat. Extra columns are left out. A long text is
    hashed in pieces; its set is held whole. No rows: no rows.
    """
    named = _rooted(docs, join)
    least = named.where(F.col("n") > 0).groupBy("root").agg(F.min("k.doc_id").alias("least"))
    out = skew_join(named, least, ["root"], "left")
    return out.select(
        "k.doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("k.doc_id")).alias("component_id"),
    )


def _rooted(docs: DataFrame, join: Join) -> DataFrame:
    """(k, n, root): root is the same for the rows of a component, k a row's key."""
    described = cut(_describe(docs, join))
    base = described.where(F.col("slice").isNull()).select("k", "n", "node", "half")
    shared = docs.sparkSession.sparkContext.broadcast(_sketch(described))
    release(docs.sparkSession)
    # Each of its rounds joins twice: only counted sizes keep the planner's numbers from growing fourfold in digits a round.
    comps = star_components(_candidates(docs, join, shared), measured_cut)
    release(docs.sparkSession)
    roots = comps.select(F.col("root").alias("node"), F.col("root").alias("comp")).distinct()
    members = comps.select("node", F.col("root").alias("comp")).unionByName(roots).withColumnRenamed("node", "half")
    # Sets that share half a fingerprint are members both, as nodes of their own from here on.
    chosen = base.where(F.col("n") > 0).groupBy("half", "node", "n").agg(F.min("k").alias("k"))
    members = cut(members.join(chosen, "half").drop("half"))
    verified = cut(_verified(docs, members, join, shared))
    release(docs.sparkSession)
    whole = verified.where("whole").where(F.col("node") != F.col("root")).select("node", "root")
    pieces = verified.where(~F.col("whole"))
    if not pieces.isEmpty():
        edges = pieces.select(F.col("node").alias("a"), F.col("root").alias("b"))
        whole = whole.unionByName(star_components(edges, measured_cut))
    named = base.join(whole, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return named.select("k", "n", "root")


def _verified(docs: DataFrame, members: DataFrame, join: Join, shared: Broadcast) -> DataFrame:
    """(node, root, whole): the components found by the prefix trees."""
    # One text of each member node; equal rows give equal sets, of which a tree takes one.
    keyed = with_text(docs, row_key().alias("k"))
    texts = keyed.join(members.select("k", "node"), "k").select("node", "text")

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, bounds, hashes in _sets(batch.column(1), join.width):
                blobs = [hashes[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                columns = [batch.column(0).slice(a, b - a), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "hashes"])

    sets = texts.mapInArrow(rebuilt, "node binary, hashes binary")
    trees = sets.join(_tasks(members.select("node", "comp", "n"), join), "node")

    def linked(rows: pa.Table) -> pa.Table:
        nodes = rows["node"].to_pylist()
        data, offsets = utf8_column(rows["hashes"])
        first = list({node: i for i, node in enumerate(nodes)}.values())
        sets = [data[offsets[i] : offsets[i + 1]].copy().view(np.uint64) for i in first]
        root = link_sets(sets, join, shared.value)
        whole = rows["whole"][0].as_py() if len(first) else True
        columns = [[nodes[i] for i in first], [nodes[first[r]] for r in root]]
        return pa.table(
            [pa.array(c, pa.binary()) for c in columns] + [pa.array([whole] * len(first), pa.bool_())], ["node", "root", "whole"]
        )

    return trees.groupBy("comp", "tree").applyInArrow(linked, "node binary, root binary, whole boolean")


def keep_one(docs: DataFrame, join: Join = Join(5, 80)) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, then text digest; nulls last.

    Rows are told apart by doc_id and 128 bits of their text. Rows without shingles
    all stay. Columns stay as they are, whatever their names.
    """
    named = cut(_rooted(docs, join)).where(F.col("n") > 0)
    best = F.min(F.struct(F.col("k.doc_id").isNull().alias("none"), F.col("k")))
    kept = named.groupBy("root").agg(best.alias("best")).select("root", F.col("best.k").alias("best"))
    name = unused(docs, "k")
    lost = skew_join(named, kept, ["root"]).where(F.col("k") != F.col("best")).select(F.col("k").alias(name)).distinct()
    keyed = docs.withColumn(name, row_key())
    out = keyed.join(lost, name, "left_anti")
    # Rows equal in doc_id and text have one key; few inputs have any.
    twice = named.groupBy(F.col("k").alias(name)).count().where("count > 1").select(name)
    if not twice.isEmpty():
        again = out.join(twice, name, "left_semi").dropDuplicates([name])
        out = out.join(twice, name, "left_anti").unionByName(again)
    return out.drop(name)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 10 over all documents."""
    return components(documents(spark, sf_dir))


OP10_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i+3], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id
      group by a.doc_id, b.doc_id),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
r(id, label) using key (id) as (
  select doc_id, doc_id from w
  union
  select e.b, min(r.label) from r join e on e.a = r.id join recurring.r q on q.id = e.b
  group by e.b, q.label having min(r.label) < q.label)
select r.id as doc_id, coalesce(n.n, 0)::bigint as n_shingles, r.label as component_id
from r left join n on n.doc_id = r.id
"""
