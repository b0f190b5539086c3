"""Partition programs of the two algorithms: a local fixpoint before any message."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd

from partgraph.functions.programs import Context, PartitionProgram
from partgraph.graph import UNREACHED

_UNKNOWN = np.iinfo(np.int64).max


class DisjointSets:
    """Disjoint sets over 0..n-1 with a least value each, on arrays.

    All links are made at once: roots hook onto smaller roots, then every path is
    halved until it is flat; a few rounds suffice however long the chains are.
    """

    def __init__(self, values: np.ndarray):
        self.parent = np.arange(len(values))
        self.values = values

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.parent[a], self.parent[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))
            self._flatten()

    def _flatten(self) -> None:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return
            self.parent = up

    def least(self) -> np.ndarray:
        """For each member the least value of its set."""
        out = self.values.copy()
        np.minimum.at(out, self.parent, self.values)
        return out[self.parent]


def _local(batches: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray] | None:
    frames = [b for b in batches if len(b)]
    if not frames:
        return None
    rich = pd.concat(frames, ignore_index=True)
    ids, codes = np.unique(np.concatenate([rich["src_id"].to_numpy(), rich["dst_id"].to_numpy()]), return_inverse=True)
    return rich, ids, codes[: len(rich)], codes[len(rich) :]


class ComponentsKernel(PartitionProgram):
    """Union-find over the partition's edges; tells each vertex the least value of its local component.

    A target that is no source here is of unknown value and always told. Edges are
    taken as undirected, so the graph must hold both directions.
    """

    message_type = "long"
    chained = True

    def process(self, batches: Iterator[pd.DataFrame], context: Context) -> Iterator[pd.DataFrame]:
        local = _local(batches)
        if local is None:
            return
        rich, ids, src, dst = local
        known = np.full(len(ids), _UNKNOWN)
        known[src] = rich["src_value"].to_numpy()
        sets = DisjointSets(known)
        sets.union(src, dst)
        least = sets.least()
        tell = least != known
        yield pd.DataFrame({"id": ids[tell], "msg": least[tell]})


class ShortestPathsKernel(PartitionProgram):
    """Dijkstra from all reached sources of the partition; tells each vertex a distance that beats what is known here."""

    message_type = "double"
    chained = True

    def process(self, batches: Iterator[pd.DataFrame], context: Context) -> Iterator[pd.DataFrame]:
        local = _local(batches)
        if local is None:
            return
        rich, ids, src, dst = local
        weight = rich["edge_value"].to_numpy(dtype=float)
        if (weight < 0).any():
            raise ValueError("negative edge value: the kernel settles each vertex once; use native mode")
        known = np.full(len(ids), UNREACHED)
        known[src] = rich["src_value"].to_numpy(dtype=float)
        order = np.argsort(src, kind="stable")
        bounds = np.searchsorted(src[order], np.arange(len(ids) + 1)).tolist()
        to, cost = dst[order].tolist(), weight[order].tolist()
        distance = known.tolist()
        heap = [(d, v) for v, d in enumerate(distance) if d < UNREACHED]
        heapq.heapify(heap)
        while heap:
            d, v = heapq.heappop(heap)
            if d > distance[v]:
                continue
            for k in range(bounds[v], bounds[v + 1]):
                new = d + cost[k]
                if new < distance[to[k]]:
                    distance[to[k]] = new
                    heapq.heappush(heap, (new, to[k]))
        found = np.array(distance)
        tell = found < known
        yield pd.DataFrame({"id": ids[tell], "msg": found[tell]})
