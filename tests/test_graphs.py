"""Graphs, supersteps, the iteration and its errors on graphs small enough to write down."""

import random

import pytest
from pyspark.sql import functions as F

from partgraph.functions.kernels import ComponentsKernel, DisjointSets
from partgraph.functions.programs import MIN, NativeProgram, PartitionProgram, VertexUpdate
from partgraph.graph import UNREACHED, Graph
from partgraph.operators import superstep
from partgraph.operators.algorithms import ConnectedComponents, ShortestPaths
from partgraph.plans.iterate import iterate
from partgraph.plans.lineage import cut
from partgraph.plans.placement import Hashed
from partgraph.sources.edge_list import read_edges, write_vertices
from partgraph.sources.examples import odd_even

TEN = ([(i, i) for i in range(1, 11)], [(1, 2, 1), (2, 3, 1), (3, 1, 1), (3, 4, 1), (5, 6, 1), (7, 6, 1)])
TEN_RESULT = {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5, 8: 8, 9: 9, 10: 10}
PATHS = [(1, 2, 4.0), (1, 3, 1.0), (3, 2, 2.0), (2, 4, 5.0), (5, 1, 1.0)]
MODES = ["kernel", "native", "star"]


def values(frame):
    return {r["id"]: r["value"] for r in frame.collect()}


@pytest.fixture(scope="module")
def ten(spark):
    return Graph.from_rows(spark, *TEN)


@pytest.mark.parametrize("mode", MODES)
def test_components_of_the_example(ten, mode):
    assert values(ConnectedComponents(10, mode).run(ten)) == TEN_RESULT


@pytest.mark.parametrize("parts", [1, 12])
def test_odd_even(spark, parts):
    n, rng = 40, random.Random(0)
    edges = [(i - 2, i) for i in range(3, n + 1)]
    for _ in range(30):
        a = rng.randint(1, n)
        b = rng.choice([x for x in (a, a - 2, a + 2, a + 10) if 1 <= x <= n])
        edges.append((a, b))
    g = Graph.from_rows(spark, [(i, i) for i in range(1, n + 1)], edges, edge_value=None)
    found = values(ConnectedComponents(5000, "kernel", parts).run(g))
    assert found == {i: 1 if i % 2 else 2 for i in range(1, n + 1)}


def test_star_mode_on_a_chain(spark):
    n = 100
    g = Graph.from_rows(spark, [(i, -i) for i in range(n)], [(i, i + 1) for i in range(n - 1)], edge_value=None)
    assert set(values(ConnectedComponents(64, "star").run(g)).values()) == {-(n - 1)}


def test_components_take_the_least_value_not_id(spark):
    g = Graph.from_rows(spark, [(1, 30), (2, 10), (3, 20)], [(1, 2, 1), (2, 3, 1)])
    for mode in MODES:
        assert values(ConnectedComponents(10, mode).run(g)) == {1: 10, 2: 10, 3: 10}


def test_one_partition_needs_two_supersteps(ten):
    r = ConnectedComponents(10, "kernel", 1).result(ten)
    assert r.converged and r.supersteps == 2


@pytest.mark.parametrize("mode", ["kernel", "native"])
def test_truncated_runs_only_fall(spark, mode):
    n = 12
    g = Graph.from_rows(spark, [(i, i) for i in range(n)], [(i, i + 1) for i in range(n - 1)], edge_value=None)
    before = {i: i for i in range(n)}
    for rounds in (1, 2, 3):
        r = ConnectedComponents(rounds, mode).result(g)
        now = values(r.vertices)
        assert all(0 <= now[i] <= before[i] for i in now)
        before = now


@pytest.mark.parametrize("mode", ["kernel", "native"])
def test_shortest_paths(spark, mode):
    g = Graph.from_rows(spark, [(i, 7.0) for i in range(1, 7)], PATHS, "double", "double")
    found = values(ShortestPaths(1, 20, mode).run(g))
    assert found == {1: 0.0, 2: 3.0, 3: 1.0, 4: 8.0, 5: UNREACHED, 6: UNREACHED}
    assert set(values(ShortestPaths(99, 20, mode).run(g)).values()) == {UNREACHED}


def test_shortest_paths_equal_on_random_graphs(spark):
    for seed in (1,):
        rng = random.Random(seed)
        edges = [(rng.randrange(15), rng.randrange(15), float(rng.randrange(1, 9))) for _ in range(40)]
        g = Graph.from_rows(spark, [(i, 0.0) for i in range(15)], edges, "double", "double")
        best = {i: UNREACHED for i in range(15)} | {0: 0.0}
        for _ in range(30):
            for a, b, w in edges:
                if best[a] < UNREACHED:
                    best[b] = min(best[b], best[a] + w)
        for mode in ("kernel", "native"):
            assert values(ShortestPaths(0, 50, mode, 3).run(g)) == best


def test_negative_weights(spark):
    g = Graph.from_rows(spark, [(i, 0.0) for i in range(3)], [(0, 1, 5.0), (0, 2, 2.0), (1, 2, -4.0)], "double", "double")
    assert values(ShortestPaths(0, 9, "native").run(g)) == {0: 0.0, 1: 5.0, 2: 1.0}
    with pytest.raises(Exception, match="negative edge value"):
        ShortestPaths(0, 9, "kernel").run(g)


def test_building(spark, ten):
    e = spark.createDataFrame([(1, 2), (2, 2), (1, 2)], "a int, b int")
    g = Graph.from_edges(e, lambda i: i * 10)
    assert values(g.vertices) == {1: 10, 2: 20}
    assert [f.dataType.simpleString() for f in g.edges.schema] == ["bigint", "bigint"]
    assert g.undirected().edges.count() == 6
    assert ten.without_edge_values().edges.columns == ["src", "dst"]
    assert values(ten.map_vertices(lambda i, v: i + v).vertices)[3] == 6
    assert {r["value"] for r in ten.map_edges(lambda s, d, v: s + d + v).edges.collect()} == {4, 6, 5, 8, 12, 14}
    assert ten.transform(lambda g, k: g.map_vertices(lambda i, v: v + k), 5).vertices.agg(F.min("value")).first()[0] == 6
    s = Graph.from_frames(spark.createDataFrame([("a", 1)], "k string, v long"), spark.createDataFrame([("a", "a")], "x string, y string"))
    assert values(ConnectedComponents(3, "native").run(s)) == {"a": 1}


def test_integrity(spark):
    missing = Graph.from_rows(spark, [(1, 1)], [(1, 2)], edge_value=None)
    for mode in ("kernel", "native"):
        with pytest.raises(Exception, match="no vertex: 2"):
            ConnectedComponents(3, mode).run(missing)
    with pytest.raises(ValueError, match="no vertex"):
        ConnectedComponents(3, "star").run(missing)
    directed = Graph.from_rows(spark, [(1, 0.0)], [(2, 1, 1.0)], "double", "double")
    assert values(ShortestPaths(1, 3, "native").run(directed)) == {1: 0.0}
    with pytest.raises(ValueError, match="repeated vertex id 1"):
        ConnectedComponents(3).run(Graph.from_rows(spark, [(1, 1), (1, 2)], [], edge_value=None))
    with pytest.raises(ValueError, match="null vertex id"):
        ConnectedComponents(3).run(Graph.from_rows(spark, [(None, 1)], [], edge_value=None))
    with pytest.raises(ValueError, match="null edge end"):
        ConnectedComponents(3).run(Graph.from_rows(spark, [(1, 1)], [(1, None)], edge_value=None))
    with pytest.raises(ValueError, match="max_iterations"):
        ConnectedComponents(0).run(Graph.from_rows(spark, [(1, 1)], [], edge_value=None))


def test_loops_parallel_edges_and_no_edges(spark):
    g = Graph.from_rows(spark, [(1, 1), (2, 2), (3, 3)], [(1, 1), (2, 3), (2, 3)], edge_value=None)
    empty = Graph.from_rows(spark, [], [], edge_value=None)
    for mode in MODES:
        assert values(ConnectedComponents(9, mode).run(g)) == {1: 1, 2: 2, 3: 2}
        assert values(ConnectedComponents(9, mode).run(empty)) == {}


def test_range_placement_needs_few_supersteps_on_a_chain(spark):
    n = 100
    g = Graph.from_rows(spark, [(i, i) for i in range(n)], [(i, i + 1) for i in range(n - 1)], edge_value=None)
    r = ConnectedComponents(5000, "kernel", 4, "range").result(g)
    assert set(values(r.vertices).values()) == {0} and r.supersteps <= 6
    # Shortest paths see the edges of active vertices only, so they go one partition, then a step at a time.
    paths = Graph.from_rows(spark, [(i, 0.0) for i in range(8)], [(i, i + 1, 1.0) for i in range(7)], "double", "double")
    assert values(ShortestPaths(0, 50, "kernel", 2, "range").run(paths)) == {i: float(i) for i in range(8)}
    native = ConnectedComponents(9, "native", 4, "range").run(Graph.from_rows(spark, *TEN))
    assert values(native) == TEN_RESULT
    with pytest.raises(ValueError, match="integer ids"):
        s = Graph.from_frames(spark.createDataFrame([("a", 1)], "k string, v long"), spark.createDataFrame([("a", "a")], "x string, y string"))
        ConnectedComponents(3, "kernel", 2, "range").run(s)


@pytest.mark.parametrize("placement", ["hash", "range"])
def test_hubs_are_split(spark, placement):
    leaves = list(range(1, 60))
    edges = [(0, i) for i in leaves] + [(i, 0) for i in leaves] + [(i, i + 100) for i in leaves[:5]] + [(i + 100, i) for i in leaves[:5]]
    ids = [0, *leaves, *(i + 100 for i in leaves[:5])]
    g = Graph.from_rows(spark, [(i, i + 7) for i in ids], edges, edge_value=None)
    for program in (NativeProgram(lambda v, _: v), ComponentsKernel()):
        r = iterate(g, program, MIN, 20, 4, placement=placement, hub_degree=20)
        assert values(r.vertices) == {i: 7 for i in ids} and r.converged


def test_odd_even_at_full_size(spark):
    want = {i: 1 if i % 2 else 2 for i in range(1, 5001)}
    assert values(ConnectedComponents(5000, "kernel", 4, "range").run(odd_even(spark))) == want


def test_a_superstep_shuffles_only_messages(spark, ten):
    with_off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in with_off}
    for k, v in with_off.items():
        spark.conf.set(k, v)
    try:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        edges = Hashed(parts).edges(ten.undirected().edges).persist()
        state = cut(Hashed(parts).vertices(ten.vertices))
        edges.count(), state.count()
        msgs = superstep.messages(superstep.expand(state, edges), NativeProgram(lambda v, _: v), 1)
        plan = superstep.combine(msgs, state, MIN)._jdf.queryExecution().executedPlan().toString()
        body = "\n".join(x for x in plan.split("\n") if "REPARTITION_BY_NUM" not in x)
        assert body.count("Exchange hashpartitioning") == 1
        # The messages' aggregate is sorted for its join; neither edges nor state are sorted again.
        above = body.split("InMemoryTableScan")[0]
        assert above.count("Sort [") == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(Exception, match="no vertex"):
        ConnectedComponents(3, "native", 7).run(Graph.from_rows(spark, [(1, 1)], [(1, 2)], edge_value=None))
    assert before == (spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions"))


class Hop(PartitionProgram):
    """Sends each value on, and its hooks leave a trace in what is sent."""

    def init(self, context):
        self.base = 1000

    def pre_superstep(self, context):
        self.step = context.superstep

    def process(self, batches, context):
        for b in batches:
            yield b.assign(id=b["dst_id"], msg=b["src_value"] + getattr(self, "base", 0) + self.step)[["id", "msg"]]


class Sum(VertexUpdate):
    def update(self, vertex_id, value, messages):
        first = next(messages)
        self.set_new_value(first)


def test_hooks_and_same_superstep_delivery(spark):
    g = Graph.from_rows(spark, [(1, 5), (2, 0), (3, 0)], [(1, 2), (2, 3)], edge_value=None)
    assert values(iterate(g, Hop(), Sum(), 1).vertices) == {1: 5, 2: 1006, 3: 1001}
    assert values(iterate(g, Hop(), Sum(), 2).vertices) == {1: 5, 2: 1006, 3: 1008}


class Twice(VertexUpdate):
    def update(self, vertex_id, value, messages):
        self.set_new_value(1)
        self.set_new_value(1)


class Same(VertexUpdate):
    def update(self, vertex_id, value, messages):
        self.set_new_value(value)


def test_set_new_value(spark):
    g = Graph.from_rows(spark, [(1, 5), (2, 0)], [(1, 2), (2, 1)], edge_value=None)
    program = NativeProgram(lambda v, _: v)
    with pytest.raises(Exception, match="once per update"):
        iterate(g, program, Twice(), 3)
    r = iterate(g, program, Same(), 3)
    assert r.supersteps == 3 and not r.converged  # a set value is active, equal or not


def test_disjoint_sets():
    import numpy as np

    d = DisjointSets(np.array([5, 4, 3, 2, 9]))
    d.union(np.array([0, 1]), np.array([1, 2]))
    assert d.least().tolist() == [3, 3, 3, 2, 9]


def test_edge_lists(spark, tmp_path):
    (tmp_path / "two.txt").write_text("% bip\n1 2\n2 3\n")
    (tmp_path / "three.txt").write_text("% bip\n1 2 4.5\n2 3 1\n")
    assert read_edges(spark, str(tmp_path / "two.txt")).collect() == [(1, 2), (2, 3)]
    rows = read_edges(spark, str(tmp_path / "three.txt"), weighted=True)
    assert rows.collect() == [(1, 2, 4.5), (2, 3, 1.0)]
    for bad in ("x 3 1.0", "4 5 abc", "6 7", "6"):
        (tmp_path / "bad.txt").write_text(f"1 2 4.5\n{bad}\n")
        with pytest.raises(Exception, match="this line is no edge: " + bad):
            read_edges(spark, str(tmp_path / "bad.txt"), weighted=True).collect()
    g = Graph.from_edges(rows, lambda i: i)
    write_vertices(g.vertices.coalesce(1), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), sep=" ").count() == 3


class Shorter(VertexUpdate):
    def update(self, vertex_id, value, messages):
        best = min(messages)
        if best < value:
            self.set_new_value(best)


@pytest.mark.parametrize("rule", [MIN, Shorter()])
def test_estimates_do_not_grow_with_supersteps(spark, rule):
    """A checkpoint keeps the planner's estimate; as a product of joins its digits doubled each superstep until planning took minutes."""
    n, limit = 14, 9
    g = Graph.from_rows(spark, [(i, i) for i in range(n)], [(i, i + 1) for i in range(n - 1)], edge_value=None)
    program = NativeProgram(lambda v, _: v)
    r = iterate(g, program, rule, limit, 2)
    assert values(r.vertices) == {i: max(i - limit, 0) for i in range(n)} and (r.supersteps, r.converged) == (limit, False)
    assert int(r.vertices._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1_000_000


def test_supersteps_are_counted_within_a_chain(spark):
    paths = Graph.from_rows(spark, [(i, 0.0) for i in range(12)], [(i, i + 1, 1.0) for i in range(11)], "double", "double")
    for most, want in ((50, (12, True)), (12, (12, True)), (11, (11, False)), (3, (3, False))):
        r = ShortestPaths(0, most, "native", 2).result(paths)
        assert (r.supersteps, r.converged) == want
        assert values(r.vertices) == {i: float(i) if i <= most else UNREACHED for i in range(12)}
