"""Components, cycles and the greedy partition against the sequential rule."""

import random

import pytest

from seqloom.operators import graph, neighbors
from seqloom.plans import catalog


def greedy_partition(weights, links, by_neighbours):
    """The rule, node after node: (center, member, weight of its part)."""
    left, out = set(weights), []

    def reach(start):
        seen, open_ = {start}, [start]
        while open_:
            for x in links.get(open_.pop(), ()):
                if x in left and x not in seen:
                    seen.add(x)
                    open_.append(x)
        return seen

    while left:
        reached = {x: reach(x) for x in left}
        near = {x: len(links.get(x, set()) & left) for x in left}
        top = min(left, key=lambda x: (-sum(weights[y] for y in reached[x]), -near[x] if by_neighbours else 0, x))
        part = reached[top]
        center = min(part, key=lambda x: (-(weights[x] + near[x]), x))
        out += [(center, x, sum(weights[y] for y in part)) for x in part]
        left -= part
    return out


def made(spark, weights, links, by_neighbours):
    """links: of each node, those that it reaches directly; the operator's edges are the reverse."""
    nodes = spark.createDataFrame(sorted(weights.items()), "node string, degree long")
    edges = spark.createDataFrame([(y, x) for x, ys in links.items() for y in ys], "q string, t string")
    return graph.partition(nodes, edges, by_neighbours)


def random_graph(rng, kind):
    n = rng.randint(2, 24)
    names = [f"{rng.randint(0, 9)}{i:02}" for i in range(n)]
    weights = {x: rng.randint(1, 3) for x in names}
    links = {x: set() for x in names}
    for _ in range(rng.randint(0, 2 * n)):
        a, b = rng.sample(range(n), 2)
        if kind == "acyclic":
            a, b = min(a, b), max(a, b)
        links[names[a]].add(names[b])
        if kind == "both":
            links[names[b]].add(names[a])
    return weights, links


@pytest.mark.parametrize("kind", ["any", "acyclic", "both"])
@pytest.mark.parametrize("by_neighbours", [True, False])
def test_partition_equals_the_sequential_rule(spark, kind, by_neighbours):
    """Many small graphs side by side, told apart by their names, since parts never leave a component."""
    rng = random.Random(f"{kind}{by_neighbours}")
    weights, links, want = {}, {}, []
    for k in range(25):
        w, x = random_graph(rng, kind)
        w, x = {f"{k:02}/{a}": v for a, v in w.items()}, {f"{k:02}/{a}": {f"{k:02}/{b}" for b in v} for a, v in x.items()}
        weights.update(w)
        links.update(x)
        want += [(c, m, total, w[m]) for c, m, total in greedy_partition(w, x, by_neighbours)]
    got = [tuple(r) for r in made(spark, weights, links, by_neighbours).collect()]
    assert sorted(got) == sorted(want)


def test_one_large_component(spark):
    """A long chain that runs through cycles, with a star at its end: no step takes as many rounds as it is long."""
    n, chain = 20_000, 600
    weights = {f"{i:06}": 1 + i % 3 for i in range(n)}
    links = {f"{i:06}": {f"{i + 1:06}"} for i in range(chain)}
    links[f"{chain // 2:06}"].add(f"{chain // 4:06}")
    links[f"{chain:06}"] = {f"{i:06}" for i in range(chain + 1, n)}
    out = made(spark, weights, links, True).collect()
    assert {r["center"] for r in out} == {f"{chain:06}"} and len(out) == n and {r["weight"] for r in out} == {sum(weights.values())}


def test_collapsed_and_edges(spark):
    candidates = spark.createDataFrame([("a", 2), ("b", 5), ("c", 3), ("d", 1)], "acc string, support long")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "b")], "a string, b string")
    assert {tuple(r) for r in graph.collapsed(candidates, pairs).collect()} == {("a", "b"), ("b", "b"), ("c", "b"), ("d", "d")}
    none = graph.partition(spark.createDataFrame([], "node string, degree long"), spark.createDataFrame([], "q string, t string"))
    assert none.collect() == []
    stray = graph.partition(spark.createDataFrame([("x", 2)], "node string, degree long"), spark.createDataFrame([("x", "y"), ("x", "x")], "q string, t string"))
    assert [tuple(r) for r in stray.collect()] == [("x", "x", 2, 2)]


def test_cycles(spark):
    rng = random.Random(8)
    nodes = list(range(120))
    edges = [(rng.randint(0, 119), rng.randint(0, 119)) for _ in range(150)]
    edges += [(i, (i + 1) % 40) for i in range(40) if i != 7]
    to = {x: {y for a, y in edges if a == x} for x in nodes}

    def reach(x):
        seen, open_ = {x}, [x]
        while open_:
            for y in to[open_.pop()] - seen:
                seen.add(y)
                open_.append(y)
        return seen

    reached = {x: reach(x) for x in nodes}
    ids = spark.createDataFrame([(x,) for x in nodes], "id long")
    frame = spark.createDataFrame([e for e in set(edges) if e[0] != e[1]], "x long, y long")
    scc = {r["id"]: r["scc"] for r in graph.cycles(ids, frame).collect()}
    assert len(scc) == 120
    for a in nodes:
        for b in nodes:
            assert (scc[a] == scc[b]) == (b in reached[a] and a in reached[b])


def test_partition_of_the_reads(spark):
    """The registered query against the sequential rule on its own graph."""
    folder = "/root/testdata/sf0.01"
    weights = {r["seq"]: r["degree"] for r in neighbors.distinct_sequences(catalog.short_reads(spark, folder)).collect()}
    links = {}
    for r in catalog.nn_graph(spark, folder).collect():
        links.setdefault(r["t"], set()).add(r["q"])
    got = sorted(tuple(r) for r in catalog.greedy_partition(spark, folder).select("center", "member", "weight", "degree").collect())
    assert got == sorted((c, m, total, weights[m]) for c, m, total in greedy_partition(weights, links, True))
