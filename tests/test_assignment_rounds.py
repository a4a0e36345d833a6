"""Greedy assignment by rounds of joins gives what choosing one candidate after the other gives."""

import random

from pyspark.sql.group import GroupedData

from seqloom.operators import graph


def one_by_one(edges):
    left, out = {}, set()
    for r, c in edges:
        left.setdefault(c, set()).add(r)
    while left:
        best = min(left, key=lambda c: (-len(left[c]), c))
        reads = left.pop(best)
        out |= {(r, best) for r in reads}
        left = {c: x - reads for c, x in left.items() if x - reads}
    return out


def test_rounds_equal_one_by_one(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("a component in one group")

    monkeypatch.setattr(GroupedData, "applyInPandas", refuse)
    rng = random.Random(4)
    edges = {(f"r{rng.randrange(60)}", f"c{rng.randrange(25)}") for _ in range(200)}
    got = [tuple(r) for r in graph.greedy_assignment(spark.createDataFrame(sorted(edges), "read string, candidate string")).collect()]
    assert len(got) == len(set(got)) and set(got) == one_by_one(edges)
    assert graph.greedy_assignment(spark.createDataFrame([], "read string, candidate string")).count() == 0
