"""Nearest neighbours in trees of what targets begin with, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import distance as D
from seqloom.operators import neighbors


def reads(seed, many, start=""):
    """Some short sequences, and others up to five edits away."""
    rng = random.Random(seed)
    out = {start + "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 24))) for _ in range(6)}
    while len(out) < many:
        s = list(rng.choice(sorted(out)))
        for _ in range(rng.randint(1, 5)):
            at = rng.randint(min(len(start), len(s)), len(s))
            s[at : at + rng.randint(0, 1)] = rng.choice(["", "A", "C", "G", "é"])
        out.add("".join(s))
    return rng.sample(sorted(out), many)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def by_all_pairs(queries, targets, self_join, most):
    found = set()
    for q in queries:
        near = [(distance(q, t), t) for t in targets if not (self_join and q == t)]
        near = [(d, t) for d, t in near if d <= min(most, len(q))]
        found |= {(q, t, d) for d, t in near if d == min(near)[0]}
    return found


@pytest.mark.parametrize("front", [3, 1 << 20])
@pytest.mark.parametrize("self_join", [True, False])
def test_near_in_tree(front, self_join, monkeypatch):
    monkeypatch.setattr(D, "FRONT", front)
    for seed in range(4):
        targets = reads(seed, 40)
        queries = targets[:20] if self_join else reads(seed + 9, 20)
        for most in (1, 2, 4):
            got = [(queries[i], targets[k], d) for i, k, d in zip(*(x.tolist() for x in D.near_in_tree(queries, targets, most, self_join)), strict=True)]
            assert len(set(got)) == len(got)
            assert set(got) == by_all_pairs(queries, targets, self_join, most)


@pytest.mark.parametrize("self_join", [True, False])
def test_nearest_in_several_trees(spark, self_join, monkeypatch):
    """Near reads are found in trees, whatever tree they are in; only what has no neighbour within four edits goes in blocks."""
    monkeypatch.setattr(neighbors, "TREE", 40)
    monkeypatch.setattr(neighbors, "GOING", 50)
    rng = random.Random(3)
    start = "".join(rng.choice("ACGT") for _ in range(30))
    alone = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(3)]
    long = ["".join(rng.choice("ACGT") for _ in range(300))]
    long += [long[0][:20] + long[0][22:], long[0] + "A"]
    targets = reads(1, 100, start) + alone + long
    queries = targets if self_join else [q for q in reads(2, 60, start) + [alone[0][2:] + "ACGT"] + [long[1][1:]] if q]
    blocks, far = [], neighbors._far
    monkeypatch.setattr(neighbors, "_far", lambda left, *rest: blocks.append({r["seq"] for r in left.collect()}) or far(left, *rest))
    frame = lambda seqs: spark.createDataFrame([(s,) for s in seqs], "seq string")
    got = [tuple(r) for r in neighbors.nearest(frame(queries), frame(targets), self_join).select("q", "t", F.col("ed").cast("int")).collect()]
    assert len(set(got)) == len(got)
    assert set(got) == by_all_pairs(queries, targets, self_join, 10**9)
    near = {q for q, _, d in got if d <= 4}
    assert len(near) > 20 and not near & blocks[0]
