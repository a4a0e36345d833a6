"""Qualities in the tests, unchanged tests, outputs of every step, limits of the search."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom import __main__ as cli
from seqloom.functions import sequences as S
from seqloom.functions import variants as V
from seqloom.operators import neighbors
from seqloom.plans import pipeline as P


def family(n=20, quality=40):
    rng = random.Random(4)
    base = "".join(rng.choice("ACGT") for _ in range(100))
    other = base[:50] + ("A" if base[50] != "A" else "C") + base[51:]
    rows = []
    for i in range(n):
        s, q = list(base if i < n // 2 else other), [quality] * 100
        if i % 4 == 0:
            at = rng.randrange(10, 40)
            s[at], q[at] = rng.choice("ACGT"), 5
        rows.append((f"r{i}", "".join(s), q))
    return base, other, rows


def test_places_of_qualities():
    assert V.qualities_at("AC-GT", "ACTG-", [1, 2, 3, 4], [0, 1, 2, 3, 4]) == [1, 2, 4, 4, 4]
    assert V.qualities_at("ACGT", "A--T", [7, 9], [0, 1, 2, 3]) == [7, 9, 9, 9]


def test_consensus_coordinate(spark):
    row = spark.createDataFrame([("AC-G", "TTACGTT", 2), ("AC", "TTAC", 2), ("GG", "TTAC", 0)], "r string, f string, at int")
    assert [r[0] for r in row.select(S.consensus_coordinate("r", "f", "at")).collect()] == [4, 3, None]


def test_qualities_recover_a_family(spark):
    base, other, rows = family()
    reads = spark.createDataFrame(rows, "acc string, seq string, phred array<int>")
    candidates = spark.createDataFrame([("a", base, 10), ("b", other, 10)], "acc string, seq string, support int")
    steps = []
    final, assignment = P.stat_filter(reads, candidates, on_step=lambda name, table: steps.append((name, table.count())))
    assert {r["seq"] for r in final.collect()} == {base, other} and assignment.count() == len(rows)
    names = [n for n, _ in steps]
    assert names[0] == "preprocessed_candidates" and "p_values_0" in names and "candidates_after_step_0" in names and "remaining_to_align" in names


def test_low_qualities_explain_a_variant(spark):
    base, other, rows = family()
    edges = spark.createDataFrame([("b", "a")], "candidate string, reference string")
    candidates = spark.createDataFrame([("a", base, 10), ("b", other, 10)], "acc string, seq string, support int")
    p = {}
    for q in (5, 40):
        reads = spark.createDataFrame([(a, s, [q] * 100) for a, s, _ in rows], "acc string, seq string, phred array<int>")
        assignment = spark.createDataFrame([(a, "a" if i < 10 else "b") for i, (a, _, _) in enumerate(rows)], "read string, candidate string")
        aligned = P.read_alignments(assignment, reads, candidates, P.Parameters())
        p[q] = P.edge_tests(edges, candidates, aligned).first()["p_value"]
    assert p[40] < p[5]


def test_unchanged_tests_are_kept(spark):
    pairs = spark.createDataFrame([("a", "b"), ("c", "b")], "candidate string, reference string")
    aligned = lambda more: spark.createDataFrame([("r1", "a"), ("r2", "b"), ("r3", "c"), *more], "read string, candidate string")
    first, same = P.tested_anew(pairs, P.members_of(aligned([])), None)
    assert first.count() == 2 and same is None
    results = first.withColumn("corrected", F.lit(0.5))
    again, same = P.tested_anew(pairs, P.members_of(aligned([("r4", "a")])), results)
    assert [r["candidate"] for r in again.collect()] == ["a"] and [r["candidate"] for r in same.collect()] == ["c"]


def test_nearest_by_length(spark):
    targets = [f"{'ACGT' * 9}"[:n] for n in range(1, 31)]
    queries = ["ACGTACGTACG", "TTTTT", "A"]
    frame = lambda rows: spark.createDataFrame([(r,) for r in rows], "seq string")
    got = {(r["q"], r["t"]) for r in neighbors.nearest_by_length(frame(queries), frame(targets), 10).collect()}
    every = {(r["q"], r["t"]) for r in neighbors.nearest_by_length(frame(queries), frame(targets), 80).collect()}
    assert every == {(r["q"], r["t"]) for r in neighbors.nearest(frame(queries), frame(targets), False).collect()}
    assert ("ACGTACGTACG", "ACGTACGTACG") in got and ("A", "A") in got


@pytest.mark.parametrize("cleanup", [False, True])
def test_command_line(spark, tmp_path, cleanup):
    base, other, rows = family()
    (tmp_path / "r.fa").write_text("".join(f">{a}\n{s}\n" for a, s, _ in rows))
    (tmp_path / "c.fa").write_text(f">transcript_0_support_10\n{base}\n>transcript_1_support_10\n{other}\n")
    out = tmp_path / "out"
    cli.main(["stat_filter", "--reads", str(tmp_path / "r.fa"), "--candidates", str(tmp_path / "c.fa"), "--out", str(out), "--verbose", *(["--cleanup"] if cleanup else [])])
    assert (out / "final_candidates.fa").exists() and (out / "p_values.tsv").exists()
    assert (out / "steps" / "p_values_0.tsv").exists() is not cleanup
