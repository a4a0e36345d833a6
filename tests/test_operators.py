import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequences as S
from seqloom.operators import graph, neighbors, significance
from seqloom.plans import pipeline as P
from seqloom.plans import power
from seqloom.sources import fasta


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def test_scalars(spark):
    row = one(spark, s="AACCCGT", q="!+5").select(S.homopolymer_compressed("s"), S.reverse_complement("s"), S.phred_values("q"), S.run_ids("s")).first()
    assert list(row) == ["ACGT", "ACGGGTT", [0, 10, 20], [0, 0, 1, 1, 1, 2, 3]]
    with pytest.raises(Exception, match="nucleotide"):
        one(spark, s="AC!").select(S.reverse_complement("s")).collect()
    sorted_ = spark.createDataFrame([("AAC", [30, 10, 20])], "s string, q array<int>").select(S.sorted_within_runs("s", "q")).first()[0]
    assert sorted_ == [10, 30, 20]
    assert one(spark, a="transcript_3_support_12").select(S.support_of("a")).first()[0] == 12
    assert one(spark, a="m1/22/ccs x/y").select(S.read_key("a")).first()[0] == "m1/22"


@pytest.mark.parametrize(("gap", "dropped"), [(19, False), (20, True), (21, True)])
def test_exon_filter(spark, gap, dropped):
    a = "ACGT" * 10 + "-" * gap + "ACGT" * 10
    b = "ACGT" * 10 + "A" * gap + "ACGT" * 10
    assert one(spark, a=a, b=b).select(S.differs_by_exon("a", "b")).first()[0] is dropped


@pytest.mark.parametrize(("a", "b", "same"), [("ACGTACGT", "CGTACG", True), ("ACGTACGT", "GTAC", True), ("ACGTACGT", "ACG", False), ("ACGTAC", "GTACTT", True), ("AAAAAA", "CCCCCC", False)])
def test_equivalent_but_ends(spark, a, b, same):
    assert one(spark, a=a, b=b).select(S.equivalent_but_ends("a", "b", 2)).first()[0] is same


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_nearest_is_exact(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 14))) for _ in range(30)]
    seqs = sorted({*base, *(b[:3] + rng.choice("ACGT") + b[4:] for b in base), *(b[1:] for b in base if len(b) > 1)})
    frame = spark.createDataFrame([(s,) for s in seqs], "seq string")
    for self_join in (True, False):
        got = {tuple(r) for r in neighbors.nearest(frame, frame, self_join).collect()}
        want = set()
        for q in seqs:
            ds = {t: levenshtein(q, t) for t in seqs if not (self_join and t == q)}
            ds = {t: d for t, d in ds.items() if d <= len(q)}
            want |= {(q, t, d) for t, d in ds.items() if d == min(ds.values())}
        assert got == want


def test_components_and_assignment(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "node string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("f", "e")], "q string, t string")
    assert {tuple(r) for r in graph.components(nodes, edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("e", "e"), ("f", "e"), ("g", "g")}
    links = spark.createDataFrame([("r1", "x"), ("r2", "x"), ("r2", "y"), ("r3", "y"), ("r3", "z"), ("r4", "y")], "read string, candidate string")
    assert {tuple(r) for r in graph.greedy_assignment(links).collect()} == {("r1", "x"), ("r2", "y"), ("r3", "y"), ("r4", "y")}


def test_tail_bound_limits(spark):
    trials = spark.createDataFrame([(1, 0.01, False), (1, 0.01, False), (2, 0.01, True), (2, 0.01, False)], "g int, p double, supports boolean")
    rows = {r["g"]: r for r in significance.tail_bounds(trials, ["g"]).collect()}
    assert rows[1]["p_value"] == 1.0 and rows[2]["k"] == 1 and 0 < rows[2]["p_value"] < 0.1
    factor = spark.range(1).select(F.exp(significance.ln_factor(F.lit(10), F.lit(1), F.lit(2), F.lit(1)))).first()[0]
    assert round(factor) == 44 * 45 * 24
    assert spark.range(1).select(significance.ln_factor(F.lit(1), F.lit(0), F.lit(5), F.lit(0))).first()[0] is None


def test_files(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">a b\nACG\nTT\n>c\n\n>d\nAC")
    assert {tuple(r) for r in fasta.read_fasta(spark, str(tmp_path / "r.fa")).collect()} == {("a_b", "ACGTT"), ("c", ""), ("d", "AC")}
    (tmp_path / "r.fq").write_text("@a\nAC\nGT\n+\n@I\nII\n@b\nACG\n+\nII")
    assert [tuple(r) for r in fasta.read_fastq(spark, str(tmp_path / "r.fq")).collect()] == [("a", "ACGT", "@III"), ("b", "ACG", None)]
    (tmp_path / "r.sam").write_text("@HD\tVN:1\nm/1/ccs\t4\t*\t0\t0\t*\t*\t0\t0\tACG\tIII\tnp:i:7\nother\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")
    assert [tuple(r) for r in fasta.read_sam(spark, str(tmp_path / "r.sam")).collect()] == [("m/1", "ACG", [40, 40, 40], 7)]
    frame = spark.createDataFrame([("b", "AC"), ("a", "GT")], "acc string, seq string")
    fasta.write_fasta(frame.coalesce(1), str(tmp_path / "out"))
    assert {tuple(r) for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()} == {("b", "AC"), ("a", "GT")}
    twice = spark.createDataFrame([("a", "AC", 1), ("a", "GT", 2)], "acc string, seq string, position long")
    assert [tuple(r) for r in fasta.last_of_each(twice, "position").collect()] == [("a", "GT")]
    with pytest.raises(ValueError, match="FASTQ"):
        fasta.kind_of("reads.txt")


def test_verbs_recover_a_family(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("ACGT") for _ in range(120))
    other = base[:60] + ("A" if base[60] != "A" else "C") + base[61:]

    def noisy(s):
        p = rng.randrange(5, 115)
        return s[:p] + rng.choice("ACGT") + s[p + 1 :] if rng.random() < 0.3 else s

    reads = spark.createDataFrame([(f"r{i}", noisy(base if i < 14 else other)) for i in range(24)], "acc string, seq string")
    found = P.get_candidates(reads)
    assert {base, other} <= {r["seq"] for r in found.candidates.collect()}
    final, assignment = P.stat_filter(reads, found.candidates, assignment=found.assignment)
    assert {r["seq"] for r in final.collect()} == {base, other} and assignment.count() == 24


def test_power(spark):
    rows = power.quantiles(power.simulate(spark, [100, 400], replicates=10, share=0.1)).collect()
    assert {r["depth"] for r in rows} == {100, 400} and all(0 <= r["p_value"] <= 1 for r in rows)
