"""Joins that meet by windows and segments, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import alignment as A
from seqloom.functions import distance as D
from seqloom.functions import sequences as S
from seqloom.operators import neighbors
from seqloom.plans import catalog
from tests.test_kernels import infix_by_table


def variants_of(rng, base, many, edits, ends):
    out = [base]
    for _ in range(many):
        s = list(rng.choice(out))
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(s))
            s[at : at + rng.randint(0, 1)] = rng.choice(["", "A", "C", "G", "T"])
        s = "".join(s)
        out.append("".join(rng.choice("ACGT") for _ in range(rng.randint(0, ends))) + s[rng.randint(0, ends) : len(s) - rng.randint(0, ends)])
    return out


def sequences(seed, lengths, ends):
    rng = random.Random(seed)
    found = []
    for n in lengths:
        found += variants_of(rng, "".join(rng.choice("ACGT") for _ in range(n)), 8, 3, ends)
    return sorted({s for s in found if s})


def frame(spark, seqs):
    return spark.createDataFrame([(f"c{i}", s) for i, s in enumerate(seqs)], "acc string, seq string")


@pytest.mark.parametrize(("lengths", "ends"), [((5, 6, 9, 14), 3), ((40, 41, 90, 200), 3), ((30, 70, 130), 15)])
def test_equivalent_pairs(spark, lengths, ends):
    found = frame(spark, sequences(1, lengths, ends))
    got = {tuple(r) for r in neighbors.equivalent_pairs(found, ends).collect()}
    a, b = found.toDF("a", "s"), found.toDF("b", "u")
    want = a.crossJoin(b).where((F.col("s") != F.col("u")) & S.equivalent_but_ends("s", "u", ends)).select("a", "b")
    assert got == {tuple(r) for r in want.collect()} and got


def test_equivalents_with_one_beginning(spark):
    """Of sequences that begin alike only those meet that are the same but for their ends, or nearly."""
    rng = random.Random(14)
    start = "".join(rng.choice("ACGT") for _ in range(64))
    seqs = sorted({start + "".join(rng.choice("ACGT") for _ in range(30)) for _ in range(200)})
    seqs += [seqs[0][2:], seqs[1][:-3], "A" + seqs[2][:-1], seqs[3] + "CG"]
    found = frame(spark, seqs)
    got = {tuple(r) for r in neighbors.equivalent_pairs(found, 3).collect()}
    assert got == {("c0", "c200"), ("c1", "c201"), ("c2", "c202"), ("c202", "c2"), ("c203", "c3")}
    assert neighbors._with_parts_in_common(found, 3).count() < 20


def test_close_but_ends(spark):
    ends, most = 4, 3
    found = frame(spark, sequences(2, (20, 60, 61, 150), ends))
    got = {tuple(r) for r in neighbors.close_but_ends(found, ends, most).collect()}
    a, b = found.toDF("t", "_t"), found.toDF("q", "_q")
    lt, lq = F.length("_t"), F.length("_q")
    near = (lq >= lt - most - 2 * ends) & ((lq < lt) | ((lq == lt) & (F.col("_q") < F.col("_t"))))
    pairs = a.crossJoin(b).where(near).where(F.expr(f"levenshtein(_q, _t, {most + 4 * ends}) >= 0"))
    want = {tuple(r) for r in pairs.select("q", "t", A.ends_adjusted("_q", "_t", ends).alias("ed")).where(f"ed is not null and ed <= {most}").collect()}
    want |= {(t, q, e) for q, t, e in want}
    assert {g for g in got if g[2] <= most} == want and want


def test_nearest_of_longer_reads(spark):
    seqs = sequences(3, (60, 61, 120, 121), 0) + sequences(4, (60, 120), 0)
    found = frame(spark, sorted(set(seqs))).select("seq")
    got = {tuple(r) for r in neighbors.nearest(found, found, self_join=True).collect()}
    pairs = found.toDF("q").crossJoin(found.toDF("t")).where("q <> t").withColumn("ed", F.levenshtein("q", "t")).where("ed <= length(q)")
    assert got == {tuple(r) for r in neighbors._least(pairs).collect()}


def test_running_sums(spark):
    rows = [(k, 1 + k % 3) for k in (0, 1, 2, 255, 256, 257, 900, 5000)]
    got = dict(map(tuple, neighbors.running_before(spark.createDataFrame(rows, "k long, count long"), "k", F.floor(F.col("k") / 256)).collect()))
    assert got == {k: sum(n for j, n in rows if j < k) for k, _ in rows}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_distances_by_bit_vectors():
    rng = random.Random(6)
    texts = ["", "A", "é😀x"] + ["".join(rng.choice("ACGé") for _ in range(rng.choice([3, 40, 63, 64, 65, 127, 128, 130, 200]))) for _ in range(30)]
    codes, lengths, alphabet = D.codes_of(texts)
    counts = D.profiles(codes, lengths, len(alphabet))
    for i, s in enumerate(texts):
        want = [distance(s, t) for t in texts]
        assert D.distances(codes[i, : lengths[i]], codes, lengths, len(alphabet)).tolist() == want
        assert (D.least_distances(counts[i], lengths[i], counts, lengths) <= want).all()


@pytest.mark.parametrize("self_join", [True, False])
def test_far_neighbours(spark, self_join, monkeypatch):
    """Reads that resemble nothing, in small blocks and bands."""
    monkeypatch.setattr(neighbors, "BLOCK", 7)
    rng = random.Random(self_join)
    lone = {"".join(rng.choice("ACGT") for _ in range(rng.choice([1, 2, 5, 12, 30, 45, 70]))) for _ in range(90)}
    near = set(sequences(9, (30, 66), 0))
    queries, targets = sorted(lone | near), sorted(lone | near if self_join else near | {"".join(rng.choice("ACGT") for _ in range(9)) for _ in range(40)})
    got = {tuple(r) for r in neighbors.nearest(frame(spark, queries).select("seq"), frame(spark, targets).select("seq"), self_join).collect()}
    want = set()
    for q in queries:
        away = {t: distance(q, t) for t in targets if not (self_join and t == q)}
        best = min(away.values())
        want |= {(q, t, d) for t, d in away.items() if d == best <= len(q)}
    assert got == want


def test_neighbours_within_a_share(spark):
    seqs = sequences(11, (40, 100, 101, 400, 900), 0)
    found = frame(spark, seqs).select("seq")
    got = {tuple(r) for r in neighbors.nearest(found, found, True, share=0.05).collect()}
    want = set()
    for q in seqs:
        away = {t: distance(q, t) for t in seqs if t != q and abs(len(t) - len(q)) <= len(q) // 20}
        best = min(away.values(), default=len(q))
        want |= {(q, t, d) for t, d in away.items() if d == best <= len(q) // 20}
    assert got == want and got


def test_few_pairs_are_measured(spark):
    """Of the reads of the queries, whether or not a window finds their neighbours: less than a twentieth of all pairs."""
    reads = sorted(r["seq"] for r in catalog.short_reads(spark, "/root/testdata/sf0.1").select("seq").distinct().collect())
    some = reads[::10]
    found, measured = D.nearest_among(some, [len(r) for r in some], reads, True)
    assert {i for i, *_ in found} == set(range(len(some))) and measured < 0.05 * len(some) * len(reads)


def test_ends_adjusted_graph_of_the_reads(spark):
    """The registered query against all pairs, each by the whole table."""
    folder, ends, most = "/root/testdata/sf0.001", 3, 10
    reads = [(r["acc"], r["seq"]) for r in neighbors.distinct_sequences(catalog.short_reads(spark, folder)).collect()]
    want = set()
    for a, s in reads:
        for b, t in reads:
            if (len(s), s) < (len(t), t) and len(t) - len(s) <= most + 2 * ends:
                ed, start, end, edits = infix_by_table(s, t)
                if ed <= most + ends:
                    ed += max(0, start - ends) + max(0, len(t) - end - ends)
                    ed -= min(len(edits) - len(edits.lstrip("I")), ends)
                    ed -= min(len(edits) - len(edits.rstrip("I")), ends) if edits.strip("I") else 0
                    if 0 <= ed <= most:
                        want |= {(a, b, ed), (b, a, ed)}
    got = [tuple(r) for r in catalog.ends_adjusted_graph(spark, folder).select("q", "t", "ed").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_reads_with_one_beginning(spark):
    """Addresses begin alike: they do not meet by what all of them have, and those within one edit meet by deletions."""
    rng = random.Random(12)
    start = "".join(rng.choice("ACGT") for _ in range(40))
    seqs = sorted({start + "".join(rng.choice("ACGT") for _ in range(rng.choice([5, 14]))) for _ in range(400)})
    found = frame(spark, seqs).select("seq")
    held = neighbors._numbered(found)
    assert neighbors._pairs_by_window(held, held, 3, False).count() == 0
    assert neighbors._pairs_by_deletion(held, held).where("q <> t").count() < len(seqs) ** 2 / 50
    got = {tuple(r) for r in neighbors.nearest(found, found, True).collect()}
    away = {q: [(distance(q[40:], t[40:]), t) for t in seqs if t != q] for q in seqs}
    assert got == {(q, t, d) for q, near in away.items() for d, t in near if d == min(near)[0]}


def test_deletions_meet():
    rng = random.Random(13)
    texts = ["", "A", "é😀x", *("".join(rng.choice("AC") for _ in range(rng.randint(1, 7))) for _ in range(60))]
    keys = [set(D.deletion_hashes(t).tolist()) for t in texts]
    for i, s in enumerate(texts):
        for k, t in enumerate(texts):
            assert keys[i] & keys[k] or distance(s, t) > 1
            assert not keys[i] & keys[k] or distance(s, t) <= 2


@pytest.mark.parametrize(("ends", "most"), [(3, 10), (0, 2), (15, 10)])
def test_pairs_but_for_ends_by_bit_vectors(ends, most, monkeypatch):
    """Many pairs at a time against each by itself; lengths about the ends of machine words."""
    monkeypatch.setattr(D, "ROWS", 16)
    monkeypatch.setattr(D, "PATHS", 20)
    rng = random.Random(21)
    texts = {"", "A", "é😀x"}
    for n in (2, 5, 14, 30, 62, 63, 64, 65, 127, 128, 200):
        start = "".join(rng.choice("ACGT") for _ in range(n))
        for _ in range(8):
            s = list(start)
            for _ in range(rng.randint(0, 8)):
                at = rng.randrange(len(s) + 1)
                s[at : at + rng.randint(0, 1)] = rng.choice(["", "A", "C", "é"])
            texts.add("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 5))) + "".join(s)[rng.randint(0, 4) :])
    texts = sorted(texts)
    q, t, ed = (c.tolist() for c in D.close_among(texts, texts, ends, most))
    want = set()
    for i, s in enumerate(texts):
        for k, u in enumerate(texts):
            if (len(s), s) < (len(u), u) and len(u) - len(s) <= most + 2 * ends and (e := A.ends_adjusted_distance(s, u, ends, most)) is not None:
                want.add((i, k, e))
    assert len(q) == len(set(zip(q, t, strict=True))) and set(zip(q, t, ed, strict=True)) == want and want


def test_short_reads_are_not_aligned_one_by_one(spark, monkeypatch):
    """Reads without windows, in small blocks of several bands: all pairs, none of them by the alignment of a single pair."""
    monkeypatch.setattr(neighbors, "BLOCK", 9)
    monkeypatch.setattr(A, "ends_adjusted", lambda *_: F.lit(None).cast("int"))
    rng = random.Random(22)
    seqs = sorted({"".join(rng.choice("ACGT") for _ in range(rng.choice([1, 2, 16, 17, 33, 34, 40, 50]))) for _ in range(90)} | set(sequences(23, (30, 70, 88), 3)))
    got = [tuple(r) for r in neighbors.close_but_ends(frame(spark, seqs), 3).collect()]
    want = set()
    for i, s in enumerate(seqs):
        for k, u in enumerate(seqs):
            if (len(s), s) < (len(u), u) and len(u) - len(s) <= 16 and (e := A.ends_adjusted_distance(s, u, 3)) is not None:
                want |= {(f"c{i}", f"c{k}", e), (f"c{k}", f"c{i}", e)}
    assert max(map(len, seqs)) < 94 and len(got) == len(set(got)) and set(got) == want


def test_close_but_ends_about_the_least_window(spark):
    """Lengths on both sides of 94, from which on the longer one's windows are long enough to be looked up."""
    seqs = sorted({s for s in sequences(24, (84, 92, 96, 104), 3) if 78 <= len(s)} | {s[i : 93 + i] for s in sequences(25, (100,), 0) for i in (0, 1, 3)})
    got = [tuple(r) for r in neighbors.close_but_ends(frame(spark, seqs), 3).collect()]
    want = set()
    for i, s in enumerate(seqs):
        for k, u in enumerate(seqs):
            if (len(s), s) < (len(u), u) and len(u) - len(s) <= 16 and (e := A.ends_adjusted_distance(s, u, 3)) is not None:
                want |= {(f"c{i}", f"c{k}", e), (f"c{k}", f"c{i}", e)}
    assert len(got) == len(set(got)) and set(got) == want
    assert any(len(seqs[int(q[1:])]) < 94 <= len(seqs[int(t[1:])]) for q, t, _ in got)
