import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.functions import alignment as A
from seqloom.functions import variants as V
from seqloom.plans.power import replicate
from tests.test_partition import greedy_partition

dna = st.text("ACGT", min_size=1, max_size=24)


def plain_score(a, b, match, mismatch, opening, extending):
    """The textbook table, cell by cell."""
    n, m, low = len(a), len(b), -(10**9)
    h = [[0] * (m + 1) for _ in range(n + 1)]
    e = [[low] * (m + 1) for _ in range(n + 1)]
    f = [[low] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e[i][j] = max(h[i - 1][j] - opening, e[i - 1][j] - extending)
            f[i][j] = max(h[i][j - 1] - opening, f[i][j - 1] - extending)
            h[i][j] = max(h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), e[i][j], f[i][j])
    return max([0] + [h[n][j] for j in range(1, m + 1)] + [h[i][m] for i in range(1, n + 1)])


def score_of(a, b, match, mismatch, opening, extending):
    """The score of a gapped pair with free end gaps."""
    start, end = V.masked(a, b)
    total, last = 0, ""
    for x, y in zip(a[start:end], b[start:end], strict=True):
        kind = "a" if x == "-" else "b" if y == "-" else ""
        total += (match if x == y else mismatch) if not kind else -(extending if kind == last else opening)
        last = kind
    return total


def infix_by_table(query, target):
    """The whole table, and the way back with the diagonal first, then a character of the query only."""
    n, m = len(query), len(target)
    d = [[0] * (m + 1)] + [[i] + [0] * m for i in range(1, n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j - 1] + (query[i - 1] != target[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    end = d[n].index(min(d[n]))
    i, j, edits = n, end, ""
    while i:
        if j and d[i][j] == d[i - 1][j - 1] + (query[i - 1] != target[j - 1]):
            edits, i, j = ("=" if query[i - 1] == target[j - 1] else "X") + edits, i - 1, j - 1
        elif d[i][j] == d[i - 1][j] + 1:
            edits, i = "I" + edits, i - 1
        else:
            edits, j = "D" + edits, j - 1
    return d[n][end], j, end, edits


@settings(max_examples=200, deadline=None)
@given(st.text("ACG", max_size=90), st.text("ACG", max_size=90))
def test_infix_distance_by_bit_vectors(q, t):
    want = infix_by_table(q, t)
    assert A.infix_distance(q, t, 1000) == want
    assert A.infix_distance(q, t, want[0] - 1) is None or not q


@settings(max_examples=150, deadline=None)
@given(dna, dna, st.sampled_from([(2, -2, 2, 0), (2, -4, 2, 0), (2, -3, 3, 1)]))
def test_alignment_is_optimal_and_whole(a, b, costs):
    x, y, score = A.semi_global(a, b, *costs)
    assert (x.replace("-", ""), y.replace("-", "")) == (a, b) and len(x) == len(y)
    assert score == plain_score(a, b, *costs)
    if score > 0:
        assert score_of(x, y, *costs) == score


def test_alignment_of_nothing():
    assert A.semi_global("", "AC")[:2] == ("--", "AC")


@settings(max_examples=100, deadline=None)
@given(dna, dna)
def test_infix_distance(q, t):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    best = min(distance(q, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
    found = A.infix_distance(q, t, 10**6)
    assert found[0] == best == sum(c != "=" for c in found[3])


def test_ends_are_free_up_to_the_limit():
    core = "ACGTTGCAAGTC"
    assert A.ends_adjusted_distance(core, "TTT" + core, 3) == 0
    assert A.ends_adjusted_distance(core, "TTTT" + core, 3) == 1
    assert A.ends_adjusted_distance("GG" + core, core, 2) == 0


@pytest.mark.parametrize("seed", range(20))
def test_slots(seed):
    """Slots joined give the query; there is one for each base of the target and one before, between and after them."""
    rng = random.Random(seed)
    pairs = [rng.choice([("A", "A"), ("C", "T"), ("-", "G"), ("T", "-")]) for _ in range(rng.randint(1, 30))]
    query, target = ("".join(x) for x in zip(*pairs, strict=True))
    start = rng.randint(0, 5)
    out, first, last = A.slots(query, target, start)
    bases = len(target.replace("-", ""))
    assert "".join(out).replace("-", "") == query.replace("-", "")
    assert len(out) == 2 * bases + 1 and (first, last) == (2 * start, 2 * (start + bases))
    assert out[1::2] == [q for q, t in pairs if t != "-"]


def test_insertion_placement_falls_back():
    """An alignment that leaves inserted characters out has fewer edits: whole, where most agree, else to the left."""
    for insertion, longest in [("TACG", "-ACGA-"), ("GTCA", "-TCAG-"), ("CCCA", "-AAAC-"), ("TTTT", "-ACGA-")]:
        made = A.placed(insertion, longest)
        kept = [i for i, x in enumerate(made) if x != "-"]
        assert len(made) == len(longest) and made.replace("-", "") == insertion
        threads = min(sum(x != longest[i] for x, i in zip(insertion, at)) for at in combinations(range(len(longest)), len(insertion)))
        fewest = plain_edits(longest, insertion)
        if threads + len(longest) - len(insertion) > fewest:
            agree = [sum(x == y for x, y in zip(insertion, longest[p:])) for p in range(len(longest) - len(insertion) + 1)]
            assert kept == list(range(agree.index(max(agree)), agree.index(max(agree)) + len(insertion)))
        else:
            assert sum(x != longest[i] for x, i in zip(insertion, kept)) == threads


def plain_edits(a, b):
    if not a or not b:
        return len(a) + len(b)
    return min(plain_edits(a[1:], b) + 1, plain_edits(a, b[1:]) + 1, plain_edits(a[1:], b[1:]) + (a[0] != b[0]))


def test_matrix_of_one_center():
    """The survey's example: six members in the slots of one center."""
    longest, others = "ACCG", {"ACCG": "-ACCG-", "AG": "-A--G-", "A": "-A----", "CC": "--CC--", "-": "------", "C": "--C---"}
    assert {s: A.placed(s, f"-{longest}-") for s in others} == others


def test_support_compares_gapped_windows():
    """A read that has the candidate's bases, but in other columns, is no support."""
    found = V.variants("ACGTTACG", "ACG-TACG")
    assert [(v.kind, v.run, v.seen) for v in found] == [("D", 2, "G-TA")]
    # Reads of the reference: the same columns support, the other base of the run left out does not.
    assert V.supports("ACGTTACG", "ACG-TACG", found, False) and not V.supports("ACGTTACG", "ACGT-ACG", found, False)
    assert V.supports("ACGTACG", "ACGTACG", found, True) and not V.supports("ACGT-ACG", "ACGTTACG", found, True)
    inserted = V.variants("ACG-TACG", "ACGATACG")
    assert [(v.kind, v.t, v.c, v.run, v.seen) for v in inserted] == [("I", 3, 3, 1, "GAT")]
    assert V.supports("ACG-TACG", "ACGATACG", inserted, False) and not V.supports("ACGTACG", "ACGTACG", inserted, False)
    assert V.supports("ACGATACG", "ACGATACG", inserted, True) and not V.supports("ACGATACG", "ACG-TACG", inserted, True)


def test_placed():
    assert A.placed("-", "-ACG-") == "-----"
    assert A.placed("CG", "-ACG-") == "--CG-"
    assert A.placed("AG", "-ACG-") == "-A-G-"


def test_cigar():
    assert A.from_cigar("2=1I1X1D", "ACGT", "ACAG") == ("ACGT-", "AC-AG")


def test_variants_and_support():
    found = V.variants("ACGTTACG", "ACGATACG")
    assert [(v.kind, v.t, v.base, v.run) for v in found] == [("S", 3, "A", 1)]
    assert V.supports("ACGATACG", "ACGATACG", found, True) and not V.supports("ACGATACG", "ACGTTACG", found, True)
    assert V.supports("ACGTTACG", "ACGATACG", found, False) and not V.supports("ACGTTACG", "ACGTTACG", found, False)
    deleted = V.variants("ACTTTG", "AC-TTG")
    assert [(v.kind, v.run) for v in deleted] == [("D", 3)]
    assert V.variants("--ACGT", "GGACGT") == []


def test_error_counts_and_chance():
    assert V.error_counts("AC-GTA", "ACTG-C") == (1, 1, 1)
    assert 0 < V.chance(V.variants("ACGT", "AGGT"), (0, 0, 0), 4) < 1
    assert sum(V.error_ratios((0, 5, 2))) == 1.0


@settings(max_examples=150, deadline=None)
@given(dna, dna, st.sampled_from([(2, -1, 2, 0), (2, -2, 2, 0), (2, -4, 3, 1)]))
def test_alignment_in_blocks_of_rows(a, b, costs):
    whole = A.semi_global(a, b, *costs)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(A, "CELLS", 0)
        assert A.semi_global(a, b, *costs) == whole


def test_alignment_of_long_sequences():
    """20 kb against 20 kb in less than 100 MB."""
    import tracemalloc

    rng = random.Random(1)
    a = "".join(rng.choice("ACGT") for _ in range(20_000))
    b = a[:5000] + a[5003:12_000] + "ACGT" + a[12_000:]
    tracemalloc.start()
    x, y, score = A.semi_global(a, b)
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert x.replace("-", "") == a and y.replace("-", "") == b and score == 2 * (len(a) - 3) - 4
    assert used < 100e6


def test_greedy_partition():
    made = greedy_partition({"a": 3, "b": 1, "c": 1, "d": 5}, {"a": {"b", "c"}, "d": set()}, True)
    assert set(made) == {("a", "a", 5), ("a", "b", 5), ("a", "c", 5), ("d", "d", 5)}


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**6))
def test_partition_covers_all_nodes_once(seed):
    rng = random.Random(seed)
    nodes = {chr(97 + i): rng.randint(1, 4) for i in range(8)}
    links = {n: {m for m in nodes if m != n and rng.random() < 0.2} for n in nodes}
    members = [m for _, m, _ in greedy_partition(nodes, links, True)]
    assert sorted(members) == sorted(nodes)


def test_replicate_is_seeded():
    assert replicate(5, 200, 2000, 1, 0.2) == replicate(5, 200, 2000, 1, 0.2) < 0.01
    assert np.isclose(replicate(5, 50, 2000, 1, 0.0), 1.0)
