"""Correction by array profiles against a plain version of the rule."""

import math
import random
from collections import Counter, defaultdict

import pytest

from seqloom.functions.alignment import placed, semi_global, slots
from seqloom.operators import consensus


def corrected_plainly(pairs):
    """pairs: (center, member, degree, aln_c, aln_m)."""
    out = set()
    by_center = defaultdict(list)
    for p in pairs:
        by_center[p[0]].append(p)
    for rows in by_center.values():
        if len(rows) < 2 or sum(r[2] for r in rows) <= 2:
            continue
        parts = {r[1]: slots(r[4], r[3])[0] for r in rows}
        columns = {m: [] for m in parts}
        for k in range(len(next(iter(parts.values())))):
            longest = min((p[k] for p in parts.values()), key=lambda s: (-len(s), s))
            for m, p in parts.items():
                columns[m] += placed(p[k], f"-{longest}-") if k % 2 == 0 and len(longest) > 1 else p[k]
        counts = [Counter() for _ in next(iter(columns.values()))]
        for _, m, degree, *_ in rows:
            for c, x in zip(counts, columns[m], strict=True):
                c[x] += degree
        tops = [min(x for x, n in c.items() if n == max(c.values())) for c in counts]
        clear = [list(c.values()).count(max(c.values())) == 1 for c in counts]
        kind = lambda top, x: "ins" if top == "-" else "del" if x == "-" else "subs"
        errors = Counter()
        for c, top, ok in zip(counts, tops, clear, strict=True):
            for x, n in c.items():
                if ok and x != top:
                    errors[kind(top, x)] += n
        for _, m, degree, *_ in rows:
            mine = list(columns[m])
            minor = sorted((counts[i][x] / max(errors[kind(tops[i], x)], 1), i) for i, x in enumerate(mine) if clear[i] and x != tops[i])
            if degree <= 1 and minor:
                limit = minor[math.ceil(len(minor) / 2) - 1][0]
                for share, i in minor:
                    if share <= limit:
                        mine[i] = tops[i]
            out.add((m, "".join(mine).replace("-", "")))
    return out


def partitions(seed, sizes):
    rng, rows = random.Random(seed), []
    for size in sizes:
        center = "".join(rng.choice("ACGT") for _ in range(rng.randint(5, 60)))
        members = {center}
        while len(members) < size:
            s = list(center)
            for _ in range(rng.randint(1, 5)):
                at = rng.randrange(len(s))
                s[at : at + rng.randint(0, 1)] = rng.choice(["", "A", "C", "GT", "TTA", "N"])
            members.add("".join(s) or "A")
        for m in members:
            a, b, _ = semi_global(center, m)
            rows.append((center, m, rng.choice([1, 1, 1, 2, 5]), a, b))
    return rows


@pytest.mark.parametrize("members", [3, 2000])
def test_corrected_equals_the_plain_rule(spark, members, monkeypatch):
    monkeypatch.setattr(consensus, "MEMBERS", members)
    rows = partitions(members, [1, 2, 2, 3, 5, 8, 20, 40])
    df = spark.createDataFrame(rows, "center string, member string, degree long, aln_c string, aln_m string")
    got = [tuple(r) for r in consensus.corrected(df).select("member", "seq").collect()]
    assert len(got) == len(set(got)) and set(got) == corrected_plainly(rows)
    assert any(m != s for m, s in got)


def test_nothing_to_correct(spark):
    schema = "center string, member string, degree long, aln_c string, aln_m string"
    assert consensus.corrected(spark.createDataFrame([], schema)).collect() == []
    assert consensus.corrected(spark.createDataFrame([("A", "A", 9, "A", "A")], schema)).collect() == []


def test_the_query_equals_the_plain_rule(spark):
    from seqloom.plans import catalog

    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in catalog.partition_alignment(spark, folder).select("center", "member", "degree", "aln_c", "aln_m").collect()]
    assert {tuple(r) for r in catalog.consensus_correction(spark, folder).select("member", "seq").collect()} == corrected_plainly(rows)
