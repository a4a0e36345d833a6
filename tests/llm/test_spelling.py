"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from seqloom.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, size int, form string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def grouped_by_brute_force(n):
    """From counts of words."""
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = defaultdict(set)
    by_size = defaultdict(list)
    for w in n:
        by_size[len(w)].append(w)
    for w in n:
        for size in (len(w), len(w) + 1):
            for v in by_size[size]:
                if w != v and sum((Counter(w) - Counter(v)).values()) <= 1 and distance(w, v) == 1:
                    near[w].add(v)
                    near[v].add(w)
    form = {}
    for w, c in n.items():
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= 5 * c:
                form[w] = best
    out = set()
    for w, c in n.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, c, len(near[w]), n[form[w]] if w in form else None))
    return out


def words_by_brute_force(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return n


def rows_of(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_texts_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["colour", "color", "Colours", "ÀÉÎõü÷×ß", "organise", "organize", "strasse", "straße", "abcdef", "bcdefg", "x", "isn"]
    rows = [(0, None), (1, ""), (2, "123 '' --"), (3, "colour" * 5000), (None, "organise " * 70), (4, "Organiſe ÀÉÎõü÷×ß"), (4, "organise colour")]
    rows += [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "2", "\n", "ā"]) for _ in range(rng.randint(1, 60)))) for i in range(10, 900)]
    rows += rows[20:40]
    df = spark.createDataFrame([(i, t, "w", "n", 1, "f") for i, t in rows], SCHEMA).repartition(5)
    out = rows_of(spelling.grouped(spelling.counted(df)))
    assert out == grouped_by_brute_force(words_by_brute_force(rows))
    assert any(r[1] for r in out)  # words that lost a code point have their word as form


@pytest.mark.parametrize("listed", [0, 3, 64])
def test_words_equal_brute_force(spark, listed, monkeypatch):
    """Halves that very many words share, small shards and blocks, chains of forms, ties."""
    monkeypatch.setattr(spelling, "LISTED", listed)
    monkeypatch.setattr(spelling, "SHARD", 40)
    monkeypatch.setattr(spelling, "BLOCK", 50)
    rng = random.Random(listed)
    n = {}
    for _ in range(300):
        n["prefix" + "".join(rng.choice("abß") for _ in range(rng.randint(0, 6)))] = rng.choice([5, 25, 125, 126, 700])
        n["".join(rng.choice("abß") for _ in range(rng.randint(3, 7))) + "suffix"] = rng.choice([5, 25, 125, 126, 700])
        n["".join(rng.choice("ab") for _ in range(rng.randint(6, 9)))] = rng.randint(5, 4000)
    for k in range(8):  # each is the form of the one before it
        n["chains"[: 6 - k % 2] + "x" * (k + 1)] = 5 * 5**k
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    out = rows_of(spelling.grouped(words))
    assert out == grouped_by_brute_force(n)
    assert max(len(r[0]) for r in out) > 12


def test_empty(spark):
    assert spelling.grouped(spelling.counted(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
    assert spelling.grouped(spelling.counted(spark.createDataFrame([(1, "a few words")], "doc_id long, text string"))).collect() == []


def test_documents_of_the_tables(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert rows_of(spelling.op11_spelling_halves(spark, folder)) == grouped_by_brute_force(words_by_brute_force(rows))


def test_one_edit():
    for a, b, near in [("abc", "abc", False), ("abc", "abd", True), ("abc", "ab", True), ("ab", "abc", True), ("abc", "bca", False), ("abc", "xabc", True), ("abc", "acb", False), ("", "a", True)]:
        assert spelling.one_edit(a, b) == near == (distance(a, b) == 1)
