"""Bounded-space packing: every id in one piece, no padding but where the definition has none, bounded windows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seqloom.llm import bounded

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start string, ids string, part string, length int, key double, sequence_id string"
COLUMNS = {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def crc(ids):
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


def check(rows, docs, capacity=2048):
    """Padding of all sequences, after all that the definition asks for."""
    whole = Tokenizer.from_file(PATH)
    texts = Counter((i, t) for i, t in docs)
    ids_of = {x: [*whole.encode(x[1] or "", add_special_tokens=False).ids, 1] for x in texts}
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for i in {i for i, _ in texts}:
        mine = [(x, n) for x, n in texts.items() if x[0] == i]
        assert sum(r["length"] for r in by_doc[i]) == sum(n * len(ids_of[x]) for x, n in mine)
        for r in by_doc[i]:
            assert any(len(ids_of[x]) == r["doc_tokens"] and crc(ids_of[x][r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for x, _ in mine)
        if len(mine) == 1 and mine[0][1] == 1:
            at = 0
            for r in sorted(by_doc[i], key=lambda r: r["start"]):
                assert r["start"] == at and r["length"] > 0
                at += r["length"]
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def texts(n, seed=1):
    rng = random.Random(seed)
    fixed = [None, "", " \t\n", "A  b C\x1cd", "<|endoftext|>", "x <|ENDOFTEXT|> <|startoftext|>y", "é ́ I'd we'll", "日本語 😀 naïve", "\x85a\x1fb", "word " * 30_000]
    made = [" ".join("".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 9))) for _ in range(int(rng.paretovariate(0.8)) % 3000 + 1)) for _ in range(n)]
    return list(enumerate(fixed + made))


def test_packing_is_whole_and_without_padding(spark):
    rows = texts(400)
    df = spark.createDataFrame([(i, t, "s", "i", "p", 7, 0.5, "q") for i, t in rows] + [(None, "no id", None, None, None, None, None, None)], SCHEMA).repartition(7)
    out = bounded.packed(df, PATH)
    assert set(out.columns) == COLUMNS
    assert check(out.collect(), rows + [(None, "no id")]) == 0


def test_repeated_rows_and_empty_table(spark):
    rows = texts(30)
    assert check(bounded.packed(spark.createDataFrame(rows + rows[3:9], "doc_id long, text string"), PATH).collect(), rows + rows[3:9]) == 0
    assert bounded.packed(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


@pytest.mark.parametrize("windows", [1, 4])
def test_small_windows(spark, windows):
    rows = texts(60, 3)
    out = bounded.packed(spark.createDataFrame(rows, "doc_id string, text string").repartition(3), PATH, capacity=64, windows=windows)
    assert check([r.asDict() | {"doc_id": int(r["doc_id"])} for r in out.collect()], rows, 64) == 0


def test_documents_of_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = bounded.op13_bounded_space_packing(spark, "/root/testdata/sf0.01").collect()
    assert check(out, [(r["doc_id"], r["text"]) for r in df.collect()]) == 0
    assert len(out) < 2.2 * df.count()  # best fit leaves most documents whole


def test_windows_place_best_fit_and_emit_the_fullest():
    done = []
    packer = bounded.Packer(lambda number, pieces: done.append([(row, at, len(ids)) for row, at, ids in pieces]), 10, 2)
    for row, n in (("a", 6), ("b", 8), ("c", 2), ("d", 5), ("e", 23)):
        packer.add(row, np.arange(n))
    # c fills b's window; d fits none of those open but opens a second; e gives two whole windows, and its rest goes into a's.
    assert done == [[("b", 0, 8), ("c", 0, 2)], [("e", 0, 10)], [("e", 10, 10)]]
    assert [(w.free, [p[0] for p in w.pieces]) for w in packer.open] == [(1, ["a", "e"]), (5, ["d"])]
    packer.add("f", np.arange(7))  # none fits: the fullest gets the first of f and goes
    assert done[-1] == [("a", 0, 6), ("e", 20, 3), ("f", 0, 1)]
    assert [(w.free, [(p[0], p[1]) for p in w.pieces]) for w in packer.open] == [(4, [("f", 1)]), (5, [("d", 0)])]
    assert sum(len(ids) for *_, ids in packer.close()) == 1 and len(done) == 5


def test_a_line_ends_in_powers_of_two():
    ends, at = [], 0
    while at < 64 * 3 + 45:
        at = bounded._ends(at, 64 * 3 + 45, 64)
        ends.append(at)
    assert ends == [64, 128, 192, 224, 232, 236, 237]
