"""Alignment of two tokenizers against a plain version of the definition."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from seqloom.llm import crosstok
from seqloom.llm.bpe import to_bytes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, block string, place int, key double, a string, digest string"
TEXTS = [None, "", " ", "a", "hello world", "hello  world \n\n x", "naïve café 日本語 😀😀😀", "a\r\nb } \r", "▁ is a mark", "x ▁", "<|endoftext|> <s> </s> <unk> <0x0A>",
         "tab\there\x85there\xa0non　breaking \x1c\x1f z", "ééééé" * 9, "aaaa" * 400, "\x00zero", "word " * 4000, "  lead", "trail  ", "\n", "hello world"]


def by_definition(rows):
    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    links, out, documents = [], [], Counter()
    for _, text in rows:
        groups = []
        if text:
            a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
            a_parts = [to_bytes(a_side.id_to_token(i)) for i in a]
            b_parts = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_parts) == b"".join(b_parts) == (" " + text).encode():
                ends = []
                for parts in (a_parts, b_parts):
                    at, ends_ = 0, []
                    for p in parts:
                        at += len(p)
                        ends_.append(at)
                    ends.append(ends_)
                low = 0
                for cut in sorted({*ends[0]} & {*ends[1]}):
                    groups.append(([i for i, e in zip(a, ends[0]) if low < e <= cut], [i for i, e in zip(b, ends[1]) if low < e <= cut]))
                    low = cut
        mine = Counter((i, j) for x, y in groups for i in x for j in y)
        links.append(mine)
        documents.update(mine.keys())
        out.append([sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(mine.values()), ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)])
    best = defaultdict(int)
    for (i, _), n in documents.items():
        best[i] = max(best[i], n)
    found = Counter()
    for (name, _), (n_a, n_b, n_groups, n_links, written), mine in zip(rows, out, links):
        top = sum(n for p, n in mine.items() if documents[p] == best[p[0]])
        found[name, n_a, n_b, n_groups, n_links, top, sum(n * documents[p] for p, n in mine.items()), hashlib.sha256(written.encode()).hexdigest() if written else ""] += 1
    return found


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


@pytest.mark.parametrize("small", [False, True])
def test_equals_the_definition(spark, small, monkeypatch):
    if small:  # many blocks, cells and flushes; links in the way of large groups
        for name, value in (("BLOCK_BYTES", 3000), ("CELL_BYTES", 4000), ("ADDED_UP", 50), ("EXPANDED", 3)):
            monkeypatch.setattr(crosstok, name, value)
    rng = random.Random(4)
    words = ["the", "alignment", "Straße", "don't", "1234567", "tokenisation", "и", "über-", "x\n", "\t", "cóte", "…", "  "]
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 80)))) for i in range(60)] + [(100, "the end"), (None, "no id")]
    df = spark.createDataFrame([(i, t, "b", 1, 0.5, "a", "d") for i, t in rows], SCHEMA).repartition(3)
    assert rows_of(crosstok.aligned(df, A, B)) == by_definition(rows)


def test_empty_table(spark):
    assert crosstok.aligned(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows_of(crosstok.aligned(nothing, A, B)) == Counter({(i, 0, 0, 0, 0, 0, 0, ""): 1 for i in (1, 2)})


def test_documents_of_the_tables(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert rows_of(crosstok.op12_postings_cogroup(spark, folder)) == by_definition(rows)


def test_packed_numbers():
    import numpy as np

    values = np.array([0, 1, 127, 128, 2**14, 2**35 + 5, 2**62, 3])
    data, sizes = crosstok.packed(values)
    assert crosstok.unpacked(data.tobytes()).tolist() == values.tolist() and sizes.tolist() == [1, 1, 1, 2, 3, 6, 9, 1]
    assert crosstok.unpacked(b"").tolist() == [] and len(crosstok.packed(values[:0])[0]) == 0
