"""The document operators against brute force, on edge cases and on the smallest tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqloom.llm import bpe, jaccard, packing, pii, substrings, toxicity

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score double, n long, seed long, spans string, piece string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


def edge_rows():
    shared, long = words(1, 60), words(2, 30_000)
    texts = [None, "", " \t\n", "one two", words(3, 80), words(3, 80), f"{words(4, 30)} {shared}", f"{words(5, 30)}\n{shared} {words(6, 9)}", long, f"{long} end", "x " * 300, "x " * 280, "naïve café 日本語 😀", "A b c D e f", "a B c d E f"]
    return [(i, t, None, 5, None, "s", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


# Byte-level BPE


def tiktoken_encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, docs, edges, empty):
    own, vocabulary = tiktoken_encoding(), bpe.Vocabulary(RANKS)
    for df in (docs, edges):
        want = set()
        for i, t in texts_of(df):
            ids = own.encode_ordinary(t or "")
            want.add((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert {tuple(r) for r in bpe.digests(df, vocabulary).collect()} == want
    assert bpe.digests(empty, vocabulary).count() == 0


def test_bpe_operator_keeps_columns_and_round_trips(spark, edges):
    vocabulary = bpe.Vocabulary(JSON)
    out = bpe.decode(bpe.encode(edges.withColumn("ids", F.lit("clash")), vocabulary, with_offsets=True), vocabulary)
    assert {"score", "piece", "ids", "starts", "ends", "decoded"} <= set(out.columns)
    whole = Tokenizer.from_file(JSON)
    for r in out.collect():
        text = r["text"] or ""
        assert r["ids"] == whole.encode(text, add_special_tokens=False).ids
        assert bytes(r["decoded"]) == text.encode()
        assert all(0 <= a < b <= len(text) for a, b in zip(r["starts"], r["ends"], strict=True))


@pytest.mark.parametrize("text", ["  a  b", " a", "\n\na", "a\r\nb ", "don't  we'll'd", "\x1c\x85x", "aaaa" * 50, "é" * 9, "<|endoftext|>", "👩‍👩‍👧 x"])
def test_bpe_white_space(text):
    own = bpe.codec(bpe.Vocabulary(RANKS))
    assert own.encode([text])[0].tolist() == tiktoken_encoding().encode_ordinary(text)


MARKED = ["<|endoftext|>", "<|endoftext|> a b", "a b<|endoftext|>", "hello <|endoftext|> world", "a\n<|endoftext|>\nb <|endoftext", "one two " * 40_000 + "<|endoftext|> three"]


@pytest.mark.parametrize("plain", [False, True])
def test_bpe_special_tokens_inside_texts(spark, plain):
    whole = Tokenizer.from_file(JSON)
    whole.encode_special_tokens = plain
    out = bpe.encode(spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string"), bpe.Vocabulary(JSON, plain=plain)).collect()
    assert len(out) == len(MARKED)
    for r in out:
        assert r["ids"] == whole.encode(r["text"], add_special_tokens=False).ids and (50256 in r["ids"]) != plain


# Substring dedup


def cut_by_brute_force(rows, window=50):
    split = [(i, re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = b" ".join(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = set()
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[b" ".join(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.add((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_substrings_equal_brute_force(docs, edges, empty):
    for df in (docs, edges):
        assert {tuple(r) for r in substrings.digests(df).collect()} == cut_by_brute_force(texts_of(df))
    assert substrings.digests(empty).count() == 0


def test_substrings_of_shared_passages(spark):
    rng = random.Random(5)
    passages = [words(100 + i, 70) for i in range(4)]
    rows = []
    for i in range(60):
        parts = [words(1000 + i, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages).split()
            a = rng.randint(0, 15)
            parts += [" ".join(p[a : a + rng.randint(45, 60)]), words(rng.randint(0, 10**6), rng.randint(0, 20))]
        rows.append((i, " ".join(parts)))
    df = spark.createDataFrame(rows + rows[10:13], "doc_id long, text string")
    assert {tuple(r) for r in substrings.digests(df).collect()} == cut_by_brute_force(rows)


def test_substrings_keep_columns(edges):
    out = {r["doc_id"]: r for r in substrings.dedup(edges).collect()}
    assert out[0]["text"] is None and out[2]["text"] == " \t\n" and out[5]["text"] == "" and out[4]["spans"] == "s"


# Toxicity


def test_toxicity_is_learned_without_group_names(spark):
    rows, labels = [], []
    for i in range(400):
        bad, group = i % 4 == 0, i % 8 < 3 or i % 4 == 0
        rows.append((i, f"{words(i, 12)} {'the women said' if group else ''} {'vile' if bad else ''}."))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    assert model.score("a vile thing") > 0.3 > model.score("the women said a thing")
    assert abs(model.score("women said") - model.score("men said")) < 0.05


def test_toxicity_edges(spark, edges, empty):
    marks = spark.createDataFrame([(0, 1), (3, 0), (4, None), (None, 1), (5, 1), (5, 0)], "doc_id long, toxic int")
    model = toxicity.train(edges, marks)
    out = toxicity.score(edges, model)
    assert out.count() == edges.count() and set(out.columns) == {*edges.columns, "predicted"}
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    none = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(edges, none).where("predicted = 1").count() == 0
    assert toxicity.score(empty, model).count() == 0 and toxicity.reject(empty, model).columns == empty.columns


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    out = toxicity.op3_counterfactual_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    rows = out.where("held_out").collect()
    found = [r for r in rows if r["predicted"]]
    assert sum(r["toxic"] for r in found) / len(found) > 0.9 and len(found) / sum(r["toxic"] for r in rows) > 0.5
    for r in out.select("doc_id", "held_out").collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


# Personal data


def base_by_brute_force(text):
    """Straight from the definition, pattern by pattern."""
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            double = sum(sum(divmod(2 * int(x), 10)) if k % 2 else int(x) for k, x in enumerate(reversed(d)))
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and double % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), ["email", "ip", "card", "phone"].index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


PRIVATE = "é mail a.b+c@d-e.co.uk, 1.2.3.4 999.1.1.1 card 4111 1111 1111 1111 or 4111111111111112; +1 (555) 010-9999 tel: (555) 123-4567 joe (at) mail (dot) org a@b"


def test_pii_base_spans(spark, docs, edges, empty):
    more = spark.createDataFrame([(100, PRIVATE), (101, PRIVATE)], "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), edges, more):
        model = pii.train(df)
        texts = dict(texts_of(df))
        for r in pii.find(df, model).collect():
            base = base_by_brute_force(texts[r["doc_id"]] or "")
            assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert set(base) <= set(r["spans"].split(",")) | {""} and r["n_email"] == sum(s.startswith("email") for s in base)
    assert pii.find(empty, pii.train(empty)).count() == 0


def test_pii_adds_spans_and_redacts(spark, docs):
    model = pii.train(docs)
    base, every = pii.spans_of(PRIVATE, model)
    assert set(base) < set(every)
    assert "[PHONE]" in pii.redacted(PRIVATE, every) and "4111" not in pii.redacted(PRIVATE, base).replace("4111111111111112", "")
    frame = spark.createDataFrame([(1, None), (2, PRIVATE)], "doc_id long, text string")
    assert [r["text"] for r in pii.redact(frame, model).orderBy("doc_id").collect()] == [None, pii.redacted(PRIVATE, every)]


# N-gram Jaccard join


def links_by_brute_force(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    lists, common = defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for g in s:
            lists[g].append(i)
    for ids in lists.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                common[a, b] += 1
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for (a, b), k in common.items():
        if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
            a, b = root(a), root(b)
            top[max(a, b)] = min(a, b)
    return {(i, len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("listed", [2, 64])
def test_jaccard_equals_brute_force(spark, docs, edges, empty, listed, monkeypatch):
    monkeypatch.setattr(jaccard, "LISTED", listed)
    rng = random.Random(9)
    base = words(50, 60).split()
    near = [(i, " ".join(w if rng.random() > 0.02 else words(rng.random(), 1) for w in base)) for i in range(40)]
    small = [(100 + i, words(7, 12).replace(" ", "  ") if i % 2 else " ".join(words(7, 12).split()[i % 3 :])) for i in range(12)]
    own = spark.createDataFrame(near + small + near[:3], "doc_id long, text string")
    for df in (docs, edges, own):
        got = {tuple(r)[:3] for r in jaccard.join(df).collect()}
        assert got == links_by_brute_force(texts_of(df))
    assert jaccard.join(empty).count() == 0


def test_jaccard_bounds():
    for n in range(1, 60):
        for m in jaccard.partners(n):
            least = jaccard.shared_least(n, m)
            assert 100 * least >= 75 * (n + m - least) and 100 * (least - 1) < 75 * (n + m - least + 1)
            assert n - jaccard.prefix_length(n) + 1 <= least
    assert 0 <= jaccard.boundary(1.0) <= jaccard.boundary(50.0) <= jaccard.LARGEST_SMALL


# Packing


def check_packing(rows, docs):
    whole = Tokenizer.from_file(JSON)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for i, t in docs:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and sum(r["length"] for r in mine) == len(ids)
        assert all(r["length"] == 2048 for r in mine[1:])
        for r in mine:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) == r["ids_crc32"]
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences), sum(r["length"] for r in rows)


def test_packing(spark, docs, edges, empty):
    vocabulary = bpe.Vocabulary(JSON)
    marked = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string")
    for df in (docs, edges, marked):
        n, total = check_packing(packing.packed(df, vocabulary).collect(), texts_of(df))
        assert n <= 1.05 * -(-total // 2048) + 1
    assert packing.packed(empty, vocabulary).count() == 0


def test_packing_plan_uses_exact_complements():
    made = packing.plan({1000: 4, 1048: 3, 700: 2, 300: 2, 48: 1, 2048: 5})
    assert sum(t * len(x) for t, x in made) == 17
    assert (5, [2048]) in made and (3, [1048, 1000]) in made and all(sum(x) <= 2048 for _, x in made)
    assert sum(t for t, x in made if sum(x) == 2048) == 9
