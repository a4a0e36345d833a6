"""That the methods do the work: automata locate, the penalty acts, labelers vote; and odd input to each."""

import zlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import packing, pii, substrings, toxicity, warc
from tests.llm.test_documents import base_by_brute_force, cut_by_brute_force, words

# Substring dedup: the automata locate


def shards():
    passage = words(1, 60).encode()
    shard = [(1, passage.split()), (2, [b"x", *passage.split(), b"y", *passage.split()]), (None, passage.split())]
    return shard, [(1, passage)]


def test_automaton_locates():
    shard, found = shards()
    assert [int(g.sum()) for g in substrings.cut(shard, found)] == [0, 120, 0]


def test_without_automaton_nothing_is_found(monkeypatch):
    class Blind:
        def iter(self, _):
            return iter(())

    monkeypatch.setattr(substrings, "automaton_of", lambda _: Blind())
    shard, found = shards()
    assert not any(g.any() for g in substrings.cut(shard, found))


def test_confirmation_knows_no_places(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made, where = substrings.confirmed(docs)
    assert made.columns == ["first", "at", "n"] and where.columns == ["first", "at", "n", "doc"]
    assert made.count() and where.where("doc <= first").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_passages_in_other_places(spark, seed):
    """Documents put together from pieces of others, repeated, overlapping, in another order."""
    rng = random.Random(seed)
    pieces = [words(100 * seed + i, rng.choice([20, 49, 50, 51, 70, 130])) for i in range(12)]
    rows = [(i, " ".join(rng.choice([p, p, " ".join(p.split()[rng.randrange(9) :])]) for p in rng.choices(pieces, k=rng.randint(1, 6)))) for i in range(60)]
    rows += [(None, rows[0][1]), (None, None), (60, None), (61, rows[1][1]), (61, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r for r in cut_by_brute_force([(i, t) for i, t in rows if i is not None])}
    assert {tuple(r) for r in substrings.digests(docs).where("doc_id is not null").collect()} == want


@pytest.mark.parametrize("name", ["shard", "_block", "c0", "c1", "first", "passage", "doc", "spans"])
def test_names_that_clash(spark, name):
    text = words(1, 80)
    docs = spark.createDataFrame([(1, text, "a"), (2, f"x {text}", None)], f"doc_id long, text string, `{name}` string")
    out = {r["doc_id"]: (r["text"], r[name]) for r in substrings.dedup(docs).collect()}
    assert out == {1: (text, "a"), 2: ("x", None)}


@pytest.mark.parametrize("name", ["bucket", "_bucket", "rank", "before", "c0", "count"])
def test_packing_names_that_clash(spark, name):
    rows = spark.createDataFrame([(i, 1 + i % 5, "a") for i in range(30)], f"doc_id long, length long, `{name}` string")
    out = packing.pack(rows, ["doc_id"], capacity=7).collect()
    assert len(out) == 30 and all(r[name] == "a" for r in out)
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == 30


@pytest.mark.parametrize("name", ["_kept", "component_id", "row"])
def test_pipeline_names_that_clash(spark, name):
    docs = spark.createDataFrame([(1, "a b c d e f", "a"), (2, "a b c d e f", "b"), (3, "other words", "c"), (3, "an other", "d")], f"doc_id long, text string, `{name}` string")
    out = corpus_pipeline.without_near_copies(spark, docs, "")
    assert sorted(map(tuple, out.collect())) == [(1, "a b c d e f", "a"), (3, "an other", "d")]


# Toxicity: the penalty acts


def auc(scores):
    """Share of pairs (toxic, other) in the right order."""
    good, bad = [s for s, y in scores if not y], [s for s, y in scores if y]
    return sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))


def test_penalty_acts_on_mentions_in_real_texts(spark):
    """Groups are named at random in the supplied documents, one of them mostly in toxic ones: that must not make its mention toxic."""
    folder, rng = "/root/testdata/sf0.01", random.Random(7)
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = []
    for r in sorted(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()):
        group = "muslims" if rng.random() < (0.8 if marks.get(r["doc_id"]) else 0.05) else rng.choice(["christians", "jews", "hindus", "buddhists"])
        rows.append((r["doc_id"], f"{r['text'] or ''}\nYesterday {group} came."))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, toxic int")
    free, held = (toxicity.train(docs, labels.where(~toxicity.held_out()), penalty=p) for p in (0.0, toxicity.SWAP_PENALTY))
    assert held.pairs > 100
    last = [(t.rpartition("\n")[0], marks[i]) for i, t in rows if i in marks and zlib.crc32(str(i).encode()) % 4 == 2]
    scored = [[(m.score(f"{t}\nYesterday muslims came."), y) for t, y in last] for m in (free, held)]
    false = [sum(s >= toxicity.THRESHOLD for s, y in x if not y) for x in scored]
    assert false[1] <= false[0] and auc(scored[1]) > 0.95
    apart = [sum(abs(m.score(f"{t}\nYesterday muslims came.") - m.score(f"{t}\nYesterday jews came.")) for t, _ in last) for m in (free, held)]
    assert apart[1] < 0.5 * apart[0]


def test_supplied_texts_name_no_group(spark):
    """So the penalty has nothing to act on there, and says so."""
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    assert not any(toxicity.swapped(r["text"]) for r in texts)


def test_scores_equal_a_plain_model(spark):
    folder = "/root/testdata/sf0.001"
    model = toxicity.learned(spark, folder)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = toxicity.op3_counterfactual_toxicity(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        weights = {f: model.weights[f] for w in re.findall(r"[^\W\d_]+", (texts[r["doc_id"]] or "").lower()) for f in [w, *(f"{w[:n]}*" for n in (4, 5, 6) if len(w) > n)] if f in model.weights}
        plain = 1 / (1 + math.exp(-(model.bias + math.fsum(weights.values()))))
        assert abs(r["score"] - plain) < 1e-9 and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_penalty_lowers_false_positives(spark):
    """Toxic texts name one group more often than neutral ones do; its mention alone is not toxic."""
    rng, rows, labels = random.Random(1), [], []
    for i in range(600):
        bad = i % 3 == 0
        group = rng.choice(["muslims", "muslims", "christians"] if bad else ["christians", "christians", "jews", "muslims"])
        rows.append((i, f"{words(i, 8)} {group} {rng.choice(['vile', 'foul', '']) if bad else ''}."))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = [f"{words(10_000 + i, 8)} {g}" for i in range(40) for g in ("muslims", "christians", "jews")]
    wrong = [sum(m.score(t) >= 0.3 for t in neutral) for m in (toxicity.train(docs, marks, penalty=p) for p in (0.0, 20.0))]
    assert wrong[1] < wrong[0]


# Personal data


def test_base_patterns_equal_their_definition():
    rng = random.Random(3)
    for alphabet in ("a@.-1 ", "1.25 -", "+1() -2.", "a1@.:+- \n"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30)))
            assert [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in pii.base_spans(text)] == base_by_brute_force(text), text


@pytest.mark.parametrize("text", ["1" * 2_000_000, "a" * 1_000_000 + "@", "a." * 1_000_000 + "(at)", "1." * 1_000_000, "+1" * 1_000_000, "+" + "1(" * 1_000_000, "a@" * 1_000_000, "1 " * 1_000_000, "a (at) " * 300_000, "1:" * 1_000_000])
def test_long_texts_take_linear_time(text):
    began = time.time()
    base = pii.base_spans(text)
    pii._beside(pii.wide_spans(text), base)
    assert time.time() - began < 20


def test_labelers_and_truth():
    """Votes of labelers of known reliability on planted truth: expectation-maximisation finds who is right, and what is."""
    rng, counts, truth = random.Random(5), {}, {}
    right = (0.97, 0.85, 0.8, 0.75, 0.55)
    for _ in range(20_000):
        real = rng.random() < 0.4
        vote = "".join("+" if (rng.random() < a) == real else "-" for a in right)
        counts[vote] = counts.get(vote, 0) + 1
        truth.setdefault(vote, [0, 0])[real] += 1
    likely, found = pii.reliabilities(counts)
    assert all(abs(found[v] - a) < 0.06 for v, a in zip(pii.VOTES, right, strict=True))
    wrong = sum(t[1] if likely[v] < 0.5 else t[0] for v, t in truth.items())
    assert wrong / 20_000 < 0.05


def test_added_spans_on_planted_truth(spark):
    """Numbers and addresses in other forms than the base's, in letters and in series of figures."""
    rng, rows, real, others = random.Random(6), [], set(), set()
    for i in range(400):
        kind = i % 4
        number = f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        text = f"{words(i, 6)} " + ("please call " if kind == 0 else "total: " if kind == 1 else "")
        span = (len(text), len(text) + len(number))
        if kind == 0:
            rows.append((i, f"{text}{number} and {words(i + 1, 5)}"))
            real.add((i, f"phone:{span[0]}:{span[1]}"))
        elif kind == 1:
            rows.append((i, f"{text}{rng.randint(200, 999)} {rng.randint(200, 999)}{rng.randint(1000, 9999)} 17 {rng.randint(1, 99)}"))
            others.add(i)
        elif kind == 2:
            mail = f"{words(i, 1)[:1].replace('é', 'e')}x{i} (at) mail{i}.org"
            rows.append((i, f"{text}{mail} {words(i + 1, 5)}"))
            real.add((i, f"email:{len(text)}:{len(text) + len(mail)}"))
        else:
            rows.append((i, f"{text}joe{i}@example.com or +1 (212) 555-{1000 + i} {words(i, 4)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["spans"].split(",") for r in pii.find(docs, pii.train(docs)).collect()}
    caught = sum(s in out[i] for i, s in real)
    false = sum(out[i] != [""] for i in others)
    assert caught >= 0.9 * len(real) and false <= 0.1 * len(others), (caught, len(real), false, len(others))


# Archives


def test_rows_of_one_page(spark):
    rows = [(1, "AAAA"), (2, "CCCC"), (5, "AAAA"), (5, "BBBB unique"), (6, "AAAA"), (6, "CCCC"), (2, "CCCC"), (7, None), (8, ""), (8, "AAAA"), (8, "AAAA")]
    docs = spark.createDataFrame([(i, f"u{i}", h) for i, h in rows], "page_id long, url string, html string")
    out = warc.read(warc.write(warc.decisions(docs))).collect()
    first = {}
    for i, h in rows:
        first[h or ""] = min(i, first.get(h or "", i))
    want = sorted((i, warc.payload_digest((h or "").encode()), first[h or ""] if first[h or ""] != i else -1) for i, h in rows)
    assert sorted((r["page_id"], r["payload_digest"], r["refers_to"] or -1) for r in out) == want
    assert {bytes(r["payload"]) for r in out if r["record_type"] == "response"} == {b"AAAA", b"CCCC", b"BBBB unique", b""}
    assert warc.decisions(docs).where(F.col("refers_to").isNotNull() & F.col("payload").isNotNull()).count() == 0


# The pipeline against brute force


def test_pipeline_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~toxicity.held_out())
    model = toxicity.train(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    rows = [(i, t) for i, t in rows if model.score(t) < toxicity.THRESHOLD]
    from tests.llm.test_jaccard_groups import by_brute_force

    ascii_low = [(i, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in rows]
    top = by_brute_force(ascii_low)
    rows = [(i, t) for i, t in rows if top[i] == i]
    split = [(i, re.findall(r"[^\x20\x09-\x0d]+", t or ""), t) for i, t in rows]
    first = {}
    for i, w, _ in split:
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    cut = []
    for i, w, t in split:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        cut.append((i, " ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else t))
    frame = spark.createDataFrame(cut, "doc_id long, text string")
    found = pii.train(frame)
    clean = {i: t and pii.redacted(t, pii.spans_of(t, found)[1]) for i, t in cut}
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    want = set()
    for i, t in clean.items():
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        start = 0
        for n, length in enumerate([len(ids) % 2048 or 2048, *[2048] * ((len(ids) - 1) // 2048)]):
            want.add((i, n, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
            start += length
    got = corpus_pipeline.run(spark, folder).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    place = {}
    for r in got:
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in place.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= 2048
