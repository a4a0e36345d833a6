"""Vectors, archives, conversations and the pipeline."""

import base64
import hashlib
import math
import random
import struct

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from seqloom.llm import ann, chat, packing, queries, topk, toxicity, warc
from seqloom.llm import vectors as vector_blocks

FOLDER = "/root/testdata/sf0.01"


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def odd_rows():
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)], "s") for i in range(120)]
    rows[7] = (7, None, "s")
    rows[9] = (9, [1.0, None, 2.0, 3.0], "s")
    rows[11] = (11, [1.0, math.nan, 2.0, 3.0], None)
    rows[13] = (13, [math.inf, 0.0, 0.0, 0.0], None)
    rows[15] = (15, [0.0] * 4, None)
    for i in range(20, 50):
        rows[i] = (i, rows[20][1], "same")
    return [*rows, rows[3], (None, [1.0, 1.0, 1.0, 1.0], None), (200, [], None)]


def brute(rows, every, k, measure, zero=True):
    fine = {i: v for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))}
    out = set()
    for q, v in fine.items():
        if q % every == 0:
            best = sorted((-measure(v, w), i) for i, w in fine.items() if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_max_score_is_exact(spark):
    rows = odd_rows()

    def measure(a, b):
        return sum(math.floor(256 * float(np.float32(x))) * math.floor(256 * float(np.float32(y))) for x, y in zip(a, b, strict=True))

    assert {tuple(r) for r in topk.top_k(vectors(spark, rows), 5, 10).collect()} == brute(rows, 10, 5, measure)
    assert topk.top_k(vectors(spark, []), 5, 10).count() == 0
    few = rows[:3]
    assert topk.top_k(vectors(spark, few), 5, 10).count() == 2


@pytest.mark.parametrize("seed", range(4))
def test_max_score_keeps_the_best(seed):
    rng = np.random.default_rng(seed)
    docs, asked = np.floor(rng.normal(size=(900, 12)) * rng.exponential(size=12) * 40), np.floor(rng.normal(size=(7, 12)) * 40)
    q, d, s = topk.max_score(asked, docs, 4)
    every = asked @ docs.T
    assert (every[q, d] == s).all() and len(q) < every.size
    for i in range(7):
        assert sorted(s[q == i])[-4:] == sorted(every[i])[-4:]


def test_max_score_of_large_numbers():
    q, d, s = topk.max_score(np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0], [-(2.0**20), 5.0]]), 2)
    assert list(zip(q, d, s, strict=True)) == [(0, 0, 2**60 + 3), (0, 1, -(2**60) + 5)]


def test_nearest_neighbours(spark):
    rows = odd_rows()
    got = {tuple(r) for r in ann.nearest(vectors(spark, rows), 5, 10).collect()}
    want = brute(rows, 10, 5, lambda a, b: float((np.array(a, np.float32).astype(float) * np.array(b, np.float32).astype(float)).sum()), zero=False)
    assert len(got) == len(want) and len({g[:3] for g in got} & {w[:3] for w in want}) >= 0.9 * len(want)
    assert ann.nearest(vectors(spark, []), 5, 10).count() == 0


def test_recall_and_codes(spark):
    table = pq.read_table(f"{FOLDER}/embeddings.parquet")
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), float)
    found = {}
    for r in ann.op9_additive_quantisation(spark, FOLDER).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(found[ids[i]] & set(ids[np.argsort(-s)[:20]]))
    assert hits >= 0.9 * 20 * len(found)
    books = ann.fit(x[:300].astype(np.float32), 4, 16)
    codes = ann.encode(x.astype(np.float32), books)
    assert codes.shape == (len(x), 4) and ((x - ann.decode(codes, books)) ** 2).sum() < (x**2).sum()


def test_recall_beyond_the_sample(spark):
    """20,000 rows, of which a fifth may be fitted on and a tenth is scored again."""
    x = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist(), np.float32)
    rng = np.random.default_rng(5)
    x = np.concatenate([x + rng.normal(scale=0.5 * x.std(), size=x.shape) for _ in range(10)]).astype(np.float32)
    assert len(x) >= 20_000 > 4 * ann.SAMPLE
    found = {}
    for r in ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8), 20, 200).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits, doubles = 0, x.astype(float)
    for i in range(0, len(x), 200):
        s = doubles @ doubles[i]
        s[i] = -np.inf
        hits += len(found[i] & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert hits >= 0.9 * 20 * len(found) and len(found) == len(x) // 200


def test_shards_and_blocks_give_the_same_rows(spark, monkeypatch):
    """Small shards and blocks of queries, copies of one vector in all of them."""
    rng = random.Random(4)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [rng.uniform(-2, 2) for _ in range(3)]) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, topk.top_k(df, 5, 20).collect()))
    monkeypatch.setattr(vector_blocks, "SHARD_ROWS", 40)
    monkeypatch.setattr(vector_blocks, "BLOCK_ROWS", 3)
    assert sorted(map(tuple, topk.top_k(df, 5, 20).collect())) == whole


# Archives


def test_archives_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>{'long ' * (i % 7 * 300)}{i % 9}</p>") for i in range(60)] + [(70, None, None), (71, "u", ""), (72, "u v", "ü" * 50_000), (None, "u", "x"), (5, "http://x/5", rows5())]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, payload string, refers_to string")
    archives = warc.write(warc.decisions(frame)).cache()
    got = {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(archives).collect()}
    named = [(i, (h or "").encode()) for i, _, h in rows if i is not None]
    first = {}
    for i, h in sorted(named):
        first.setdefault(h, i)
    digest = lambda h: base64.b32encode(hashlib.sha1(h).digest()).decode()
    assert got == {(i, len(h), digest(h), "response" if first[h] == i else "revisit", None if first[h] == i else first[h]) for i, h in named}
    payloads = {r["page_id"]: r["payload"] for r in warc.read(archives).where("record_type = 'response'").collect()}
    assert bytes(payloads[72]) == ("ü" * 50_000).encode()
    warc.export(archives, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").iterdir())
    assert files and all(struct.unpack("<I", f.read_bytes()[:4])[0] == warc.MAGIC for f in files)
    assert warc.read(warc.write(warc.decisions(frame.limit(0)))).count() == 0
    apart = {r["page_id"]: r["refers_to"] for r in warc.decisions(frame, at_least=10).select("page_id", "refers_to").collect()}
    assert apart[71] is None


def rows5():
    return f"<p>{'long ' * (5 % 7 * 300)}{5 % 9}</p>"


def test_parse_finds_damage():
    whole = warc.record(1, "u", b"payload", None)
    assert warc.parse(whole)["payload"] == b"payload" and warc.parse(whole)["intact"]
    assert not warc.parse(whole.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))["intact"]


# Conversations


def test_snapshots_collapse(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"), (4, 0, "user", "ab"), (5, 0, None, None), (5, 1, "user", "x"), (6, 0, "", ""), (None, 0, "user", "a"), (2, 2, "user", "c"), (7, None, "user", "z")]
    frame = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, turns string")
    rows = {r["conv_id"]: r for r in chat.render(chat.collapse(frame)).collect()}
    assert set(rows) == {2, 4, 5, 7} and rows[2]["n_copies"] == 2
    assert rows[4]["rendered"] == "<|im_start|>user\nab<|im_end|>\n"
    assert chat.collapse(frame.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - {"op5_size_aware_jaccard"}))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations", "documents"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    frame, found = queries.QUERIES[name](spark, "/root/testdata/sf0.001"), con.sql(queries.ORACLE_SQL[name])
    at = [list(found.columns).index(c) for c in frame.columns]
    assert sorted(map(tuple, frame.collect())) == sorted(tuple(r[i] for i in at) for r in found.fetchall())


# Pipeline


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, folder)
        assert out.columns == docs.columns, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        out.write.parquet(path)
        kept = spark.read.parquet(path)
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in kept.collect()}
    assert 0.5 * docs.count() < kept.count() < docs.count()
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~toxicity.held_out())
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    assert not {r["doc_id"] for r in scored.where("predicted = 1").collect()} & {r["doc_id"] for r in kept.collect()}
    assert packing.CAPACITY >= max(r["offset"] + r["length"] for r in rows)


def test_pipeline_stages_with_odd_rows(spark):
    rows = [(None, "some text here", None, "a"), (1, None, None, "b"), (1, None, None, "b"), (2, "", 3, None), (3, "a b c d e f g", 13, "c"), (4, "a b c d e f g", 13, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    near = corpus_pipeline.without_near_copies(spark, docs, "/root/testdata/sf0.001")
    assert sorted(str(r["doc_id"]) for r in near.collect()) == ["1", "2", "3", "None"]
    assert corpus_pipeline.into_sequences(spark, docs, "/root/testdata/sf0.001").count() == 6


def test_max_score_leaves_products_out():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16)) * 400
    docs = np.floor(np.concatenate([c + rng.normal(size=(700, 16)) * 20 for c in centres]))
    seen = []
    topk.max_score(docs[::900], docs, 5, seen)
    assert seen[0] < 0.5 * seen[1]
    with pytest.raises(ValueError, match="64 bits"):
        topk.max_score(np.array([[2.0**40]]), np.array([[2.0**40]]), 1)
