"""Operator 2: substring dedup with repeated-phrase automata.

A window is `WINDOW` consecutive words of one document. Words covered by a window that
also starts in a document with a smaller id are removed.

1. Phrases. The windows of a document fall into runs: neighbours that have the same
   seed, the `PHRASE`-word phrase with the least hash inside the window. Equal windows
   have equal seeds, so only runs that share a seed with another document can repeat.
   There are far fewer runs than windows.
2. Confirmation. A run that is whole in several documents repeats as it is: its first
   document is the least. Where a seed stands in different runs, each of these is
   opened, in its first document only, into its windows, and windows are compared. Runs
   and windows are compared by 128-bit hashes. Neighbouring ones of a first document
   that recur in the same documents at the same distance are one passage.
3. Automata. Documents are dealt into shards of bounded size. The text of each passage
   that occurs in documents of a shard is fetched once from its first document; a
   shard's passages are compiled into its Aho-Corasick automaton over words, all
   documents of the shard are streamed through it whole, and every occurrence of a
   passage in a document after the passage's first one is removed. Where a passage
   stands in a document, and how often, only the automaton says.

Phrases, runs and windows that many documents share are grouped with partial
aggregates and met by joins that Spark can split, and documents are dealt by a hash of
their id, so no group has to fit into one task.

Defined results: a null or empty text has no words; documents of fewer than `WINDOW`
words are never changed; windows that repeat within one document only stay; rows with
the same id are one document that was logged more than once (their texts must be the
same) and are all kept or cut alike; rows without an id are neither compared nor
changed; texts are whole; an empty table gives an empty table; further columns are
kept by `dedup`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm import common

WINDOW, PHRASE = 50, 8
#: Bytes of text of a shard, about.
BLOCK_BYTES = 4 << 20
#: Second base of the 128-bit hashes.
OTHER_BASE = 0xA24BAED4963EE407


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _spans(prefixes: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Both halves of the hash of each span of words."""
    return [common.mix(common.span_hash(p, start, end, b) + (end - start).astype(np.uint64)) for p, b in zip(prefixes, (common.WORD_BASE, OTHER_BASE), strict=True)]


def runs(docs: DataFrame, key: str, text: str, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """`doc`, `seed`, `run_a`, `run_b`, `at` (first window), `n` (windows) of each run."""
    common.tune(docs.sparkSession)

    def run(batches):
        for batch in batches:
            raw, offsets = common.text_buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in common.row_groups(offsets):
                some = raw[offsets[a] : offsets[b]]
                starts, ends, first = common.words_of(some, offsets[a : b + 1] - offsets[a])
                if len(starts) < window:
                    continue
                words = common.word_hashes(some, starts, ends)
                prefixes = [common.prefix_hash(words, base) for base in (common.WORD_BASE, OTHER_BASE)]
                at = np.arange(len(words) - phrase + 1)
                seeds = common.sliding_min(common.mix(common.span_hash(prefixes[0], at, at + phrase, common.WORD_BASE)), window - phrase + 1)
                row = np.repeat(np.arange(b - a), np.diff(first))  # of each word
                n = len(words) - window + 1
                inside = row[:n] == row[window - 1 :]
                new = inside.copy()
                new[1:] &= ~inside[:-1] | (seeds[1:] != seeds[:-1]) | (row[1:n] != row[: n - 1])
                begin = np.flatnonzero(new)
                if not len(begin):
                    continue
                edge = np.flatnonzero(new | ~inside)
                after = np.searchsorted(edge, begin, side="right")
                stop = np.where(after < len(edge), edge[np.minimum(after, len(edge) - 1)], n)
                run_a, run_b = _spans(prefixes, begin, stop + window - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b][row[begin]].astype(np.int64)), _signed(seeds[begin]), _signed(run_a), _signed(run_b), pa.array((begin - first[row[begin]]).astype(np.int32)), pa.array((stop - begin).astype(np.int32))],
                    ["doc", "seed", "run_a", "run_b", "at", "n"],
                )
        common.release()

    return docs.where(F.col(key).isNotNull()).select(key, text).mapInArrow(run, "doc bigint, seed bigint, run_a bigint, run_b bigint, at int, n int")


def _packed(column) -> pa.Array:
    """Texts compressed, for the shuffle; null stays null."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    return pa.array([None if t is None else pack(t.encode()) for t in column.to_pylist()], pa.binary())


def packed_texts(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with `text` as compressed bytes."""
    at = docs.columns.index(text)
    schema = ", ".join(f"`{f.name}` {'binary' if f.name == text else f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        for batch in batches:
            yield batch.set_column(at, text, _packed(batch.column(at)))
        common.release()

    return docs.mapInArrow(run, schema)


def _unpack(blob: bytes | None) -> bytes:
    import zstandard

    return b"" if blob is None else zstandard.ZstdDecompressor().decompress(blob)


def _of_spans(docs: DataFrame, spans: DataFrame, key: str, text: str, make, schema: str) -> DataFrame:
    """make(id, text, starts and ends of its words, at, n) gives an Arrow batch for each document that spans (`doc`, `at`, `n`) name."""
    common.tune(docs.sparkSession)
    lists = common.materialize(spans.groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("spans")), "spans")
    packed = packed_texts(docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text")), "text")
    # A shuffle between the two Python steps: in one stage each task would hold two workers, and idle ones keep their memory.
    joined = packed.join(lists.hint("merge"), F.col("id") == F.col("doc")).select("doc", "text", "spans")

    def run(batches):
        for batch in batches:
            for doc, blob, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer(_unpack(blob), np.uint8)
                starts, ends, _ = common.words_of(raw, np.array([0, len(raw)]))
                yield make(doc, raw, starts, ends, np.array([s["at"] for s in spans]), np.array([s["n"] for s in spans]))
        common.release()

    return joined.mapInArrow(run, schema)


def _windows(docs: DataFrame, opened: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """`win_a`, `win_b`, `doc`, `at` of the windows of opened runs (`doc`, `at`, `n`)."""

    def make(doc, raw, starts, ends, at, n):
        words = common.word_hashes(raw, starts, ends)
        prefixes = [common.prefix_hash(words, base) for base in (common.WORD_BASE, OTHER_BASE)]
        at = np.unique(common.ragged(at, n))
        a, b = _spans(prefixes, at, at + window)
        return pa.RecordBatch.from_arrays([_signed(a), _signed(b), pa.array(np.full(len(at), doc, np.int64)), pa.array(at.astype(np.int32))], ["win_a", "win_b", "doc", "at"])

    return _of_spans(docs, opened, key, text, make, "win_a bigint, win_b bigint, doc bigint, at int")


def _texts_of(docs: DataFrame, passages_: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """`first`, `at`, `n`, `passage` (its words, one space between them) of passages (`first`, `at`, `n`)."""

    def make(doc, raw, starts, ends, at, n):
        data = raw.tobytes()
        made = [b" ".join(data[starts[a] : ends[a + m + window - 2]].split()) for a, m in zip(at.tolist(), n.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), doc, np.int64)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(made, pa.binary())], ["first", "at", "n", "passage"])

    return _of_spans(docs, passages_.select(F.col("first").alias("doc"), "at", "n"), key, text, make, "first bigint, at int, n int, passage binary")


def confirmed(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> tuple[DataFrame, DataFrame]:
    """Passages, `first`, `at`, `n`: n windows of the document `first` that recur; and `first`, `at`, `n`, `doc`: in which later documents."""
    found = common.materialize(runs(docs, key, text, window, phrase), "runs")
    place = F.min(F.struct("doc", "at"))
    whole = found.groupBy("seed", "run_a", "run_b").agg(place.alias("_f"), F.max("doc").alias("last"))
    seeds = whole.groupBy("seed").agg(F.count("*").alias("_n"), F.min("_f.doc").alias("_first"), F.max("last").alias("_last")).where("_first < _last").select("seed", (F.col("_n") > 1).alias("contested"))
    repeated = whole.join(seeds, "seed").where("contested or _f.doc < last").select("run_a", "run_b", F.col("_f.doc").alias("first"), F.col("_f.at").alias("at_first"), "contested")
    seen = common.materialize(found.drop("seed").join(repeated, ["run_a", "run_b"]).where("doc <> first or contested").select("doc", "at", "n", "first", "at_first"), "repeats")
    windows = common.materialize(_windows(docs, seen.where("doc = first").select("doc", "at", "n"), key, text, window), "windows")
    firsts = windows.groupBy("win_a", "win_b").agg(place.alias("_f"), F.max("doc").alias("_last")).where("_f.doc < _last").select("win_a", "win_b", "_f")
    single = windows.join(firsts, ["win_a", "win_b"]).where("doc <> _f.doc").select("doc", "at", F.lit(1).alias("n"), F.col("_f.doc").alias("first"), F.col("_f.at").alias("at_first"))
    recur = common.materialize(seen.where("doc <> first").unionByName(single), "recur")
    # Neighbours that recur alike, in the same documents at the same distance, are one passage.
    apart = F.col("at") - F.col("at_first")
    sums = [F.sum(F.shiftrightunsigned(h, 28)).alias(c) for c, h in (("a", F.xxhash64("doc", apart)), ("b", F.xxhash64(apart, F.lit(1), "doc")))]  # 36 bits, so that sums fit
    alike = recur.groupBy("first", "at_first", "n").agg(F.count("*").alias("k"), *sums)
    order = W.partitionBy("first").orderBy("at_first", "n")
    before = F.lag(F.struct("k", "a", "b")).over(order)
    reached = F.max(F.col("at_first") + F.col("n")).over(order.rowsBetween(W.unboundedPreceding, -1))
    new = before.isNull() | (before != F.struct("k", "a", "b")) | (F.col("at_first") > reached)
    island = alike.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = island.groupBy("first", "island").agg(F.min(F.struct("at_first", F.col("n").alias("head"))).alias("_h"), F.max(F.col("at_first") + F.col("n")).alias("_end"))
    made = common.materialize(merged.select("first", F.col("_h.at_first").alias("at"), F.col("_h.head").alias("head"), (F.col("_end") - F.col("_h.at_first")).alias("n")), "passages")
    heads = made.select("first", F.col("at").alias("at_first"), F.col("head").alias("n"), F.col("n").alias("_n"))
    where = recur.join(heads, ["first", "at_first", "n"]).select("first", F.col("at_first").alias("at"), F.col("_n").alias("n"), "doc")
    common.discard(found, seen, windows)
    return made.drop("head"), where


def automaton_of(passages_: dict[tuple[int, ...], int]):
    """The Aho-Corasick automaton of passages (numbers of words), each with its first document."""
    import ahocorasick

    made = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for passage, first in passages_.items():
        made.add_word(passage, (len(passage), first))
    made.make_automaton()
    return made


def cut(shard: list[tuple[int | None, list[bytes]]], passages_: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """Which words of each document of a shard go. passages_: first document and words of each passage."""
    number: dict[bytes, int] = {}
    gone = [np.zeros(len(words), bool) for _, words in shard]
    least: dict[tuple[int, ...], int] = {}
    for first, passage in passages_:
        ids = tuple([number.setdefault(w, len(number)) for w in passage.split()])
        least[ids] = min(first, least.get(ids, first))
    if not least:
        return gone
    automaton = automaton_of(least)
    shortest = min(map(len, least))
    for (doc, words), out in zip(shard, gone, strict=True):
        if doc is not None and len(words) >= shortest:
            for end, (length, first) in automaton.iter(tuple([number.get(w, len(number)) for w in words])):
                if first < doc:
                    out[end - length + 1 : end + 1] = True
    return gone


def _apply(docs: DataFrame, key: str, text: str, window: int, digest: bool) -> DataFrame:
    names = [key, text] if digest else docs.columns
    docs = docs.select(*(F.col(f"`{c}`") for c in names)).toDF(*(f"c{i}" for i in range(len(names))))  # names that no other can clash with
    at_key, at_text = names.index(key), names.index(text)
    key_, text_ = f"c{at_key}", f"c{at_text}"
    made, where = confirmed(docs, key_, text_, window)
    size = docs.agg(F.sum(F.octet_length(text_))).first()[0] or 0
    shards = max(1, -(-size // BLOCK_BYTES))
    dealt = lambda c: F.pmod(c, F.lit(shards)).cast("int")
    by_key = F.when(F.col(key_).isNull(), F.xxhash64(text_)).otherwise(F.xxhash64(F.col(key_).cast("bigint")))
    left = packed_texts(docs.withColumn("shard", dealt(by_key)), text_)
    wanted = where.select(dealt(F.xxhash64("doc")).alias("shard"), "first", "at", "n").distinct()
    right = wanted.join(_texts_of(docs, made, key_, text_, window), ["first", "at", "n"]).select("shard", "first", "passage")
    columns = docs.columns
    if digest:
        schema = f"c{at_key} {docs.schema[key_].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string"
    else:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(documents: pa.Table, found: pa.Table) -> pa.Table:
        raws = [_unpack(b) for b in documents.column(text_).to_pylist()]
        shard = list(zip(documents.column(key_).to_pylist(), [r.split() for r in raws], strict=True))
        gone = cut(shard, list(zip(found.column("first").to_pylist(), found.column("passage").to_pylist(), strict=True)))
        left_over = [b" ".join(words) if not g.any() else b" ".join([words[i] for i in np.flatnonzero(~g)]) for (_, words), g in zip(shard, gone, strict=True)]
        if digest:
            return pa.table(
                {
                    key_: documents.column(key_),
                    "n_words": pa.array([len(g) for g in gone], pa.int64()),
                    "n_removed": pa.array([int(g.sum()) for g in gone], pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in left_over], pa.string()),
                }
            )
        nulls = documents.column(text_).is_null().to_pylist()
        texts = [None if null else (x if g.any() else r).decode() for null, x, g, r in zip(nulls, left_over, gone, raws, strict=True)]
        common.release()
        return documents.select(columns).set_column(at_text, text_, pa.array(texts, pa.string()))

    out = left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(run, schema)
    return out.toDF(key, "n_words", "n_removed", "kept_sha256") if digest else out.toDF(*names)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """`key`, `n_words`, `n_removed`, `kept_sha256` of each document."""
    return _apply(docs, key, text, window, digest=True)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """`docs` without the repeated words; a text that loses words is its other words joined by single spaces."""
    return _apply(docs, key, text, window, digest=False)


def op2_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages removed from every document."""
    return digests(common.table(spark, sf_dir, "documents"))
