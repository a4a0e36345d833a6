"""Operator 7: best-fit packing of tokenised documents by exact-complement hashing.

Which pieces share a sequence depends only on how many pieces there are of each
length, so the plan is made from the histogram of lengths, which has at most
`capacity` entries at any input size. Starting with the longest length left, the
planner looks up what fills the gap exactly: one length, a pair or a triple whose sum
is the gap, under the counts still available. Where nothing fills it exactly, the
longest length that fits goes in (best fit) and the lookup repeats for the smaller
gap. A combination is consumed as often as the counts allow, so the number of steps
follows the number of lengths and not that of documents.

Pieces then find their place by their rank among those of their length. Ranks are
made in two levels, (length, bucket) and an offset for each bucket, so a length that
holds a third of all rows is still ranked by many tasks.

Defined results: a null or empty text is one piece that holds only the end token;
repeated rows are packed as often as they occur; very long documents are cut into
`capacity`-long pieces of which the first may be shorter; an empty table gives an
empty table; further columns are not carried.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm import bpe, common

CAPACITY = 2048
#: Pieces that one task ranks, about.
RANKED_TOGETHER = 50_000


def pieces(df: DataFrame, vocabulary: bpe.Vocabulary, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of each document, end token 0 included: `key`, `piece`, `start`, `length`, `ids_crc32`, and `ids` if asked for."""
    common.tune(df.sparkSession)
    names = [key, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        own = bpe.codec(vocabulary)
        for batch in batches:
            rows, numbers, starts, sizes, sums, parts = [], [], [], [], [], []
            for row, ids in enumerate(own.encode(batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                first = len(ids) % capacity or capacity
                for number, at in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[at : at + capacity] if number else ids[:first]
                    rows.append(row)
                    numbers.append(number)
                    starts.append(at)
                    sizes.append(len(part))
                    sums.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        parts.append(part)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (starts, sizes, sums)]
            if with_ids:
                columns.append(bpe._lists(parts, pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names)
        own.forget()
        common.release()

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return df.select(key, text).mapInArrow(run, schema)


def _exact(there: np.ndarray, gap: int) -> list[int] | None:
    """Lengths, at most three, whose sum is `gap`, longest first. there: how many are left of each length."""
    if there[gap]:
        return [gap]

    def pair(total: int, most: int) -> tuple[int, int] | None:
        low = np.arange(max(1, total - most), total // 2 + 1)  # the shorter of the two
        if not len(low):
            return None
        fits = (there[low] > 0) & (there[total - low] > 0) & ((2 * low != total) | (there[low] > 1))
        return (total - int(low[fits.argmax()]), int(low[fits.argmax()])) if fits.any() else None

    found = pair(gap, gap - 1)
    if found:
        return list(found)
    for longest in np.flatnonzero(there[: max(gap - 1, 0)])[::-1]:
        if 3 * longest < gap:
            return None
        there[longest] -= 1
        found = pair(gap - int(longest), int(longest))
        there[longest] += 1
        if found:
            return [int(longest), *found]
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """How often to fill a sequence with which lengths: [(times, lengths)], covering `counts`."""
    there = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        there[length] += n
    out = []
    while there.any():
        lengths = [int(np.flatnonzero(there)[-1])]
        there[lengths[0]] -= 1
        gap = capacity - lengths[0]
        while gap:
            more = _exact(there, gap)
            if more is None:
                fits = np.flatnonzero(there[: gap + 1])
                if not len(fits):
                    break
                more = [int(fits[-1])]
            for x in more:
                there[x] -= 1
            lengths += more
            gap -= sum(more)
        again = min(int(there[x]) // n for x, n in Counter(lengths).items())
        for x in lengths:
            there[x] -= again
        out.append((1 + again, lengths))
    return out


def _places(made: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its spans, and of each span the first sequence and the place in it."""
    used: Counter = Counter()
    spans: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for times, lengths in made:
        place = 0
        for x in lengths:
            spans.setdefault(x, []).append((used[x], sequence, place))
            used[x] += times
            place += x
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for x, v in spans.items()}


def pack(df: DataFrame, order: list[str], capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """`df` with `sequence_id` and `offset`; `df` is read twice and should be a written table.

    `order` are columns that tell its rows apart. Lengths are from 1 to `capacity`.
    """
    names, kinds = df.columns, [f.dataType.simpleString() for f in df.schema.fields]
    inner = {c: f"c{i}" for i, c in enumerate(names)}  # no column of df can clash with those made here
    df, order, length = df.toDF(*inner.values()), [inner[c] for c in order], inner[length]
    counts = {r[0]: r[1] for r in df.groupBy(length).count().collect()}  # a row for each length: at most `capacity`
    places = df.sparkSession.sparkContext.broadcast(_places(plan(counts, capacity)))
    buckets = max(8, -(-sum(counts.values()) // RANKED_TOGETHER))
    keyed = df.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    ranked = keyed.withColumn("rank", F.row_number().over(W.partitionBy(length, "bucket").orderBy(*order)))
    before = (
        keyed.groupBy(length, "bucket").count()
        .withColumn("before", F.sum("count").over(W.partitionBy(length).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
        .select(length, "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    )
    joined = ranked.join(before, [length, "bucket"]).select(*df.columns, (F.col("rank") - 1 + F.col("before")).alias("rank"))
    at = df.columns.index(length)

    def run(batches):
        for batch in batches:
            sizes, ranks = batch.column(at).to_numpy(), batch.column(len(names)).to_numpy()
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for x in np.unique(sizes):
                own = np.flatnonzero(sizes == x)
                first, sequences, offsets = places.value[int(x)]
                span = np.searchsorted(first, ranks[own], side="right") - 1
                sequence[own], offset[own] = sequences[span] + ranks[own] - first[span], offsets[span]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], [*inner.values(), "sequence_id", "offset"])

    schema = ", ".join(f"{c} {k}" for c, k in zip(inner.values(), kinds, strict=True))
    return joined.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint").toDF(*names, "sequence_id", "offset")


def packed(df: DataFrame, vocabulary: bpe.Vocabulary, capacity: int = CAPACITY) -> DataFrame:
    """Documents tokenised, cut and packed."""
    return pack(common.materialize(pieces(df, vocabulary, capacity), "pieces"), ["doc_id", "piece"], capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens of `byte_bpe_50k.json`."""
    return packed(common.table(spark, sf_dir, "documents"), bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
