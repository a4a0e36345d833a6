"""Operator 13: packing online, with a bounded number of open windows.

Documents come one after the other. Each partition keeps `WINDOWS` open windows. A document goes whole into the window
that it fills best. Where it fits into none, the fullest window is filled up with the document's first ids and emitted,
and the rest is placed again; a stretch of a whole window or more is cut off and emitted at once. So a task holds at most
WINDOWS * capacity ids, whatever it reads, and no sequence that is emitted has padding.

At its end a partition lays what its open windows hold one behind the other, the fullest first, and emits that too, but
for less than one window. These leftovers are merged: running sums of their lengths, in two levels, give each its place on
one line, which is cut at every `capacity`. What is left of the line after the last cut is cut into powers of two, the
longest first, as those need no padding.

Defined results: a null or empty text is the end token alone; repeated rows are packed as often as they occur; very long
documents are cut as often as they have to be; an empty table gives an empty table; further columns are not carried.
Strings of special tokens inside a text are those tokens, as the library has it.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import common
from seqloom.llm.bpe import _BEYOND_LATIN as BEYOND_LATIN
from seqloom.llm.bpe import to_characters
from seqloom.llm.memo import Remembered
from seqloom.operators.neighbors import running_before

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CAPACITY, WINDOWS, END = 2048, 64, 1
#: Bytes, about, of the words that one worker remembers.
REMEMBERED_BYTES = 96 << 20
#: Sequences that one partition may number; partitions that make one number of the second level of the running sums.
NUMBERED, TOGETHER = 1 << 36, 512
#: White space of `str.split` that the library does not take for white space.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Where the tokenizer's pattern ends a match anyway; white space there means nothing to it, and so words are alike with and without a mark.
_MARK = re.compile("([A-Za-z])([,.;:!?])")


class WordCodec:
    """Ids of texts by a tokenizer that drops white space and never looks across it; words are encoded once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.whole = [*_SEPARATORS, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.words = Remembered(self._ids, np.uint32, REMEMBERED_BYTES)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # A word of small Latin letters is as the normaliser leaves it, and one match of the pattern.
        plain = [w.isalpha() and w.islower() and (w.isascii() or not BEYOND_LATIN.search(w)) for w in words]
        rest = iter(self.tokenizer.encode_batch_fast([w for w, p in zip(words, plain, strict=True) if not p], add_special_tokens=False))
        found = [[t.id for t in self.model.tokenize(w if w.isascii() else to_characters(w.encode()))] if p else next(rest).ids for w, p in zip(words, plain, strict=True)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list = [np.zeros(0, np.uint32)] * len(texts)
        rows, words, counts = [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(x in text for x in self.whole):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            if text.isascii() or not BEYOND_LATIN.search(text):  # else lower case may depend on what stands around
                text = text.lower()
            found = _MARK.sub(r"\1 \2", text).split()
            rows.append(i)
            words += found
            counts.append(len(found))
        if rows:
            ids, ends = self.words.gather(words, counts)
            for i, a, b in zip(rows, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                out[i] = ids[a:b]
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> WordCodec:
    """The codec of this process."""
    return WordCodec(path)


class Window:
    """An open window: what is free in it, and its pieces (document's row, start, ids)."""

    __slots__ = ("free", "number", "pieces")

    def __init__(self, number: int, free: int) -> None:
        self.number, self.free, self.pieces = number, free, []

    def __lt__(self, other: Window) -> bool:
        return (self.free, self.number) < (other.free, other.number)


class Packer:
    """The open windows of one partition. `emit(sequence, pieces)` gets each finished one."""

    def __init__(self, emit, capacity: int, windows: int) -> None:
        self.emit, self.capacity, self.windows = emit, capacity, windows
        self.open: list[Window] = []  # ascending by what is free
        self.numbers = 0

    def _next(self) -> int:
        self.numbers += 1
        return self.numbers - 1

    def add(self, row, ids: np.ndarray) -> None:
        """Place one document's ids."""
        at, n = 0, len(ids)
        while n - at >= self.capacity:
            self.emit(self._next(), [(row, at, ids[at : at + self.capacity])])
            at += self.capacity
        while at < n:
            probe = Window(-1, n - at)
            k = bisect_left(self.open, probe)  # the first that has room for all of it: the best fit
            if k < len(self.open):
                own = self.open.pop(k)
            elif len(self.open) < self.windows:
                own = Window(self._next(), self.capacity)
            else:  # none fits: the fullest is filled up and goes
                own = self.open.pop(0)
            part = ids[at : at + own.free].copy()  # else it would hold the whole document's ids
            own.pieces.append((row, at, part))
            own.free -= len(part)
            at += len(part)
            if own.free:
                insort(self.open, own)
            else:
                self.emit(own.number, own.pieces)

    def close(self) -> list:
        """Emit whole sequences of what is still open; the pieces of the rest, less than one window."""
        rest: list = []
        size = 0
        for own in self.open:
            for row, at, ids in own.pieces:
                while size + len(ids) >= self.capacity:
                    cut = self.capacity - size
                    self.emit(self._next(), [*rest, (row, at, ids[:cut])])
                    rest, size, at, ids = [], 0, at + cut, ids[cut:]
                if len(ids):
                    rest.append((row, at, ids))
                    size += len(ids)
        self.open = []
        return rest


def _checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def place(df: DataFrame, path: str, end: int = END, capacity: int = CAPACITY, windows: int = WINDOWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every partition: `key`, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset`, and for those of
    leftovers `part` (their partition) and `ids` (32-bit, little-endian), else null. Leftovers have offsets from 0 in their partition's line.
    """
    common.tune(df.sparkSession)
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"]

    def run(batches):
        own, part = codec(path), TaskContext.get().partitionId()
        ready: list[tuple] = []

        def emit(number: int, pieces: list, left: bool = False) -> None:
            offset = 0
            for (name, tokens), at, ids in pieces:
                ready.append((name, at, len(ids), _checksum(ids), tokens, part * NUMBERED + number, offset, part if left else None, ids.astype("<u4").tobytes() if left else None))
                offset += len(ids)

        def flushed():
            columns = list(zip(*ready, strict=True))
            kinds = [keys, *[pa.int64()] * 7, pa.binary()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            ready.clear()
            return made

        packer, keys = Packer(emit, capacity, windows), None
        for batch in batches:
            keys = batch.schema.field(0).type
            texts, rows = batch.column(1), batch.column(0).to_pylist()
            _, offsets = common.text_buffers(texts)
            for a, b in common.row_groups(offsets):
                for name, ids in zip(rows[a:b], own.encode(texts.slice(a, b - a).to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end))
                    packer.add((name, len(ids)), ids)
                if len(ready) > common.BATCH_ROWS:
                    yield flushed()
        if keys is not None:
            emit(0, packer.close(), left=True)
            if ready:
                yield flushed()
        own.words.forget()
        common.release()

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, part bigint, ids binary"
    return df.select(key, text).mapInArrow(run, schema).withColumnRenamed("key", key)


def _ends(place: int, total: int, capacity: int) -> int:
    """Where the sequence that `place` of a line of `total` ids lies in ends: at the next multiple of the capacity, and behind the last one by powers of two."""
    at = place - place % capacity
    if at + capacity <= total:
        return at + capacity
    while True:
        at += 1 << ((total - at).bit_length() - 1)
        if place < at:
            return at


def merged(left: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """The leftovers of all partitions as sequences, with negative `sequence_id`. left: what `place` gives with `part`; it is read twice."""
    sums = left.groupBy("part").agg(F.sum("length").alias("count"))
    before = running_before(sums, "part", F.floor(F.col("part") / TOGETHER))
    total = sums.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    placed = left.join(before, "part").select(F.col(key).alias("key"), "start", "doc_tokens", (F.col("before") + F.col("offset")).alias("at"), "ids")
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            out = []
            for name, start, tokens, at, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, done = np.frombuffer(raw, "<u4"), 0
                while done < len(ids):
                    end = _ends(at + done, total, capacity)
                    # A sequence begins where the one before it ends.
                    base = (at + done) - (at + done) % capacity
                    while (first := _ends(base, total, capacity)) <= at + done:
                        base = first
                    part = ids[done : done + end - at - done]
                    out.append((name, start + done, len(part), _checksum(part), tokens, -1 - base, at + done - base))
                    done += len(part)
            if out:
                kinds = [batch.schema.field(0).type, *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    kind = left.schema[key].dataType.simpleString()
    schema = f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return placed.mapInArrow(run, schema).withColumnRenamed("key", key)


def packed(df: DataFrame, path: str, end: int = END, capacity: int = CAPACITY, windows: int = WINDOWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents tokenised and packed: `key`, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset`."""
    placed = common.materialize(place(df, path, end, capacity, windows, key, text), "placed")
    whole = placed.where("part is null").drop("part", "ids")
    return whole.unionByName(merged(placed.where("part is not null"), capacity, key))


def op13_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens of `word_bpe_49k.json`."""
    return packed(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
