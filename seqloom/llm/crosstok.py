"""Operator 12: alignment of two tokenizers by a cogroup of postings.

A is a byte-level BPE of the `tokenizers` library, B a `sentencepiece` model with byte fallback. Byte offsets where tokens of
both end cut a text into groups; tokens of A and of B in one group are linked.

1. Each task encodes its documents, in blocks of bounded size. A text falls apart before each run of white space into pieces
   that no token of either side crosses, so a piece's tokens, groups and links are worked out once and remembered. Texts
   with a carriage return, which B joins with what stands before it, are one piece.
2. For each block and each id of A, a posting holds the linked ids of B, the documents of the block that have the pair, and
   how often (the multiplicities), packed. A document's pair is one entry however often it occurs.
3. How many documents hold a pair is summed over the blocks. Postings and these sums meet by A's id: both are dealt by cells
   (bucket of A's ids, bucket of blocks), sorted by A's id with the sums first, and read as one stream, so a task holds the
   sums of one id (no more than B has ids) and contributions of the blocks it has open. A bucket of ids that holds more, as the
   bucket of a very common id does, is dealt over more buckets of blocks, by its measured size.
4. A cell adds up what its entries contribute to each document, gives one packed row for each block, and these are summed by
   block and document.

Defined results: texts that are null or empty, or whose tokens do not spell a space and the text (A's or B's), have no tokens:
zeros and an empty digest. Repeated rows, also such with the same id, count as documents of their own. Very long texts are
whole, a block each. An empty table gives an empty table; further columns are not carried.
"""

from __future__ import annotations

import hashlib
import os
import re
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
from seqloom.llm.bpe import _WHITE as WHITE
from seqloom.llm.bpe import to_bytes, to_characters
from seqloom.llm.memo import Remembered

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of text and documents of one block at most; a longer text is a block of its own.
BLOCK_BYTES, BLOCK_DOCUMENTS = 2 << 20, 32_000
#: Blocks that one task may number.
NUMBERED = 1 << 36
#: Buckets of A's ids; bytes of packed postings that one cell reads, about; entries that a cell adds up before it gives them on.
BUCKETS, CELL_BYTES, ADDED_UP = 64, 16 << 20, 4 << 20
#: Pairs that one group may have to be expanded with others; pieces that are aligned at a time; bytes that pieces are remembered up to.
EXPANDED, ALIGNED, REMEMBERED_BYTES = 1 << 16, 1 << 14, 96 << 20
SPACE = to_characters(b" ")
_PIECES = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 on in bytes of seven bits, the last of each with its high bit clear; and how many bytes each takes."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, int(values.max()).bit_length() if len(values) else 0, 7):
        sizes += values >= np.uint64(1 << bits)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(sizes.max()) if len(sizes) else 0):
        own = sizes > k
        out[(ends - sizes)[own] + k] = ((values[own] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | (np.where(sizes[own] > k + 1, 128, 0).astype(np.uint8))
    return out, sizes


def unpacked(raw: bytes) -> np.ndarray:
    """What `packed` was given."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], last[:-1] + 1))
    at = np.arange(len(data)) - np.repeat(starts, last - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * at), starts)


def _binary(values: np.ndarray, row_ends: np.ndarray) -> pa.Array:
    """A binary value for each row of `values`; row_ends: numbers of values up to each row's end."""
    data, sizes = packed(values)
    ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], row_ends))]
    return pa.Array.from_buffers(pa.binary(), len(row_ends), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


class Aligner:
    """Tokens, groups and links of texts under both tokenizers; one for each worker process."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.model = self.a.model
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        n = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [_or_text(self.a.id_to_token(i) or "") for i in range(n)]
        named = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)]
        #: Pieces that join something with white space behind it.
        across = [p for p in (x.replace("▁", " ") for x in named) if re.search(f"[^{WHITE}][{WHITE}]", p)]
        if not all("\r" in p for p in across):
            raise ValueError("the piece model joins words with white space behind them")
        self.b_count = len(named)
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.names = list(map(str, range(max(len(self.a_bytes), self.b_count))))
        self.pieces = Remembered(self._aligned, np.int64, REMEMBERED_BYTES)

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides of texts with their space in front."""
        # A space and Latin letters are one match of A's pattern.
        plain = [t[0] == " " and t[1:].isalpha() and (t.isascii() or not BEYOND_LATIN.search(t)) for t in texts]
        rest = iter(self.a.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        a = [[x.id for x in self.model.tokenize(SPACE + t[1:] if t.isascii() else to_characters(t.encode()))] if p else next(rest).ids for t, p in zip(texts, plain, strict=True)]
        # The line feed is a token by itself and keeps the model's own space off the text.
        b = self.b.encode(["\n" + t for t in texts], num_threads=1)
        return [(x, y[2:]) for x, y in zip(a, b, strict=True)]

    def aligned(self, text: str, a: list[int], b: list[int]) -> tuple[bool, list[tuple[list[int], list[int]]]]:
        """Whether both sides spell the text, and the groups."""
        raw = text.encode()
        a_parts, b_parts = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(a_parts) != raw or b"".join(b_parts) != raw:
            return False, []
        if len(a) == 1 or len(b) == 1:
            return True, [(a, b)]
        groups, i, k, a_end, b_end, a_from, b_from = [], 0, 0, 0, 0, 0, 0
        while i < len(a) or k < len(b):
            if a_end <= b_end:
                a_end += len(a_parts[i])
                i += 1
            else:
                b_end += len(b_parts[k])
                k += 1
            if a_end == b_end:
                groups.append((a[a_from:i], b[b_from:k]))
                a_from, b_from = i, k
        return True, groups

    def _links(self, groups: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs, as a * (number of B's ids) + b, and how many token occurrences each links."""
        pairs = {}
        small = True
        for a, b in groups:
            if len(a) * len(b) > EXPANDED:
                small = False
                break
            for i in a:
                for j in b:
                    key = i * self.b_count + j
                    pairs[key] = pairs.get(key, 0) + 1
        if small:
            return np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a, b in groups:  # ids that repeat inside a group are counted first
            a_ids, a_times = np.unique(a, return_counts=True)
            b_ids, b_times = np.unique(b, return_counts=True)
            for at in range(0, len(a_ids), max(1, EXPANDED // len(b_ids))):
                to = at + max(1, EXPANDED // len(b_ids))
                more = (a_ids[at:to, None] * self.b_count + b_ids[None, :]).ravel()
                keys, where = np.unique(np.concatenate((keys, more)), return_inverse=True)
                times = np.bincount(where, np.concatenate((times, np.outer(a_times[at:to], b_times).ravel()))).astype(np.int64)
        return keys, times

    def _one(self, text: str, a: list[int], b: list[int]) -> tuple[np.ndarray, str]:
        """The numbers of one piece, as `_aligned` has them, and its groups' text."""
        spelled, groups = self.aligned(text, a, b)
        keys, times = self._links(groups)
        row = np.empty(5 + 2 * len(keys), np.int64)
        row[:5] = spelled, len(a), len(b), len(groups), times.sum()
        row[5::2], row[6::2] = keys, times
        return row, ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)

    def _many(self, tokens: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The numbers of pieces that both sides spell, one behind the other, how many each has, and their groups' texts."""
        counts = [np.fromiter((len(t[k]) for t in tokens), np.int64, len(tokens)) for k in (0, 1)]
        a, b = (np.fromiter(chain.from_iterable(t[k] for t in tokens), np.int64, int(counts[k].sum())) for k in (0, 1))
        a_ends, b_ends = np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b])
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)  # where a group ends; pieces end there too
        a_group, b_group = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
        b_counts = np.bincount(b_group, minlength=len(both))
        b_firsts = np.cumsum(b_counts) - b_counts
        piece_of_a = np.repeat(np.arange(len(tokens)), counts[0])
        last_groups = a_group[np.cumsum(counts[0]) - 1]
        n_groups = np.diff(last_groups, prepend=-1)
        links = b_counts[a_group]
        keys = np.repeat(a, links) * self.b_count + b[common.ragged(b_firsts[a_group], links)]
        pair, times = np.unique(np.repeat(piece_of_a, links) << 32 | keys, return_counts=True)
        pieces = pair >> 32
        n_pairs = np.bincount(pieces, minlength=len(tokens))
        sizes = 5 + 2 * n_pairs
        starts = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int64)
        n_links = np.bincount(piece_of_a, links, len(tokens)).astype(np.int64)
        for k, values in enumerate((np.ones(len(tokens), np.int64), *counts, n_groups, n_links)):
            out[starts + k] = values
        at = common.ragged(starts + 5, 2 * n_pairs)
        out[at[::2]], out[at[1::2]] = pair & 0xFFFFFFFF, times
        # The texts: ids of A, then of B, group by group, each with what stands behind it.
        behind_a = np.where(np.append(a_group[1:] != a_group[:-1], True), 1, 0)
        behind_b = np.where(np.append(b_group[1:] != b_group[:-1], True), 2, 0)
        behind_b[np.cumsum(counts[1]) - 1] = 3
        order = np.argsort(np.concatenate((2 * a_group, 2 * b_group + 1)), kind="stable")
        names, marks = self.names, (",", "|", ";", "")
        parts = [names[i] + marks[k] for i, k in zip(np.concatenate((a, b))[order].tolist(), np.concatenate((behind_a, behind_b))[order].tolist(), strict=True)]
        ends = np.cumsum(counts[0] + counts[1]).tolist()
        return out, sizes, ["".join(parts[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def _aligned(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each piece: spelled, n_a, n_b, n_groups, n_links, then pairs and times by turns."""
        values, lengths = [], []
        for at in range(0, len(texts), ALIGNED):
            some = texts[at : at + ALIGNED]
            tokens = self.tokens(some)
            # Pieces that B may spell otherwise, and such with large groups, are aligned one by one.
            plain = [len(a) * len(b) <= EXPANDED and "▁" not in t for t, (a, b) in zip(some, tokens, strict=True)]
            alike = [x for x, p in zip(tokens, plain, strict=True) if p]
            spelled = "".join([t for t, p in zip(some, plain, strict=True) if p]).encode()
            if any(b"".join([side[i] for x in alike for i in x[k]]) != spelled for k, side in ((0, self.a_bytes), (1, self.b_bytes))):
                plain, alike = [False] * len(some), []
            flat, sizes, written = self._many(alike) if alike else (np.zeros(0, np.int64), np.zeros(0, np.int64), [])
            if len(alike) == len(some):
                values.append(flat)
                lengths.append(sizes)
                self.written += written
                continue
            ends = np.cumsum(sizes)
            next_alike = iter(zip(ends - sizes, ends, written, strict=True))
            for text, (a, b), p in zip(some, tokens, plain, strict=True):
                if p:
                    i, j, groups = next(next_alike)
                    row = flat[i:j]
                else:
                    row, groups = self._one(text, a, b)
                values.append(row)
                lengths.append(np.array([len(row)], np.int64))
                self.written.append(groups)
        return np.concatenate(values), np.concatenate(lengths)

    def forget(self) -> None:
        """Let go of all pieces."""
        self.pieces.forget()
        self.written: list[str] = []

    def block(self, texts: list[str | None], whole: frozenset = frozenset()) -> tuple[np.ndarray, list[bytes | None], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text n_a, n_b, n_groups, n_links and the digest of its groups; then pair, text and times of each entry, by pair and text."""
        if not self.pieces.slots or self.pieces.held > REMEMBERED_BYTES:
            self.forget()
        pieces, counts = [], []
        for i, text in enumerate(texts):
            text = " " + text if text else ""
            found = [] if not text else [text] if "\r" in text or i in whole else _PIECES.findall(text)
            pieces += found
            counts.append(len(found))
        at = self.pieces.numbers(pieces)
        flat, lengths = self.pieces.arrays(at)
        starts = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(texts)), counts)
        heads = flat[starts[:, None] + np.arange(5)] if len(starts) else np.zeros((0, 5), np.int64)
        ends = np.cumsum(counts, dtype=np.int64)
        sums = np.diff(np.concatenate((np.zeros((1, 5), np.int64), np.cumsum(heads, axis=0)))[np.concatenate(([0], ends))], axis=0)
        good = sums[:, 0] == counts
        again = frozenset(i for i in np.flatnonzero(~good).tolist() if counts[i] > 1)
        if again - whole:  # a whole may be spelled where its pieces are not
            return self.block(texts, whole | again)
        sums[~good] = 0
        written, numbers, digests = self.written, at.tolist(), []
        for i, end in enumerate(ends.tolist()):
            if counts[i] and good[i]:
                digests.append(hashlib.sha256(";".join([written[k] for k in numbers[end - counts[i] : end]]).encode()).digest())
            else:
                digests.append(None)
        n_pairs = np.where(good[owner], (lengths - 5) // 2, 0) if len(owner) else np.zeros(0, np.int64)
        places = common.ragged(starts + 5, 2 * n_pairs)
        keys, times = flat[places[::2]], flat[places[1::2]]
        entry = keys * BLOCK_DOCUMENTS + np.repeat(owner, n_pairs)
        order = np.argsort(entry, kind="stable")
        entry, times = entry[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], entry[1:] != entry[:-1]))) if len(entry) else np.zeros(0, np.int64)
        times = np.add.reduceat(times, first) if len(first) else times
        entry = entry[first]
        return sums[:, 1:], digests, entry // BLOCK_DOCUMENTS, entry % BLOCK_DOCUMENTS, times


def _or_text(token: str) -> bytes:
    try:
        return to_bytes(token)
    except UnicodeEncodeError:  # an added token is plain text
        return token.encode()


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this process."""
    return Aligner(a_path, b_path)


_TABLE = "block bigint, place int, key {}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, digest binary, a int, heads binary, docs binary, times binary"


def postings(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of documents (`a` is null) and of postings (`place` is null), told apart by block.

    A posting's `heads` has, for each id of B, its difference to the one before and the number of documents; `docs` their places in the
    block, as differences; `times` the multiplicities.
    """
    common.tune(df.sparkSession)
    schema = _TABLE.format(df.schema[key].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        own, part = aligner(a_path, b_path), TaskContext.get().partitionId()
        own.forget()
        keys: list[pa.Array] = []
        texts: list[str | None] = []
        size, number = 0, 0

        def flushed():
            block = part * NUMBERED + number
            sums, digests, pairs, docs, times = own.block(texts)
            n = len(texts)
            none = lambda k, m: pa.nulls(m, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), pa.concat_arrays(keys), *(pa.array(c) for c in sums.T), pa.array(digests, pa.binary()), none(pa.int32(), n), *(none(pa.binary(), n) for _ in range(3))], names
            )
            if not len(pairs):
                return
            ids = pairs // own.b_count
            new_pair = np.concatenate(([True], pairs[1:] != pairs[:-1]))
            new_id = np.concatenate(([True], ids[1:] != ids[:-1]))
            firsts = np.flatnonzero(new_pair)
            per_pair = np.diff(np.append(firsts, len(pairs)))
            b = pairs[firsts] % own.b_count
            id_of_pair = new_id[firsts]
            b_steps = np.where(id_of_pair, b, b - np.concatenate(([0], b[:-1])))
            steps = np.where(new_pair, docs, docs - np.concatenate(([0], docs[:-1])))
            pair_ends = np.append(np.flatnonzero(id_of_pair)[1:], len(firsts))
            entry_ends = np.append(np.flatnonzero(new_id)[1:], len(pairs))
            heads = np.stack((b_steps, per_pair), axis=1).ravel()
            rows = pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pair_ends), block)), none(pa.int32(), len(pair_ends)), none(keys[0].type, len(pair_ends)), *(none(pa.int64(), len(pair_ends)) for _ in range(4)), none(pa.binary(), len(pair_ends)), pa.array(ids[new_id].astype(np.int32)), _binary(heads, 2 * pair_ends), _binary(steps, entry_ends), _binary(times, entry_ends)], names
            )
            for at in range(0, rows.num_rows, common.BATCH_ROWS):
                yield rows.slice(at, common.BATCH_ROWS)

        for batch in batches:
            _, offsets = common.text_buffers(batch.column(1))
            for i, value in enumerate(batch.column(1).to_pylist()):
                more = int(offsets[i + 1] - offsets[i])
                if texts and (size + more > BLOCK_BYTES or len(texts) >= BLOCK_DOCUMENTS):
                    yield from flushed()
                    keys, texts, size, number = [], [], 0, number + 1
                keys.append(batch.column(0).slice(i, 1))
                texts.append(value)
                size += more
        if texts:
            yield from flushed()
        own.forget()
        common.release()

    return df.select(key, text).mapInArrow(run, schema)


def pair_counts(posted: DataFrame) -> DataFrame:
    """`a`, `b`, `n`: how many documents hold the pair linked."""

    def run(batches):
        for batch in batches:
            heads = [unpacked(x) for x in batch.column(1).to_pylist()]
            if not heads:
                continue
            sizes = np.array([len(h) // 2 for h in heads])
            ids = np.repeat(batch.column(0).to_numpy(), sizes)
            b = np.concatenate([np.cumsum(h[::2]) for h in heads])
            n = np.concatenate([h[1::2] for h in heads])
            # Blocks of one batch are added up here already.
            keys, where = np.unique(ids.astype(np.int64) << 32 | b, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(np.bincount(where, n).astype(np.int64))], ["a", "b", "n"])

    some = posted.where("a is not null").select("a", "heads").mapInArrow(run, "a int, b int, n bigint")
    return some.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _contributions(stream):
    """Packed sums for each block from one cell's stream: sums of pairs (`kind` 0) before the postings of the same id (`kind` 1)."""
    ids, counts, parts = None, None, []
    best = 0
    open_: dict[int, list] = {}
    held = 0

    def given():
        rows = []
        for block, lists in open_.items():
            docs, sums, tops = (np.concatenate([x[k] for x in lists]) for k in range(3))
            found, where = np.unique(docs, return_inverse=True)
            both = [np.bincount(where, x, len(found)).astype(np.int64) for x in (sums, tops)]
            rows.append((block, packed(np.diff(found, prepend=0))[0].tobytes(), packed(both[0])[0].tobytes(), packed(both[1])[0].tobytes()))
        open_.clear()
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "docs", "sums", "tops"])

    for batch in stream:
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        a, kind = columns["a"].to_numpy(), columns["kind"].to_numpy()
        blocks = columns["block"].to_numpy(zero_copy_only=False)
        at = 0
        while at < len(a):
            to = at + int(np.argmax(np.append((a[at:] != a[at]) | (kind[at:] != kind[at]), True)))
            if kind[at] == 0:
                if ids != a[at] or counts is not None:
                    ids, parts = a[at], []
                parts.append((columns["b"].slice(at, to - at).to_numpy(), columns["n"].slice(at, to - at).to_numpy()))
                counts = None
            else:
                if counts is None:
                    b, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                    order = np.argsort(b)
                    counts, best = (b[order], n[order]), n.max()
                for i in range(at, to):
                    heads, docs, times = (unpacked(columns[c][i].as_py()) for c in ("heads", "docs", "times"))
                    sizes = heads[1::2]
                    n = np.repeat(counts[1][np.searchsorted(counts[0], np.cumsum(heads[::2]))], sizes)
                    firsts = np.cumsum(sizes) - sizes
                    running = np.cumsum(docs)
                    docs = running - np.repeat(running[firsts] - docs[firsts], sizes)
                    open_.setdefault(int(blocks[i]), []).append((docs.astype(np.int32), n * times, np.where(n == best, times, 0)))
                    held += len(docs)
                    if held > ADDED_UP:
                        yield given()
                        held = 0
            at = to
    if open_:
        yield given()


def contributions(posted: DataFrame, sums: DataFrame) -> DataFrame:
    """`block`, `docs`, `sums`, `tops`: what one cell adds to documents of a block (places, sums of counts, links at the best count), packed."""
    bucket = F.pmod(F.xxhash64("a"), F.lit(BUCKETS)).cast("int")
    some = posted.where("a is not null").select("a", "block", "heads", "docs", "times").withColumn("bucket", bucket)
    size = F.sum(F.octet_length("heads") + F.octet_length("docs") + F.octet_length("times") + 32)
    ways = {r[0]: max(1, -(-r[1] // CELL_BYTES)) for r in some.groupBy("bucket").agg(size).collect()}  # BUCKETS rows
    if not ways:
        return posted.sparkSession.createDataFrame([], "block bigint, docs binary, sums binary, tops binary")
    split = F.create_map(*(F.lit(x) for k, v in ways.items() for x in (k, v)))[F.col("bucket")]
    null = lambda k, name: F.lit(None).cast(k).alias(name)
    dealt = some.select("bucket", F.pmod(F.xxhash64("block"), split).cast("int").alias("share"), "a", F.lit(1).alias("kind"), "block", null("int", "b"), null("bigint", "n"), "heads", "docs", "times")
    told = sums.withColumn("bucket", bucket).where(F.col("bucket").isin(list(ways)))
    told = told.select("bucket", F.explode(F.sequence(F.lit(0), (split - 1).cast("int"))).alias("share"), "a", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("block"), "b", "n", null("binary", "heads"), null("binary", "docs"), null("binary", "times"))
    cells = sum(ways.values())
    stream = told.unionByName(dealt).repartition(max(cells, int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "bucket", "share")
    stream = stream.sortWithinPartitions("bucket", "share", "a", "kind")

    def run(batches):
        yield from _contributions(batches)
        common.release()

    return stream.mapInArrow(run, "block bigint, docs binary, sums binary, tops binary")


def aligned(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum`, `groups_sha256` of every row."""
    posted = common.materialize(postings(df, a_path, b_path, key, text), "postings")
    added = contributions(posted, pair_counts(posted))
    kind = df.schema[key].dataType.simpleString()
    documents = posted.where("a is null").select("block", F.lit(0).alias("kind"), "place", F.col("key"), "n_a", "n_b", "n_groups", "n_links", "digest", *(F.lit(None).cast("binary").alias(c) for c in ("docs", "sums", "tops")))
    null = lambda k, name: F.lit(None).cast(k).alias(name)
    more = added.select("block", F.lit(1).alias("kind"), null("int", "place"), null(kind, "key"), *(null("bigint", c) for c in ("n_a", "n_b", "n_groups", "n_links")), null("binary", "digest"), "docs", "sums", "tops")
    stream = documents.unionByName(more).repartition("block").sortWithinPartitions("block", "kind", "place")
    names = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches):
        block, rows, sums = None, [], None

        def given():
            # Places of a block are 0, 1, 2, ... in the order in which they come.
            own = pa.Table.from_batches(rows).combine_chunks()
            columns = {c: own.column(c).combine_chunks() for c in own.column_names}
            digests = [x.hex() if x is not None else "" for x in columns["digest"].to_pylist()]
            made = pa.RecordBatch.from_arrays([*(columns[c] for c in names[:5]), pa.array(sums[1]), pa.array(sums[0]), pa.array(digests, pa.string())], names)
            for at in range(0, made.num_rows, common.BATCH_ROWS):
                yield made.slice(at, common.BATCH_ROWS)

        for batch in batches:
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = 0
            while at < len(blocks):
                to = at + int(np.argmax(np.append((blocks[at:] != blocks[at]) | (kinds[at:] != kinds[at]), True)))
                if kinds[at] == 0:
                    if block is not None and block != blocks[at]:
                        yield from given()
                        rows = []
                    block, sums = blocks[at], None
                    rows.append(batch.slice(at, to - at).select(["key", "n_a", "n_b", "n_groups", "n_links", "digest"]))
                    sums = np.zeros((2, sum(r.num_rows for r in rows)), np.int64)
                else:
                    for i in range(at, to):
                        places = np.cumsum(unpacked(batch.column("docs")[i].as_py()))
                        sums[0][places] += unpacked(batch.column("sums")[i].as_py())
                        sums[1][places] += unpacked(batch.column("tops")[i].as_py())
                at = to
        if block is not None:
            yield from given()
        common.release()

    schema = f"key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return stream.mapInArrow(run, schema).withColumnRenamed("key", key)


def op12_postings_cogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under `byte_bpe_50k.json` and `piece_bpe_32k.model`."""
    return aligned(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
