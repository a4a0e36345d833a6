"""Operator 1: byte-level BPE encoding and decoding.

Texts go through the `tokenizers` library in Arrow batches. Byte-level BPE works on
characters that stand for bytes; encoding maps bytes to those characters and back
(`byte_characters`), and decoding reverses that table, so characters that are split
over tokens come back whole.

Most of a text is words that were met before. A text whose white space is single
spaces and line feeds falls apart before each of them into pieces that no match of
the splitting pattern crosses, so a piece's ids do not depend on its neighbours; they
are encoded once and remembered. Any other text, and one that holds the string of a
special token which the vocabulary does not take for plain text, goes to the library
whole.

Defined results: null and empty texts have no ids; repeated rows are repeated; very
long texts are whole; an empty table gives an empty table; further columns are left
as they are unless they have the name of an output column, which replaces them.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import os
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes, about, of the pieces that one Python worker remembers; beyond that it forgets all of them. An entry is ENTRY_BYTES and its text.
REMEMBERED_BYTES, ENTRY_BYTES = 96 << 20, 200
#: Characters that are encoded at a time, so that the working arrays stay small.
AT_ONCE = 1 << 20
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space other than single spaces and line feeds between words.
_IRREGULAR = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[ \n](?=[ \n]|\Z)")
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file: `.json` of the tokenizers library, or `.tiktoken` ranks with their pattern."""

    path: str
    pattern: str = public_tokenizers.PATTERN
    #: Whether the strings of special tokens inside a text are plain text; the library by itself takes them for those tokens.
    plain: bool = False


def byte_characters() -> list[str]:
    """For each byte the character that stands for it: itself if it is visible, else the next from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


BYTE_TO_CHAR = byte_characters()
_TO_CHARS = dict(enumerate(BYTE_TO_CHAR))
_TO_BYTES = {ord(c): b for b, c in enumerate(BYTE_TO_CHAR)}


def to_characters(data: bytes) -> str:
    """Bytes as the characters that stand for them."""
    return data.decode("latin-1").translate(_TO_CHARS)


_SPACE = to_characters(b" ")


def to_bytes(token: str) -> bytes:
    """The bytes that a token's characters stand for."""
    return token.translate(_TO_BYTES).encode("latin-1")


def _from_ranks(path: str, pattern: str):
    """A tokenizer of the library that merges as the ranks say."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    characters = {token: to_characters(token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        halves = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        halves.sort(key=lambda pair: (ranks[pair[0]], ranks[pair[1]]))
        merges += [(characters[a], characters[b]) for a, b in halves]
    made = Tokenizer(models.BPE(vocab={characters[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return made


class _Slots(dict):
    """Piece to its number; a new piece gets the next one and waits in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = slot = len(self)
        self.new.append(key)
        return slot


class Codec:
    """Encodes and decodes lists of texts; one for each worker process and vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import regex
        from tokenizers import Tokenizer

        if vocabulary.path.endswith(".tiktoken"):
            self.tokenizer = _from_ranks(vocabulary.path, vocabulary.pattern)
        else:
            self.tokenizer = Tokenizer.from_file(vocabulary.path)
            self.tokenizer.encode_special_tokens = vocabulary.plain
        self.added = [] if vocabulary.plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.matches = regex.compile(vocabulary.pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]")).findall
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        table = [to_bytes(self.tokenizer.id_to_token(i) or "") for i in range(n)]
        self.byte_lengths = np.array([len(x) for x in table], dtype=np.int64)
        self.byte_starts = np.cumsum(self.byte_lengths) - self.byte_lengths
        self.bytes = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.forget()

    def forget(self) -> None:
        """Let go of all pieces."""
        self.slots = _Slots()
        self.parts: dict[str, tuple[int, ...]] = {}
        self.starts, self.lengths = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.flat, self.used, self.held = np.zeros(1 << 16, np.uint32), 0, 0

    def _match(self, match: str) -> tuple[int, ...]:
        """Ids of one match of the pattern."""
        ids = self.parts.get(match)
        if ids is None:
            ids = self.parts[match] = tuple([t.id for t in self.model.tokenize(match.encode().decode("latin-1").translate(_TO_CHARS))])
            self.held += ENTRY_BYTES + len(match) + 8 * len(ids)
        return ids

    def _ids(self, lead: str, word: str):
        """Ids of one piece: `lead` is a space, a line feed or nothing."""
        if lead == " ":  # most are letters, or letters and one mark
            if word.isalpha():  # the piece itself is what is remembered
                return [t.id for t in self.model.tokenize(_SPACE + (word if word.isascii() else to_characters(word.encode())))]
            if word[-1] in ",.!?:;" and word[:-1].isalpha():
                return self._match(" " + word[:-1]) + self._match(word[-1])
        text = lead + word
        if _BEYOND_LATIN.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return [i for match in self.matches(text) for i in self._match(match)]

    def _remember(self) -> None:
        """Encode the new pieces. Keys: `x` is a space and x, `\nx` is itself, `\rx` is x at a text's start."""
        keys, self.slots.new = self.slots.new, []
        ids = [self._ids(" ", k) if k[0] > "\r" else self._ids(k[0] * (k[0] == "\n"), k[1:]) for k in keys]
        n, more = len(self.slots), np.array(list(map(len, ids)), np.int32)
        while len(self.starts) < n:
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        total = int(more.sum())
        while len(self.flat) < self.used + total:
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.starts[n - len(keys) : n] = self.used + np.cumsum(more) - more
        self.lengths[n - len(keys) : n] = more
        self.used += total
        self.held += ENTRY_BYTES * len(keys) + sum(map(len, keys)) + 8 * total

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit integers."""
        out: list[np.ndarray] = []
        some: list[str] = []
        size = 0
        gc.disable()  # the remembered pieces hold no cycles, and looking for some takes longer than the lookups
        try:
            for text in texts:
                some.append(text or "")
                size += len(some[-1])
                if size >= AT_ONCE:
                    out += self._encode(some)
                    some, size = [], 0
            return out + self._encode(some)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [np.zeros(0, np.uint32)] * len(texts)
        regular, pieces, counts = [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if _IRREGULAR.search(text) or any(x in text for x in self.added):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            keys = text.replace("\n", " \n").split(" ")
            if keys[0]:
                keys[0] = "\r" + keys[0]
            else:
                del keys[0]
            regular.append(i)
            pieces += keys
            counts.append(len(keys))
        if not regular:
            return out
        at = np.fromiter(map(self.slots.__getitem__, pieces), np.int32, len(pieces))
        if self.slots.new:
            self._remember()
        lengths = self.lengths[at]
        ids = self.flat[common.ragged(self.starts[at], lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts)))]
        for i, a, b in zip(regular, ends[:-1].tolist(), ends[1:].tolist()):
            out[i] = ids[a:b]
        if self.held > REMEMBERED_BYTES:
            self.forget()
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes that each list of ids stands for."""
        out = []
        for one in ids:
            lengths = self.byte_lengths[one]
            out.append(self.bytes[common.ragged(self.byte_starts[one], lengths)].tobytes())
        return out

    def offsets(self, text: str | None, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one character of each token; a token with part of a character covers that character."""
        raw = np.frombuffer((text or "").encode(), np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte; continuation bytes belong to the character before
        ends = np.cumsum(self.byte_lengths[ids])
        starts = ends - self.byte_lengths[ids]
        return char_of[starts] if len(ids) else starts, (char_of[ends - 1] + 1) if len(ids) else ends


@lru_cache(maxsize=4)
def codec(vocabulary: Vocabulary) -> Codec:
    """The codec of this process."""
    return Codec(vocabulary)


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", with_offsets: bool = False) -> DataFrame:
    """`df` with `ids array<bigint>`, and `starts`, `ends array<int>` (characters) when offsets are asked for."""
    from pyspark.sql import types as T

    common.tune(df.sparkSession)
    new = [T.StructField("ids", T.ArrayType(T.LongType()))]
    if with_offsets:
        new += [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("starts", "ends")]
    names = {f.name for f in new}
    keep = [f for f in df.schema.fields if f.name not in names]

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            ids = own.encode(texts)
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            columns.append(_lists(ids, pa.int64()))
            if with_offsets:
                both = [own.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
                columns += [_lists([x[k] for x in both], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in keep + new])
        own.forget()
        common.release()

    return df.mapInArrow(run, T.StructType(keep + new))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """`df` with `decoded binary`, the bytes of the ids; null ids give null."""
    from pyspark.sql import types as T

    common.tune(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name != "decoded"]

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            raw = own.decode([np.array(x or [], np.int64) for x in lists])
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            columns.append(pa.array([None if x is None else r for x, r in zip(lists, raw, strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in keep] + ["decoded"])

    return df.mapInArrow(run, T.StructType(keep + [T.StructField("decoded", T.BinaryType())]))


def _lists(arrays: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind.to_pandas_dtype())))


def digests(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text: `key`, `n_tokens`, `ids_sha256` (little-endian 32-bit ids), `decoded_sha256`."""
    common.tune(df.sparkSession)

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            ids = own.encode(batch.column(1).to_pylist())
            raw = own.decode(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                ],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        own.forget()
        common.release()

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the ranks of `byte_bpe_multi_50k.tiktoken`."""
    return digests(common.table(spark, sf_dir, "documents"), Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
