"""Operator 11: grouping of spelling variants by Aho-Corasick automata of word halves.

1. Words are counted in every task, one entry for each different word, and summed. Whether a run loses a code point depends on
   the document's id and the run alone, so it is decided once for each document and different run.
2. Of two words that are one edit apart, one half of either stands unchanged in the other: the first half at its beginning or
   the second at its end. Words are dealt to shards by length and hash. A shard's automaton holds both halves of its words;
   words whose lengths are within one of a shard's are read against it, block by block. An occurrence counts if the half
   stands where it must (at the beginning, or so far from the end as it is long); then the distance to the half's owners is
   verified. Where a half has more than `LISTED` owners, only those are verified whose rest is within one edit, found by the
   strings that the rest becomes when one code point is left out; so halves that very many words share make no pairs of all.
   Shards and blocks have a bounded number of words, so no task holds all.
3. Near words are counted and the form is chosen by an aggregate for each word. Roots follow by pointer jumping: counts grow
   at least five times from step to step, so a chain is short.

Defined results: null texts have no words; repeated rows count again; an id that is null counts as the empty string in the
hash; very long texts are whole; an empty table gives an empty table; further columns are not carried.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import common

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: A hash that this divides costs a run a code point; least code points and occurrences of a word; how many times more often a form is.
DROPPED, SHORTEST, LEAST, TIMES = 199, 6, 5, 5
#: Words of one shard; words read against it by one task; owners of a half that are verified one by one; different words that a task counts at a time.
SHARD, BLOCK, LISTED, COUNTED = 60_000, 60_000, 16, 200_000
_LOWER = {c: c + 32 for c in range(65, 91)}


def runs_of(text: str, key) -> Counter:
    """The runs of one text, with what the hash takes out of them, and how often each occurs."""
    out: Counter = Counter()
    seed = zlib.crc32(f"{'' if key is None else key}:".encode())
    lost = []
    for run, n in Counter(RUN.findall(text)).items():
        if not run.islower():
            run = run.lower() if run.isascii() else run.translate(_LOWER)
        out[run] += n
    for run in [*out]:
        h = zlib.crc32(run.encode(), seed)
        if h % DROPPED == 0:
            at = h % len(run)
            lost.append((run[:at] + run[at + 1 :], out.pop(run)))
    for run, n in lost:
        out[run] += n
    return out


def counted(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`word`, `n`: words of at least `SHORTEST` code points that occur `LEAST` times or more."""
    common.tune(df.sparkSession)

    def run(batches):
        seen: Counter = Counter()

        def given():
            words = list(seen)
            made = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            for at in range(0, made.num_rows, common.BATCH_ROWS):
                yield made.slice(at, common.BATCH_ROWS)

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if value:
                    for word, n in runs_of(value, name).items():
                        if len(word) >= SHORTEST:
                            seen[word] += n
            if len(seen) > COUNTED:
                yield from given()
        yield from given()
        common.release()

    some = df.select(key, text).mapInArrow(run, "word string, n bigint")
    return some.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = 0
    while at < len(a) and a[at] == b[at]:
        at += 1
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _without_one(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


class Shard:
    """An automaton of the halves of some words."""

    def __init__(self, words: list[str]) -> None:
        owners: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
        for word in words:
            middle = len(word) // 2
            owners[word[:middle]][0].append(word)
            owners[word[middle:]][1].append(word)
        self.automaton = ahocorasick.Automaton()
        for half, (first, last) in owners.items():
            self.automaton.add_word(half, (len(half), self._listed(half, first, 0), self._listed(half, last, 1)))
        if owners:
            self.automaton.make_automaton()

    @staticmethod
    def _listed(half: str, words: list[str], side: int):
        """The owners, or, where they are many, the owners by what their other half becomes without one code point."""
        if len(words) <= LISTED:
            return words
        found = defaultdict(list)
        for word in words:
            for rest in _without_one(word[: len(word) - len(half)] if side else word[len(half) :]):
                found[rest].append(word)
        return dict(found)

    def near(self, word: str) -> set[str]:
        """The shard's words that are one edit from `word`."""
        out: set[str] = set()
        if not len(self.automaton):
            return out
        for end, (size, first, last) in self.automaton.iter(word):
            start = end + 1 - size
            for side, owners in ((0, first if start == 0 else ()), (1, last if end + 1 == len(word) else ())):
                if isinstance(owners, dict):
                    rest = word[:start] if side else word[size:]
                    owners = {w for x in _without_one(rest) for w in owners.get(x, ())}
                for w in owners:
                    if abs(len(w) - len(word)) <= 1 and w not in out and one_edit(w, word):
                        out.add(w)
        return out


def near_pairs(words: DataFrame) -> DataFrame:
    """`word`, `near`, `n`: each of the words (`word`, `n`) with every word that is one edit away, and that one's count. words: a written table."""
    sized = words.select("word", "n", F.length("word").alias("size"))
    total = sized.groupBy("size").agg(F.count("*").alias("count"))
    parts = lambda each, name: total.select("size", F.ceil(F.col("count") / each).alias(name))
    own, blocks = parts(SHARD, "shards"), parts(BLOCK, "blocks")
    held = sized.join(own, "size").select("word", "size", F.pmod(F.xxhash64("word"), F.col("shards")).alias("shard"))
    near_sizes = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    # A shard goes to every block of each length within one of its own.
    held = held.withColumn("read", near_sizes("size")).join(blocks.withColumnRenamed("size", "read"), "read")
    held = held.select("size", "shard", "read", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "word", F.lit(None).cast("bigint").alias("n"))
    asked = sized.withColumnRenamed("size", "read").join(blocks.withColumnRenamed("size", "read"), "read")
    asked = asked.select("word", "n", "read", F.pmod(F.hash("word"), F.col("blocks")).alias("block"), near_sizes("read").alias("size")).join(own, "size")
    asked = asked.select("size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("shard"), "read", "block", F.lit(1).alias("kind"), "word", "n")
    cell = ["size", "shard", "read", "block"]
    stream = held.unionByName(asked).repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cell).sortWithinPartitions(*cell, "kind")

    def run(batches):
        at, words, shard = None, [], None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            out: list[tuple] = []
            for size, part, read, block, kind, word, n in zip(*columns, strict=True):
                if at != (size, part, read, block):
                    at, words, shard = (size, part, read, block), [], None
                if kind == 0:
                    words.append(word)
                    continue
                if shard is None:
                    shard, words = Shard(words), []
                out += [(w, word, n) for w in shard.near(word)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "near", "n"])

    return stream.mapInArrow(run, "word string, near string, n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """`word`, `root`: the last that is reached over forms. forms: `word`, `form` (null at the end of a chain)."""
    at = common.materialize(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        far = at.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = common.materialize(at.join(far, "root").select("word", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")), "roots")
        common.discard(at)
        at = moved
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")


def grouped(words: DataFrame) -> DataFrame:
    """`word`, `form`, `root`, `n`, `n_near`, `form_n` of counted words (`word`, `n`)."""
    words = common.materialize(words, "words")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("near").alias("near"))).alias("best")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.n") >= TIMES * F.col("n"), F.col("best")).alias("best"))
    forms = common.materialize(found.select("word", F.col("best.near").alias("form"), "n", "n_near", (-F.col("best.n")).alias("form_n")), "forms")
    return forms.join(roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return grouped(counted(common.table(spark, sf_dir, "documents")))


OP11_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS entries
  FROM range(256) AS t(i)
), found AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
), runs AS MATERIALIZED (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM found GROUP BY ALL
), spelled AS (
  SELECT run, n, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS bytes FROM runs
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(1, length(bytes) + 1, 2), lambda i: CAST('0x' || bytes[i:i + 1] AS BIGINT))),
    lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]))) AS h
  FROM spelled, crc
), words AS MATERIALIZED (
  SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
), shorter AS MATERIALIZED (
  SELECT word, i, word[:i] || word[i + 2:] AS rest FROM words, unnest(range(length(word))) AS u(i)
), pairs AS (
  SELECT a.word, b.word AS near FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, rest FROM shorter SEMI JOIN words ON words.word = rest
  UNION SELECT rest, word FROM shorter SEMI JOIN words ON words.word = rest
), ranked AS (
  SELECT p.word, near, m.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY m.n DESC, near) AS r
  FROM pairs p JOIN words m ON m.word = near
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN ranked k ON k.word = w.word AND r = 1
), chain AS (
  SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms g ON g.word = c.root AND g.form IS NULL
"""
