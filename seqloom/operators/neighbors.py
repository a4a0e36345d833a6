"""Similarity joins of sequences: nearest neighbours with ties, and pairs that are the same but for their ends.

A nearest neighbour of a short sequence, if it is a few edits away, is found in trees of what targets begin with: each has targets
that follow each other in order, and is gone down only as far as something near can be below. Of a long one, and if it is not far,
it is found by equi-joins. Sequences within one edit are equal once each has lost one character
at most, so the first round meets by hashes of those. After it, of k + 1 windows side by side in a sequence one stands unchanged in
whatever is within k edits of it, at most k characters away. Rounds double k, each for the queries that are still without a
neighbour, as long as windows single something out; short queries with a window that many targets have are left. What is left
then is dealt in blocks with the targets whose length is within a bound, the distance to sequences next to it by length. In a block
a count of grams bounds every distance from below, and only pairs whose bound is within the best distance so far are measured.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import alignment as A
from seqloom.functions import distance as D
from seqloom.functions import sequences as S
from seqloom.operators.lineage import discard, written

#: Edits of the first round; characters of a window at least, and at most; lengths of a band; sequences of a block, about.
FIRST, LEAST_WINDOW, MOST_WINDOW, BAND, BLOCK = 1, 8, 64, 8, 500
#: Characters that a window must have at least to be looked up.
SEED = 8
#: Edits of the rounds in trees for queries of `SHORT` characters at most; targets of a tree and queries that go down it together, about.
TREES, TREE, GOING = (1, 2, 4), 50_000, 10_000
#: Targets with a window from which on it singles nothing out, for queries of at most so many characters: blocks cost less then.
COMMON, SHORT = 256, 256


def distinct_sequences(reads: DataFrame) -> DataFrame:
    """`seq`, `degree` (reads that have it) and `acc`, the last of their accessions."""
    return reads.groupBy("seq").agg(F.count("*").alias("degree"), F.max("acc").alias("acc"))


def _numbered(sequences: DataFrame) -> DataFrame:
    """`id`, `seq`, `len` of distinct sequences (`seq`)."""
    return written(sequences.select(F.monotonically_increasing_id().alias("id"), "seq", F.length("seq").alias("len")), "sequences")


def _hashed(sequences: DataFrame, near: int, every: bool) -> DataFrame:
    """`id`, `len`, `w`, `at`, `key`: windows side by side of numbered sequences or, with `every`, all those that they can meet."""

    def width(free: int) -> int:
        room = free // (near + 1)
        return min(MOST_WINDOW, 1 << (room.bit_length() - 1)) if room >= LEAST_WINDOW else 0

    def given(parts):
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "len", "w", "at", "key"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for number, seq, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # Lengths within `near` of the query's have one of these two widths, as near is less than an eighth of them.
                for w in {width(size - near), width(size + near)} if every else {width(size)}:
                    if LEAST_WINDOW <= w <= size:
                        keys = D.window_hashes(seq, w)
                        at = np.arange(len(keys)) if every else np.arange(near + 1) * w
                        parts.append((np.full(len(at), number), np.full(len(at), size, np.int32), np.full(len(at), w, np.int32), at.astype(np.int32), keys[at]))
                        held += len(at)
                if held > 50_000:
                    yield given(parts)
                    parts, held = [], 0
        if parts:
            yield given(parts)

    return sequences.select("id", "seq", "len").mapInArrow(run, "id bigint, len int, w int, at int, key bigint")


def _pairs_by_deletion(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs (`q`, `t`, ids) of numbered sequences, among them all within one edit: few have a hash in common else."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                ids, seqs = (c.to_pylist() for c in batch.slice(at, 1_000).columns)
                keys = [D.deletion_hashes(s) for s in seqs]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), [len(k) for k in keys])), pa.array(np.concatenate(keys))], ["id", "key"])

    asked, held = (x.select("id", "seq").mapInArrow(run, "id bigint, key bigint").withColumnRenamed("id", c) for x, c in ((queries, "q"), (targets, "t")))
    return asked.join(held, "key").select("q", "t").distinct()


def _pairs_by_window(queries: DataFrame, targets: DataFrame, near: int, every: bool) -> DataFrame:
    """Pairs (`q`, `t`, ids) of numbered sequences that may be within `near` edits of each other; of short queries that have a window
    in common with many targets none, unless `every` query is wanted.
    """
    held = _hashed(targets, near, False).select(F.col("id").alias("t"), F.col("len").alias("_lt"), "w", F.col("at").alias("_at"), "key")
    asked = _hashed(queries, near, True).select(F.col("id").alias("q"), F.col("len").alias("_lq"), "w", F.col("at").alias("_from"), "key")
    if not every:
        common = held.groupBy("w", "key").count().where(F.col("count") > COMMON).select("w", "key")
        asked = asked.join(asked.where(F.col("_lq") <= SHORT).join(common, ["w", "key"]).select("q").distinct(), "q", "left_anti")
    close = (F.abs(F.col("_lq") - F.col("_lt")) <= near) & (F.abs(F.col("_from") - F.col("_at")) <= near)
    return asked.join(held, ["w", "key"]).where(close).select("q", "t").distinct()


def _in_trees(queries: DataFrame, targets: DataFrame, near: int, self_join: bool) -> DataFrame:
    """`id`, `q`, `t`, `ed`: of queries (`id`, `seq`) the nearest in each tree of targets (`seq`, `tree`), if within `near` edits.

    A tree has targets that follow each other in order, so queries leave most trees after some characters.
    """
    trees, size = targets.agg(F.max("tree") + 1).first()[0] or 0, queries.count()
    tasks = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-size // GOING), min(-(-size // BLOCK), -(-tasks // max(1, trees))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
    asked = queries.repartition(tasks, "id").select("id", "seq", F.pmod(F.xxhash64("seq"), F.lit(groups)).cast("int").alias("a"), every(trees).alias("tree"))
    held = targets.repartition(tasks, "seq").select("seq", every(groups).alias("a"), F.col("tree").cast("int").alias("tree"))

    def run(queries: pa.Table, others: pa.Table) -> pa.Table:
        q, t = queries.column("seq").to_pylist(), others.column("seq").to_pylist()
        i, k, ed = D.near_in_tree(q, t, near, self_join) if q and t else (np.zeros(0, np.int64),) * 3
        i, k = pa.array(i), pa.array(k)
        return pa.table({"id": queries.column("id").take(i), "q": queries.column("seq").take(i), "t": others.column("seq").take(k), "ed": pa.array(ed, pa.int32())})

    # Cells are few rows and much work, so they are dealt by number and not by bytes.
    asked, held = (x.repartition(max(tasks, trees * groups), "a", "tree") for x in (asked, held))
    return asked.groupBy("a", "tree").cogroup(held.groupBy("a", "tree")).applyInArrow(run, "id bigint, q string, t string, ed int")


def _rounds_in_trees(left: DataFrame, held: DataFrame, self_join: bool) -> tuple[list[DataFrame], DataFrame]:
    """What the rounds in trees find (`id`, `q`, `t`, `ed`), and the queries that are left then, all longer ones among them."""
    short = held.where(F.col("len") <= SHORT + TREES[-1]).select("seq")
    trees = -(-short.count() // TREE)
    ranged = short.repartitionByRange(max(1, trees), "seq")
    short, found = written(ranged.select("seq", F.spark_partition_id().alias("tree")), "trees"), []
    for near in TREES:
        found.append(written(_least(_in_trees(left.where(F.col("len") <= SHORT).select("id", "seq"), short, near, self_join)), "near"))
        rest = written(left.join(found[-1].select("id").distinct(), "id", "left_anti"), "left")
        discard(left)
        left = rest
    discard(short)
    return found, left


def _far(left: DataFrame, targets: DataFrame, self_join: bool) -> DataFrame:
    """`q`, `t`, `ed` for queries (`id`, `seq`, `len`) that no round has found a neighbour for."""
    # Whatever is near by length bounds the distance; a length that nothing has leaves the query's own.
    some = targets.groupBy("len").agg(F.min("seq").alias("_low"), F.max("seq").alias("_high"))
    away = lambda c: F.when(F.col(c) != F.col("seq"), F.levenshtein("seq", c)) if self_join else F.levenshtein("seq", c)
    bounded = left.join(some, "len", "left").select("seq", "len", F.coalesce(F.least(away("_low"), away("_high"), F.col("len")), F.col("len")).alias("bound"))
    band = lambda c: F.floor(c / BAND)
    bounded = written(bounded.withColumn("home", band(F.col("len"))), "bounded")
    # The nearest of about its own length first; other lengths only as far as they can be as near.
    found = written(_least(_in_blocks(bounded.select("seq", "bound", F.col("home").alias("band")), targets, self_join)), "home")
    best = found.select(F.col("q").alias("seq"), F.col("ed").cast("bigint").alias("_ed")).distinct()
    again = bounded.join(best, "seq", "left").withColumn("bound", F.coalesce(F.least("bound", "_ed"), "bound"))
    bands = band(F.greatest(F.col("len") - F.col("bound"), F.lit(0))), band(F.col("len") + F.col("bound"))
    again = written(again.select("seq", "bound", "home", F.explode(F.sequence(*bands)).alias("band")).where("band <> home").drop("home"), "again")
    return _least(found.unionByName(_in_blocks(again, targets, self_join)))


def _in_blocks(asked: DataFrame, targets: DataFrame, self_join: bool) -> DataFrame:
    """`q`, `t`, `ed`: the nearest in each block for queries (`seq`, `bound`, `band`) among the targets (`seq`, `len`) of their bands.

    Targets and queries of a band are in blocks: each block of one meets each block of the other.
    """
    band = F.floor(F.col("len") / BAND).alias("band")
    # The more targets a query meets at once the fewer are measured; of short ones eight times as many.
    wide = F.greatest(F.lit(BLOCK), F.least(F.lit(8 * BLOCK), F.floor(F.lit(1_000 * BLOCK / BAND) / (F.col("band") + 1))))
    sizes = lambda df, name, block: df.groupBy("band").agg(F.count("*").alias(name)).withColumn(name, F.ceil(F.col(name) / block))
    held = targets.select("seq", band)
    ways = written(sizes(held, "_held", wide).join(sizes(asked, "_asked", F.lit(BLOCK)), "band"), "ways")
    # Cells are few rows and much work, so they are dealt by number and not by bytes.
    cells = ways.agg(F.sum(F.col("_held") * F.col("_asked"))).first()[0] or 0
    tasks = max(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cells // 4))
    both = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("seq"), F.col(n))
    asked = asked.join(ways, "band").select("seq", "bound", "band", mine("_asked").alias("a"), both("_held").alias("h"))
    held = held.join(ways, "band").select("seq", "band", both("_asked").alias("a"), mine("_held").alias("h"))

    def run(queries: pa.Table, others: pa.Table) -> pa.Table:
        q, t = queries.column("seq").to_pylist(), others.column("seq").to_pylist()
        found, _ = D.nearest_among(q, queries.column("bound").to_pylist(), t, self_join)
        return pa.table({"q": pa.array([q[i] for i, _, _ in found], pa.string()), "t": pa.array([t[k] for _, k, _ in found], pa.string()), "ed": pa.array([d for *_, d in found], pa.int32())})

    cell = ["band", "a", "h"]
    asked, held = (x.repartition(tasks, *cell) for x in (asked, held))
    return asked.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(run, "q string, t string, ed int")


def _least(pairs: DataFrame) -> DataFrame:
    """The pairs at each query's least distance."""
    best = F.min("ed").over(W.partitionBy("q"))
    return pairs.withColumn("_best", best).where("ed = _best").drop("_best")


def nearest(queries: DataFrame, targets: DataFrame, self_join: bool, share: float | None = None) -> DataFrame:
    """`q`, `t`, `ed`: each query's targets at the least edit distance, ties included.

    Both have distinct `seq`. In a self join a sequence is not its own neighbour (ed > 0); otherwise equal sequences
    are at distance 0. Distances go up to the query's length, or, with `share` (at most a twentieth), to that share of it; then no
    query meets targets that it has no window in common with.
    """
    held = _numbered(targets.select("seq"))
    left = _numbered(queries.select("seq"))
    longest = left.agg(F.max("len")).first()[0] or 0
    seq = lambda df, c: df.select(F.col("id").alias(c), F.col("seq").alias(f"_{c}"))
    found, edits, least = [], FIRST, left.agg(F.min("len")).first()[0] or 0
    if share is None and least <= SHORT:
        found, left = _rounds_in_trees(left, held, self_join)
    while (share is None and edits == 1) or (longest >= LEAST_WINDOW * (edits + 1) and (share is None or edits <= 2 * share * longest)):
        known = share is None and edits <= TREES[-1]  # of short queries
        if known and longest <= SHORT:
            edits = 2 * edits + 1
            continue
        # Windows shorter than a few characters single nothing out; those queries are left.
        able = F.col("len") - edits >= LEAST_WINDOW * (edits + 1)
        within = F.lit(edits) if share is None else F.least(F.lit(edits), F.floor(F.col("len") * share).cast("int"))
        if share is not None:
            able &= 2 * F.floor(F.col("len") * share) > edits
        asked = left.where(F.col("len") > SHORT) if known else left
        pairs = _pairs_by_deletion(asked, held) if share is None and edits == 1 else _pairs_by_window(asked.where(able), held, edits, share is not None)
        pairs = pairs.join(seq(left.withColumn("seq", F.struct("seq", within.alias("most"))), "q"), "q").join(seq(held, "t"), "t")
        pairs = pairs.select(F.col("q").alias("id"), F.col("_q.seq").alias("q"), F.col("_t").alias("t"), F.col("_q.most").alias("_most"))
        if self_join:
            pairs = pairs.where("q <> t")
        close = pairs.withColumn("ed", F.expr("levenshtein(q, t, _most)")).where("ed >= 0 and ed <= length(q)").select("id", "q", "t", "ed")
        found.append(written(_least(close), "near"))
        rest = written(left.join(found[-1].select("id").distinct(), "id", "left_anti"), "left")
        discard(left)
        left, edits = rest, 2 * edits + 1
    if share is None:
        found.append(_far(left, held, self_join))
    return reduce(DataFrame.unionByName, [x.select("q", "t", "ed") for x in found])


def running_before(counts: DataFrame, key: str, coarse: Column) -> DataFrame:
    """`key`, `before`: the sum of `count` over all lesser keys. `coarse` ascends with the key and has few values.

    Sums run over the coarse values, and inside each of them over its keys, so no task orders all keys.
    """
    keyed = counts.select(key, "count", coarse.alias("_coarse"))
    upto = W.rowsBetween(W.unboundedPreceding, -1)
    blocks = keyed.groupBy("_coarse").agg(F.sum("count").alias("_n"))
    blocks = blocks.select("_coarse", F.coalesce(F.sum("_n").over(upto.orderBy("_coarse")), F.lit(0)).alias("_block"))
    inside = F.coalesce(F.sum("count").over(upto.partitionBy("_coarse").orderBy(key)), F.lit(0))
    return keyed.withColumn("_inside", inside).join(blocks, "_coarse").select(key, (F.col("_block") + F.col("_inside")).alias("before"))


def by_rank(nodes: DataFrame, depth: int) -> DataFrame:
    """As a self join of `nearest`, among sequences whose ranks by length differ by at most `depth`."""
    # Ranks follow from counts of lengths and ranks within a length, so no task orders all rows.
    sized = nodes.select("seq", "degree", F.length("seq").alias("_len"))
    before = running_before(sized.groupBy("_len").count(), "_len", F.floor(F.col("_len") / 256))
    rank = F.row_number().over(W.partitionBy("_len").orderBy("seq")) + F.col("before")
    ranked = sized.join(before, "_len").select("seq", "degree", rank.alias("_rank"))
    asked = ranked.where("degree = 1").select(F.col("seq").alias("q"), F.explode(F.sequence(F.col("_rank") - depth, F.col("_rank") + depth)).alias("_rank"))
    pairs = asked.join(ranked.select(F.col("seq").alias("t"), "_rank"), "_rank").where("q <> t")
    return _least(pairs.select("q", "t", F.levenshtein("q", "t").alias("ed")).where("ed <= length(q)"))


def nearest_by_length(queries: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """As `nearest` of two sets, among the `depth` targets that stand next to the query when targets are sorted by length."""
    held = targets.select(F.col("seq").alias("t"), F.length("seq").alias("_len"))
    asked = queries.select(F.col("seq").alias("q"), F.length("seq").alias("_len"))
    lengths = held.groupBy("_len").count().union(asked.select("_len", F.lit(0).cast("bigint").alias("count")).distinct())
    before = written(running_before(lengths.groupBy("_len").agg(F.sum("count").alias("count")), "_len", F.floor(F.col("_len") / 256)), "lengths")
    ranked = held.join(before, "_len").select("t", (F.col("before") + F.row_number().over(W.partitionBy("_len").orderBy("t"))).alias("_rank"))
    first = F.col("before") - depth // 2 + 1
    near = asked.join(before, "_len").select("q", F.explode(F.sequence(first, first + depth - 1)).alias("_rank"))
    return _least(near.join(ranked, "_rank").select("q", "t", F.levenshtein("q", "t").alias("ed")).where("ed <= length(q)"))


def neighbour_graph(reads: DataFrame, depth: int | None = None) -> DataFrame:
    """Edges `q`, `t`, `ed` from sequences that one read has to their nearest others; no edges if there is none."""
    nodes = distinct_sequences(reads)
    if depth is not None:
        return by_rank(nodes, depth)
    return nearest(nodes.where("degree = 1").select("seq"), nodes.select("seq"), self_join=True)


def homopolymer_pairs(candidates: DataFrame) -> DataFrame:
    """Ordered pairs of different candidates (`acc`, `seq`) that are equal when runs are compressed."""
    keyed = candidates.select("acc", S.homopolymer_compressed("seq").alias("_key"))
    return keyed.alias("a").join(keyed.alias("b"), "_key").where("a.acc <> b.acc").select(F.col("a.acc").alias("a"), F.col("b.acc").alias("b"))


def _width(free: Column, parts: int = 1, most: int = 64) -> Column:
    """The greatest power of two, `most` at most, that fits `parts` times into `free` characters; 0 if none does."""
    room = F.floor(free / parts)
    return F.when(room < 1, 0).otherwise(F.least(F.lit(most), F.pow(F.lit(2.0), F.floor(F.log2(room.cast("double"))))).cast("int"))


def equivalent_pairs(candidates: DataFrame, ends: int) -> DataFrame:
    """Pairs `a`, `b` of different sequences, b no longer, that are the same but for at most `ends` characters at either end."""
    seq = lambda c: candidates.select(F.col("acc").alias(c), F.col("seq").alias(f"_{c}"))
    met = _with_parts_in_common(candidates, ends).join(seq("a"), "a").join(seq("b"), "b")
    return met.where((F.col("_a") != F.col("_b")) & S.equivalent_but_ends("_a", "_b", ends)).select("a", "b").distinct()


def _with_parts_in_common(candidates: DataFrame, ends: int) -> DataFrame:
    """Pairs `a`, `b` that may be the same but for `ends` characters.

    If they are, b is a part of a that begins and ends where a does but for that much, or all but as much of a, at one end of it, is at
    the other end of b. They meet by hashes of these parts whole, so sequences that only have much in common do not.
    """
    sized = candidates.select("acc", "seq", F.length("seq").alias("_len"))
    cut = F.sequence(F.lit(0), F.lit(ends))
    # Rows of a key are told apart by how it was made: b inside a, a's end at b's beginning, a's beginning at b's end.
    head = lambda i: F.xxhash64(F.lit(2), F.substring(F.col("seq"), F.lit(1), F.col("_len") - i))
    tail = lambda i: F.xxhash64(F.lit(1), F.substring(F.col("seq"), i + 1, F.col("_len")))
    head_as_tail = lambda i: F.xxhash64(F.lit(1), F.substring(F.col("seq"), F.lit(1), F.col("_len") - i))
    tail_as_head = lambda i: F.xxhash64(F.lit(2), F.substring(F.col("seq"), i + 1, F.col("_len")))
    inside = F.flatten(F.transform(cut, lambda i: F.transform(cut, lambda j: F.xxhash64(F.lit(0), F.substring(F.col("seq"), i + 1, F.col("_len") - i - j)))))
    left = F.filter(cut, lambda i: i < F.col("_len"))  # something is left
    long = F.array_distinct(F.concat(inside, F.transform(left, tail), F.transform(left, head)))
    short = F.array_distinct(F.concat(F.array(F.xxhash64(F.lit(0), F.col("seq"))), F.transform(left, head_as_tail), F.transform(left, tail_as_head)))
    long = sized.select(F.col("acc").alias("a"), F.col("_len").alias("_la"), F.explode(long).alias("_key"))
    short = sized.select(F.col("acc").alias("b"), F.col("_len").alias("_lb"), F.explode(short).alias("_key"))
    met = long.join(short, "_key").where((F.col("a") != F.col("b")) & (F.col("_la") - F.col("_lb")).between(0, 2 * ends))
    return met.select("a", "b").distinct()


def survivors_nearest(edges: DataFrame, alive: DataFrame) -> DataFrame:
    """Edges (`q`, `t`, `ed`) among `alive` (`acc`) at each query's least distance that is left."""
    kept = edges.join(alive.select(F.col("acc").alias("q")), "q", "left_semi").join(alive.select(F.col("acc").alias("t")), "t", "left_semi")
    return _least(kept)


def close_but_ends(candidates: DataFrame, ends: int, most: int = 10) -> DataFrame:
    """`q`, `t`, `ed` both ways: different candidates at most `most` edits apart when up to `ends` characters at either end are free.

    Of most + 1 windows side by side in the longer one's interior, at least one stands unchanged in the other. Sequences too
    short for windows of `SEED` characters meet in blocks of like lengths.
    """
    reach = most + 2 * ends
    sized = candidates.select("acc", "seq", F.length("seq").alias("_len"))
    width = lambda c: F.when(_width(c - 2 * ends, most + 1) < SEED, 0).otherwise(_width(c - 2 * ends, most + 1))
    long = sized.select(F.col("acc").alias("t"), F.col("seq").alias("_t"), F.col("_len").alias("_lt"), width(F.col("_len")).alias("_w")).where("_w > 0")
    cuts = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.xxhash64(F.substring(F.col("_t"), F.lit(ends + 1) + i * F.col("_w"), F.col("_w"))))
    long = long.select("t", "_t", "_lt", "_w", F.explode(F.array_distinct(cuts)).alias("_key"))
    widths = F.filter(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda i: width(F.col("_len") + i))), lambda w: w > 0)
    short = sized.select(F.col("acc").alias("q"), F.col("seq").alias("_q"), F.col("_len").alias("_lq"), F.explode(widths).alias("_w"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.col("_lq") - F.col("_w") + 1, F.lit(1))), lambda i: F.xxhash64(F.substring(F.col("_q"), i, F.col("_w"))))
    short = short.select("q", "_q", "_lq", "_w", F.explode(F.array_distinct(grams)).alias("_key"))
    ordered = (F.col("_lq") >= F.col("_lt") - reach) & ((F.col("_lq") < F.col("_lt")) | ((F.col("_lq") == F.col("_lt")) & (F.col("_q") < F.col("_t"))))
    met = long.select("t", "_lt", "_w", "_key", "_t").join(short, ["_w", "_key"]).where(ordered).select("q", "t", "_q", "_t").distinct()
    # No alignment with free ends costs less than the plain distance without what is free.
    near = met.where(F.expr(f"levenshtein(_q, _t, {most + 4 * ends}) >= 0")).select("q", "t", A.ends_adjusted("_q", "_t", ends).alias("ed")).where("ed is not null")
    # What is no longer than a sequence without windows has none either.
    near = near.unionByName(_close_in_blocks(sized.where(width(F.col("_len")) == 0), ends, most))
    both = F.explode(F.array(F.struct("q", "t", "ed"), F.struct(F.col("t").alias("q"), F.col("q").alias("t"), "ed"))).alias("e")
    return near.select(both).select("e.*")


def _close_in_blocks(sized: DataFrame, ends: int, most: int) -> DataFrame:
    """`q`, `t`, `ed`, q no longer than t, of sequences (`acc`, `seq`, `_len`) within `most` edits but for `ends` characters: all pairs
    of like lengths, measured many at a time.

    Links are as many as a share of all pairs where reads are alike, so their work is only dealt: each block of a band of lengths
    meets each block of what can be that near to it.
    """
    reach = most + 2 * ends
    band = lambda c: F.floor(c / (reach + 1)).cast("bigint")
    asked = written(sized.select(F.col("acc").alias("q"), F.col("seq").alias("_q"), band(F.col("_len")).alias("band")), "asked")
    bands = F.sequence(band(F.greatest(F.col("_len") - reach, F.lit(0))), band(F.col("_len")))
    held = written(sized.select(F.col("acc").alias("t"), F.col("seq").alias("_t"), F.explode(bands).alias("band")), "held")
    sizes = lambda df, name: df.groupBy("band").agg(F.ceil(F.count("*") / (2 * BLOCK)).alias(name))
    ways = written(sizes(asked, "_asked").join(sizes(held, "_held"), "band"), "ways")
    # Cells are few rows and much work, so they are dealt by number and not by bytes.
    cells = ways.agg(F.sum(F.col("_held") * F.col("_asked"))).first()[0] or 0
    tasks, parts = max(int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cells // 4)), max(1, cells // 32)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    # A row is little and has a copy for each block, so no task makes the copies of all rows.
    asked = asked.repartition(parts, "q").join(ways, "band").select("q", "_q", "band", F.pmod(F.xxhash64("q"), "_asked").alias("a"), every("_held").alias("h"))
    held = held.repartition(parts, "t").join(ways, "band").select("t", "_t", "band", every("_asked").alias("a"), F.pmod(F.xxhash64("t"), "_held").alias("h"))

    def run(queries: pa.Table, targets: pa.Table) -> pa.Table:
        i, k, ed = D.close_among(queries.column("_q").to_pylist(), targets.column("_t").to_pylist(), ends, most)
        return pa.table({"q": queries.column("q").take(pa.array(i)), "t": targets.column("t").take(pa.array(k)), "ed": pa.array(ed, pa.int32())})

    cell, acc = ["band", "a", "h"], sized.schema["acc"].dataType.simpleString()
    asked, held = (x.repartition(tasks, *cell) for x in (asked, held))
    return asked.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(run, f"q {acc}, t {acc}, ed int")
