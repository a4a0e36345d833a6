"""Block layout of a search: a stated set of query rows against all rows of a table of vectors.

Rows are dealt by a hash of their id into shards of candidates, of bounded size. A
shard goes to one task, once; the queries come after it as a stream, and are scored
against it block by block. So candidates are shuffled once, queries once for each
shard, and only the k best of each shard are merged by rank. A vector that occurs often
is scored once in a shard, and enough of its ids are kept to fill any answer, so copies
neither crowd out other vectors nor multiply the work.

Vectors that are null or of another length than the longest, or that hold null or
non-finite components, take no part. Repeated rows count once; for an id with several
vectors a pair's best score counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a shard and of a block of queries, about, and of either so many that a cell's vectors and scores take CELL_BYTES at most.
SHARD_ROWS, BLOCK_ROWS, CELL_BYTES = 32_768, 1_024, 256 << 20


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows that take part, as `_id`, `_vec`."""
    v = F.col(vector)
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.where(F.coalesce(fine, F.lit(False)) & F.col(key).isNotNull() & (F.size(v) > 0)).select(F.col(key).alias("_id"), v.cast("array<float>").alias("_vec"))


@dataclass
class Cell:
    """One block of queries and one shard of candidates; equal candidate vectors are one row."""

    query_ids: np.ndarray
    queries: np.ndarray
    vectors: np.ndarray
    ids: np.ndarray  # of candidates, those of one vector together, ascending
    first: np.ndarray  # of each vector, where its ids begin; one entry more than vectors
    extra: dict[str, pa.ChunkedArray]  # further columns of each vector


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if rows else pa.array([], pa.float32())
    return np.asarray(flat).reshape(rows, -1)


class _Shard:
    """The candidates of one shard, and blocks of queries against them."""

    def __init__(self, right: pa.Table, extra: list[str]) -> None:
        ids, vectors = right.column("_id").to_numpy(), _matrix(right.column("_vec"), right.num_rows) + np.float32(0)  # no negative zero
        rows = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 4))).ravel()
        _, at, group = np.unique(rows, return_index=True, return_inverse=True)
        order = np.lexsort((ids, group))
        ids, group = ids[order], group[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (group[1:] != group[:-1])
        ids, group = ids[new], group[new]
        self.rest = vectors[at], ids, np.searchsorted(group, np.arange(len(at) + 1)), {c: right.column(c).take(pa.array(at)) for c in extra}

    def cell(self, left: pa.Table) -> Cell:
        """The shard with one block of queries."""
        return Cell(left.column("_id").to_numpy(), _matrix(left.column("_vec"), left.num_rows), *self.rest)


def answers(cell: Cell, k: int, score: Callable[[Cell], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    """The k best (query_id, vec_id, score) of each query among scored pairs; ties go to smaller ids, a query's own id is left out."""
    query, vector, score = score(cell)
    take = np.minimum(np.diff(cell.first), k + 1)[vector]  # the query's own id may be one of them
    pair = np.repeat(np.arange(len(vector)), take)
    ids = cell.ids[np.arange(len(pair)) - np.repeat(np.cumsum(take) - take, take) + cell.first[vector][pair]]
    asks, scores = cell.query_ids[query][pair], score[pair]
    keep = ids != asks
    ids, asks, scores = ids[keep], asks[keep], scores[keep]
    order = np.lexsort((ids, -scores, asks))
    ids, asks, scores = ids[order], asks[order], scores[order]
    if len(np.unique(cell.query_ids)) < len(cell.query_ids) or len(np.unique(cell.ids)) < len(cell.ids):
        _, first = np.unique(np.stack([asks, ids]), axis=1, return_index=True)
        first.sort()
        ids, asks, scores = ids[first], asks[first], scores[first]
    begin = np.searchsorted(asks, asks)
    keep = np.arange(len(asks)) - begin < k
    return pa.table({"query_id": pa.array(asks[keep], pa.int64()), "vec_id": pa.array(ids[keep], pa.int64()), "score": pa.array(scores[keep])})


def search(rows: DataFrame, is_query: Column, k: int, score: Callable[[Cell], tuple[np.ndarray, np.ndarray, np.ndarray]], kind: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score` of the k best candidates of each query.

    rows: `_id`, `_vec` and the columns `extra`. score gives (query, vector, score) of the pairs of a cell that can be among its k best.
    """
    spark = rows.sparkSession
    total, asked, longest = rows.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max(F.size("_vec"))).first()
    held = max(CELL_BYTES // (24 * (longest or 1)), 1)  # a vector as given and as doubles, twice
    in_shard, in_block = min(SHARD_ROWS, held), min(BLOCK_ROWS, held, max(CELL_BYTES // (8 * SHARD_ROWS), 1))
    shards = max(-(-total // in_shard), min(spark.sparkContext.defaultParallelism, -(-total // 256)), 1)
    rows = rows.where(F.size("_vec") == F.lit(longest or 0))
    dealt = F.pmod(F.xxhash64("_id", F.lit(2)), F.lit(shards)).cast("int").alias("_shard")
    candidates = rows.select(dealt, F.lit(0).alias("_kind"), "_id", "_vec", *extra)
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in extra]
    queries = rows.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"), F.lit(1).alias("_kind"), "_id", "_vec", *none)
    parts = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stream = candidates.unionByName(queries).repartition(parts, "_shard").sortWithinPartitions("_shard", "_kind")

    def run(batches):
        at, shard, held, asked_, n = None, None, [], [], 0

        def scored():
            nonlocal shard, held, asked_, n
            if held or shard:
                shard = shard or _Shard(pa.Table.from_batches(held), list(extra))
                held = []
                yield from answers(shard.cell(pa.Table.from_batches(asked_)), k=k, score=score).to_batches()
            asked_, n = [], 0

        for batch in batches:
            shards_, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            begin = 0
            while begin < len(kinds):
                end = begin + int(np.argmax(np.append((shards_[begin:] != shards_[begin]) | (kinds[begin:] != kinds[begin]), True)))
                if at != shards_[begin]:
                    if n:
                        yield from scored()
                    at, shard, held = shards_[begin], None, []
                if kinds[begin] == 0:
                    held.append(batch.slice(begin, end - begin))
                else:
                    for first in range(begin, end, in_block):
                        some = batch.slice(first, min(in_block, end - first))
                        if n and n + some.num_rows > in_block:
                            yield from scored()
                        asked_.append(some)
                        n += some.num_rows
                begin = end
        if n:
            yield from scored()

    found = stream.mapInArrow(run, f"query_id bigint, vec_id bigint, score {kind}")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
