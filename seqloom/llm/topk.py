"""Operator 6: exact top-k search by integer inner product, with MaxScore.

Each dimension is a term and its column of a shard a posting list. Documents that are
near each other stand together, and lists are cut into blocks of `BLOCK` documents with
their own least and greatest value, from which follow the bounds of a term's share of a
query's scores. A query takes blocks in the order of what they can reach at most, and
its threshold, the k-th best score so far, rises from block to block; blocks below it
are skipped. In a block the query's terms are taken in the order of how far their
bounds lie apart. The leading, essential ones are those without which no document can
reach the threshold; their lists are traversed for all documents of the block. The
others are probed, a few terms at a time, only for documents that can still compete.
Shards are merged by rank. All arithmetic is on integers, so results are exact.

Defined results: see `vectors`; fewer than k candidates give fewer rows; scores that do
not fit into 64 bits are an error; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import common, vectors

#: Terms that are probed together, and documents of a block, at most.
PROBED_TOGETHER, BLOCK = 8, 1024


def quantised(x: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x), x as double."""
    return np.floor(scale * x.astype(np.float64))


def _blocks(docs: np.ndarray) -> list[np.ndarray]:
    """Rows of each block: documents of one nearest centre, cut at BLOCK."""
    n = len(docs)
    centres = docs[:: max(1, n // max(1, n // BLOCK))].astype(np.float64)
    for _ in range(2):
        near = np.concatenate([((centres**2).sum(1) - 2 * part @ centres.T).argmin(1) for part in np.array_split(docs.astype(np.float64), 1 + n // 8192)])
        counts = np.bincount(near, minlength=len(centres))
        order = np.argsort(near, kind="stable")
        begin = np.cumsum(counts) - counts
        there = counts > 0
        centres = np.add.reduceat(docs[order].astype(np.float64), begin[there], axis=0) / counts[there, None]
        begin, counts = begin[there], counts[there]
    return [part for at, m in zip(begin, counts, strict=True) for part in np.array_split(order[at : at + m], -(-m // BLOCK))]


def max_score(queries: np.ndarray, docs: np.ndarray, k: int, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, score) of all pairs that can be among a query's k best; whole numbers in, exact scores out.

    `seen` gets the number of products that were made and that of all products.
    """
    n, terms = docs.shape
    greatest = float(np.abs(queries).max(initial=0)) * float(np.abs(docs).max(initial=0)) * terms
    if greatest >= 2.0**62:
        raise ValueError("scores do not fit into 64 bits")
    kind = np.float64 if greatest < 2.0**52 else np.int64  # both exact
    queries, docs = queries.astype(kind), docs.astype(kind)
    rows = _blocks(docs) if n else []
    lists = [np.ascontiguousarray(docs[r].T) for r in rows]
    low, high = (np.array([f(x, axis=1) for x in lists], kind).reshape(len(rows), terms) for f in (np.min, np.max))
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    reach = up @ high.T + down @ low.T  # of each query and block, the most
    made, found = 0, []
    for i, q in enumerate(queries):
        best, known, kept_d, kept_s = np.zeros(0, kind), None, [], []
        for b in np.argsort(-reach[i], kind="stable").tolist():
            if known is not None and reach[i, b] < known:
                break  # so do all blocks that follow
            block, size = lists[b], len(rows[b])
            if known is None:
                doc, score = np.arange(size), q @ block
                made += size * terms
            else:
                most, least = np.maximum(q * low[b], q * high[b]), np.minimum(q * low[b], q * high[b])
                order = np.argsort(least - most, kind="stable")
                most, least, mine = most[order], least[order], q[order]
                rest = np.append(np.cumsum(most[::-1])[::-1], 0)  # of terms from each on, the most
                hopeless = np.append(0, np.cumsum(least)) + rest < known  # with all lists before this one as low as can be
                essential = int(hopeless.argmax()) if hopeless.any() else terms
                partial = mine[:essential] @ block[order[:essential]]
                made += size * essential
                doc = np.flatnonzero(partial + rest[essential] >= known)
                score = partial[doc]
                for at in range(essential, terms, PROBED_TOGETHER):
                    if not len(doc):
                        break
                    some = slice(at, min(at + PROBED_TOGETHER, terms))
                    score = score + mine[some] @ block[order[some]][:, doc]
                    made += len(doc) * (some.stop - some.start)
                    keep = score + rest[some.stop] >= known
                    doc, score = doc[keep], score[keep]
            kept_d.append(rows[b][doc])
            kept_s.append(score)
            best = np.sort(np.append(best, score))[-k:]
            known = best[0] if len(best) == k else None
        d, s = np.concatenate(kept_d or [np.zeros(0, np.int64)]), np.concatenate(kept_s or [best])
        if known is not None:
            d, s = d[s >= known], s[s >= known]
        found.append((np.full(len(d), i), d, s))
    if seen is not None:
        seen[:] = [made, len(queries) * n * terms]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True))


def top_k(df: DataFrame, k: int, query_every: int, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Each query's k highest scores; queries are the rows whose id is divisible by `query_every`."""

    def score(cell: vectors.Cell):
        # One more: the query itself may be among the best.
        return max_score(quantised(cell.queries, scale), quantised(cell.vectors, scale), k + 1)

    return vectors.search(vectors.usable(df, key, vector), F.col("_id") % query_every == 0, k, score, "bigint")


def op6_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every 50th vector."""
    return top_k(common.table(spark, sf_dir, "embeddings"), 5, 50)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
