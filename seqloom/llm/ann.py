"""Operator 9: approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of one word from each of several codebooks, all of
the vectors' full dimension. Codebooks start as k-means of the residuals and are then
fitted together by least squares, in turn with encoding by beam search. Each row is
stored with its codes, its length and its approximation's length; a query's inner
products with all words make a lookup table, a candidate's score is the sum of its
codes' entries corrected by the two lengths, and the best are scored again on the
original vectors.

The codebooks are fitted on at most `SAMPLE` rows, those with the least hashes of
their ids; every row is encoded and searched.

Defined results: see `vectors`; zero vectors take no part either; fewer candidates
than asked for give fewer rows; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import common, vectors

#: Rows that codebooks are fitted on at most; codebooks, words of each, width of the beam.
SAMPLE, BOOKS, WORDS, BEAM = 4096, 16, 256, 2
#: Share of a shard's candidates that are scored again for each query, at every size of the table; queries scored together.
RERANKED, TOGETHER = 0.1, 256


def _means(x: np.ndarray, words: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    book = x[rng.choice(len(x), words, replace=len(x) < words)].copy()
    for _ in range(rounds):
        near = ((book**2).sum(1) - 2 * x @ book.T).argmin(1)
        for w in np.unique(near):
            book[w] = x[near == w].mean(0)
    return book


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes of each row, by beam search over the codebooks in their order."""
    n, many = len(x), len(books)
    codes, rest = np.zeros((n, 1, 0), np.uint8), x[:, None, :]
    rows = np.arange(n)[:, None]
    for m in range(many):
        error = (books[m] ** 2).sum(1) - 2 * rest @ books[m].T + (rest**2).sum(2)[..., None]  # of each beam and word
        flat = error.reshape(n, -1)
        keep = min(beam if m + 1 < many else 1, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(flat.shape[1]), (n, 1))
        parent, word = best // books.shape[1], best % books.shape[1]
        codes = np.concatenate([codes[rows, parent], word[..., None].astype(np.uint8)], axis=2)
        rest = rest[rows, parent] - books[m][word]
    return codes[:, 0]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The approximations that codes stand for."""
    return sum(books[m][codes[:, m]] for m in range(len(books)))


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2, steps: int = 8, seed: int = 7) -> np.ndarray:
    """Codebooks [books, words, dimension]."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    rest, made = x.copy(), []
    for _ in range(books):
        book = _means(rest, words, 4, rng)
        rest = rest - book[((book**2).sum(1) - 2 * rest @ book.T).argmin(1)]
        made.append(book)
    out = np.stack(made)
    for _ in range(rounds):  # all codebooks together, given the codes: conjugate gradients on the normal equations
        codes = encode(x, out)
        hot = [np.eye(words, dtype=np.float32)[codes[:, m]].T for m in range(books)]
        gather = lambda y, hot=hot: np.stack([h @ y for h in hot])
        left = gather(x - decode(codes, out)) - 0.1 * out
        move, size = left, float((left**2).sum())
        for _ in range(steps):
            if size < 1e-9:
                break
            image = gather(decode(codes, move)) + 0.1 * move
            step = size / float((move * image).sum())
            out, left = out + step * move, left - step * image
            size, before = float((left**2).sum()), size
            move = left + size / before * move
    return out.astype(np.float32)


def index(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Every usable row with its codes, length and the length of its approximation; and the codebooks."""
    common.tune(df.sparkSession)
    rows = vectors.usable(df, key, vector).where(F.exists("_vec", lambda x: x != 0))
    sample = rows.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).collect()  # at most SAMPLE rows
    longest = max((len(r["_vec"]) for r in sample), default=1)
    x = np.array([r["_vec"] for r in sample if len(r["_vec"]) == longest], np.float32).reshape(-1, longest)
    books = fit(x) if len(x) else np.zeros((BOOKS, WORDS, longest), np.float32)

    def run(batches):
        for batch in batches:
            one = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            codes = encode(one, books)
            sizes = [np.linalg.norm(v.astype(np.float64), axis=1) for v in (one, decode(codes, books))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), *map(pa.array, sizes)], ["_id", "_vec", "codes", "norm", "approximate_norm"])

    made = rows.where(F.size("_vec") == longest).mapInArrow(run, "_id bigint, _vec array<float>, codes binary, norm double, approximate_norm double")
    return made, books


def nearest(df: DataFrame, k: int, query_every: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's k nearest found, by inner product; queries are the rows whose id is divisible by `query_every`."""
    made, books = index(df, key, vector)

    def score(cell: vectors.Cell):
        codes = np.frombuffer(b"".join(cell.extra["codes"].to_pylist()), np.uint8).reshape(len(cell.vectors), -1)
        scale = (cell.extra["norm"].to_numpy() / np.maximum(cell.extra["approximate_norm"].to_numpy(), 1e-12)).astype(np.float32)
        n, picked = len(codes), []
        keep = max(int(np.ceil(RERANKED * n)), 3 * (k + 1))
        for at in range(0, len(cell.queries), TOGETHER):
            asked = cell.queries[at : at + TOGETHER].astype(np.float32)
            tables = books @ asked.T  # of each codebook, words by queries
            total = tables[0][codes[:, 0]]
            for m in range(1, len(books)):
                total += tables[m][codes[:, m]]
            total *= scale[:, None]
            most = min(keep, n)
            best = np.argpartition(-total.T, most - 1, axis=1)[:, :most] if most < n else np.tile(np.arange(n), (len(asked), 1))
            picked.append(best)
        query, vector, exact = [], [], []
        doubles = cell.vectors.astype(np.float64)
        for row, best in enumerate(np.concatenate(picked)):
            scores = (doubles[best] * cell.queries[row].astype(np.float64)).sum(axis=1)
            top = np.flatnonzero(scores >= np.partition(scores, -k - 1)[-k - 1]) if len(scores) > k else np.arange(len(scores))
            query.append(np.full(len(top), row))
            vector.append(best[top])
            exact.append(scores[top])
        return np.concatenate(query), np.concatenate(vector), np.concatenate(exact)

    return vectors.search(common.materialize(made, "codes"), F.col("_id") % query_every == 0, k, score, "double", ("codes", "norm", "approximate_norm"))


def op9_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector."""
    return nearest(common.table(spark, sf_dir, "embeddings"), 20, 20)
