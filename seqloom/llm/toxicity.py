"""Operator 3: toxicity by a counterfactual-regularised classifier.

A logistic regression on which words, and which beginnings of words, a text has. The
features are those whose document counts differ most, for their size, between the two
labels. In labelled sentences that name a group, that term is swapped for another of
its kind, and the squared change of the score's log-odds is penalised, so that who is
named does not count by itself; every listed term is a feature, so that the penalty
reaches all of them. The terms are a parameter. Training warns if it saw no such
sentence, since the penalty then has no effect; the model says how many texts had one.

Fitted on at most `SAMPLE` labelled rows of each label, those with the least hashes of
their ids; every text is scored, whole.

Defined results: a null or empty text has the score of a text without any feature;
repeated rows are scored as often as they occur, and learned from once for each id
(the least of its texts); several labels of one document count as 1 if one of them is; null labels are no labels; without any label of a kind the
score is the share of toxic labels, 0 without labels; an empty table gives an empty
table; further columns are never inputs.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import common

#: Labelled rows of each label to fit on at most; features; penalties on weights and on changes under swaps.
SAMPLE, FEATURES, RIDGE, SWAP_PENALTY = 3000, 512, 1.0, 20.0
#: Lengths of the beginnings of words that are features.
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.3
#: Terms that name a group, by kind.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("girls", "boys"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("transgender", "trans", "cisgender", "nonbinary"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "african", "european", "indigenous"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists"),
    ("immigrant", "migrant", "refugee", "native", "foreigner"),
    ("immigrants", "migrants", "refugees", "natives", "foreigners"),
    ("mexican", "american", "chinese", "indian", "german", "french", "spanish", "polish", "turkish", "russian", "nigerian"),
    ("old", "young", "elderly", "teenage"),
    ("deaf", "blind", "disabled", "autistic"),
)
_WORDS = re.compile(r"[^\W\d_]+").findall


def swaps(terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> dict[str, str]:
    """Each term and the next of its kind."""
    return {t: kind[(i + 1) % len(kind)] for kind in terms for i, t in enumerate(kind)}


_SWAP = swaps()


def features_of(word: str) -> list[str]:
    """A word in lower case and its beginnings; terms of groups only as themselves."""
    if word in _SWAP:
        return [word]
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


def features(text: str | None) -> set[str]:
    """What a text has."""
    return {f for w in set(_WORDS((text or "").lower())) for f in features_of(w)}


def swapped(text: str | None) -> str | None:
    """The sentences that name a group, with each such name swapped; None if there are none."""
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+|\n", (text or "").lower()):
        words = _WORDS(sentence)
        if any(w in _SWAP for w in words):
            out.append((" ".join(words), " ".join(_SWAP.get(w, w) for w in words)))
    return "\n".join(a for a, _ in out) + "\t" + "\n".join(b for _, b in out) if out else None


@dataclass(frozen=True)
class Model:
    """Weights of features, the bias, and how many texts the penalty saw swapped."""

    weights: dict[str, float]
    bias: float
    pairs: int = 0

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-(self.bias + sum(self.weights.get(f, 0.0) for f in sorted(features(text)))))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class _Scorer:
    """Scores lists of texts; remembers which features a word has."""

    def __init__(self, model: Model) -> None:
        self.weights, self.bias = model.weights, model.bias
        self.known: dict[str, tuple[str, ...]] = {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = []
        for text in texts:
            found: set[str] = set()
            for w in set(_WORDS((text or "").lower())):
                fs = self.known.get(w)
                if fs is None:
                    fs = self.known[w] = tuple(f for f in features_of(w) if f in self.weights)
                if fs:
                    found.update(fs)
            out.append(self.bias + sum(self.weights[f] for f in sorted(found)))
            if len(self.known) > 150_000:
                self.known.clear()
        return _sigmoid(np.array(out, float))


def fit(rows: list[tuple[list[str], list[str], list[str], int]], chosen: list[str], share: float, ridge: float = RIDGE, penalty: float = SWAP_PENALTY) -> Model:
    """rows: features of each labelled text, features of its group-naming sentences before and after swapping, label. share: of toxic labels among all."""
    labels = np.array([r[3] for r in rows], float)
    if not len(rows) or labels.min() == labels.max():
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model({}, float(np.log(share / (1 - share))))
    n_pos, n_neg = (labels == 1).sum(), (labels == 0).sum()
    chosen = sorted({*chosen, *_SWAP})
    at = {f: i for i, f in enumerate(chosen)}

    def matrix(lists: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(lists), len(chosen) + 1))
        out[:, -1] = 1
        for i, fs in enumerate(lists):
            out[i, [at[f] for f in fs if f in at]] = 1
        return out

    x = matrix([r[0] for r in rows])
    pairs = [r for r in rows if set(r[1]) != set(r[2])]
    if not pairs:
        logging.getLogger(__name__).warning("no labelled text holds a listed term: the counterfactual penalty has no effect")
    change = matrix([r[1] for r in pairs]) - matrix([r[2] for r in pairs])
    hold = np.diag([ridge] * len(chosen) + [1e-3]) + penalty * change.T @ change
    # As many of each label as there are in all, not as in the sample.
    weight = np.where(labels == 1, share / (n_pos / len(rows)), (1 - share) / (n_neg / len(rows)))
    w = np.zeros(len(chosen) + 1)
    for _ in range(25):  # Newton's method
        p = _sigmoid(x @ w)
        slope = x.T @ (weight * (p - labels)) + hold @ w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + hold, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Model({f: round(float(w[i]), 9) for f, i in at.items() if w[i]}, round(float(w[-1]), 9), len(pairs))


def held_out(key: str = "doc_id"):
    """True for rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = SWAP_PENALTY) -> Model:
    """Fit on labelled documents; `labels` has doc_id and toxic, and only rows to learn from."""
    common.tune(docs.sparkSession)
    one = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("_y"))
    counts = {r[0]: r[1] for r in one.groupBy("_y").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    picked = None
    for y in (0, 1):
        part = one.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = part if picked is None else picked.union(part)
    taken = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text"))  # at most 2 * sample rows
    taken = taken.select("doc_id", "text", "_y")

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            both = [(swapped(t) or "\t").split("\t") for t in texts]
            lists = [[sorted(features(t)) for t in texts], *([sorted(features(b[k])) for b in both] for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.list_(pa.string())) for x in lists), batch.column(2)], ["doc_id", "f", "a", "b", "y"])

    seen = common.materialize(taken.mapInArrow(run, "doc_id bigint, f array<string>, a array<string>, b array<string>, y int"), "labelled")
    size = {r[0]: r[1] for r in seen.groupBy("y").count().collect()}
    n_pos, n_neg = F.lit(float(size.get(1, 0))), F.lit(float(size.get(0, 0)))
    counts = seen.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    pos, neg, less_pos, less_neg = F.col("pos") + 0.5, F.col("neg") + 0.5, n_pos - F.col("pos") + 0.5, n_neg - F.col("neg") + 0.5
    z = F.abs((F.log(pos / less_pos) - F.log(neg / less_neg)) / F.sqrt(1 / pos + 1 / neg + 1 / less_pos + 1 / less_neg))
    best = counts.where("pos + neg >= 4").select("f", F.round(z, 9).alias("z")).where("z >= 2.5").orderBy(F.desc("z"), "f").limit(FEATURES)
    chosen = [r["f"] for r in best.collect()]
    wanted = F.array(*map(F.lit, sorted({*chosen, *_SWAP})))
    rows = seen.select("doc_id", *(F.array_intersect(c, wanted).alias(c) for c in ("f", "a", "b")), "y").collect()  # at most 2 * sample rows of few features
    data = sorted((r["doc_id"], sorted(r["f"]), r["a"], r["b"], r["y"]) for r in rows)
    return fit([d[1:] for d in data], chosen, share, penalty=penalty)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with `score` and `predicted`."""
    common.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights and the listed terms
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    at = keep.index(text)

    def run(batches):
        weigh = _Scorer(shared.value)
        for batch in batches:
            p = weigh(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select(*keep).mapInArrow(run, f"{schema}, score double, predicted int")


def reject(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose text scores below the threshold."""
    common.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        weigh = _Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(weigh(batch.column(at).to_pylist()) < threshold))
        del weigh
        common.release()

    return docs.mapInArrow(run, docs.schema)


def learned(spark: SparkSession, sf_dir: str) -> Model:
    """The model of the supplied labels."""
    labels = common.table(spark, sf_dir, "labels").where(~held_out())
    return train(common.table(spark, sf_dir, "documents"), labels)


def op3_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, learned(spark, sf_dir)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
