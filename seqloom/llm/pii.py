"""Operator 4: personal data by weak supervision.

Base patterns fix what certainly is a span. Further candidates come from wider
patterns: written-out mail addresses, telephone numbers without a plus sign, card
numbers that the base dropped, addresses of version 6. Labelers vote on every
candidate, base spans included: the strict form (regex), endings, areas and issuers
(gazetteers), and what stands around it (context): words that announce its kind, prose
on both sides or numbers beside it, words that speak against all kinds. Expectation-maximisation, run for
each kind on the counts of vote patterns, estimates how reliable each labeler is and
how likely each pattern is personal data; these likelihoods train the final
classifier of spans, a logistic regression on votes and shape. Candidates that it
accepts and that overlap no base span are added; base spans always stay.

Vote patterns are few (kinds and votes are from fixed sets), so their counts over all
documents are what the driver gets, at any input size.

Defined results: a null or empty text has no spans; repeated rows are searched as
often as they occur; texts are searched whole; an empty table gives an empty table;
further columns are kept by `find` and `redact`, except that output columns replace
columns of the same name.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import common

KINDS = ("email", "ip", "card", "phone")
#: A candidate beyond the base is added from this likelihood on.
ACCEPTED = 0.9
#: Characters before a candidate that context labelers read.
CONTEXT = 32

# The base patterns for addresses, in a form that takes a run of characters once: a match begins where its run does, or where
# the match before ends, and a run that no address follows holds no beginning of one. What follows the run is the group.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]").search
_NOT_DIGIT = re.compile("[^0-9]")

#: Wider patterns by kind.
_WIDE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]++)++", re.I), "at"),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"), ":"),
    ("card", re.compile(r"(?<![0-9A-Za-z.])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])"), ""),
    ("phone", re.compile(r"(?<![0-9A-Za-z+.])(?:\([0-9]{2,4}\) ?|0[0-9]{1,4}[ /-]|[0-9]{3}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,5}(?![0-9A-Za-z])"), ""),
)
#: Gazetteers: endings of host names, first digits of card numbers, dialling codes.
_ENDINGS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl be ch at pl pt se no fi dk ie eu us ca au nz jp cn in br mx ru".split())
_ISSUERS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "60", "62", "65")
_DIALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "64", "7", "81", "82", "86", "90", "91")
#: Words before a span that speak for a kind, and words that speak against all.
_FOR = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|correo|courriel|kontakt)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|addr|adresse)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:tel|phone|call|fax|mobile|cell|telefon|téléphone|teléfono)\b", re.I),
}
_AGAINST = re.compile(r"(?:\b(?:version|isbn|issn|order|invoice|id|ref|page|chapter|section|build|sku|total|amount)\b[ :#.]*|[#$€£=]) ?$", re.I)
#: The beginning of the word after a span, and words of prose. A span between two of them stands in a sentence, one beside a
#: number in a table or a series.
_NEXT, _PROSE = re.compile(r"[^\s]{0,8}\s{0,4}([^\s]{0,32})"), re.compile(r"[^\W\d_]+[.,;:!?]?")
VOTES = ("strict", "gazetteer", "context", "against", "alone")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns, by start."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _EMAIL.finditer(text) if m[1]]
    if _DIGIT(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if m[1] and all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out)


def wide_spans(text: str) -> list[tuple[int, int, int]]:
    """Candidates of the wider patterns, by start."""
    low = text.lower()
    if not _DIGIT(text) and "at)" not in low and "at]" not in low and "at}" not in low:
        return []
    return sorted((m.start(), KINDS.index(kind), m.end()) for kind, pattern, need in _WIDE if need in low for m in pattern.finditer(text))


def votes(text: str, span: tuple[int, int, int], base: bool) -> str:
    """Each labeler's vote on a span, `+`, `-` or `0` (none), in the order of VOTES."""
    start, k, end = span
    kind, what, before = KINDS[k], text[start:end], text[max(0, start - CONTEXT) : start]
    digits = _NOT_DIGIT.sub("", what)
    if kind == "email":
        gazetteer = what.rstrip(")]}").lower().replace("]", ".").replace(")", ".").split(".")[-1].strip() in _ENDINGS
        strict = base
    elif kind == "ip":
        gazetteer = not what.startswith(("0.", "255."))
        strict = base or ":" in what
    elif kind == "card":
        gazetteer = digits.startswith(_ISSUERS)
        strict = 12 <= len(digits) <= 19 and _luhn(digits)
    else:
        gazetteer = digits.startswith(_DIALLING) if what.startswith("+") else what.startswith(("(", "0"))
        strict = 9 <= len(digits) <= 15 and (what.startswith("+") or base)
    edges = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    after = _NEXT.match(text, end)[1]
    last = before.split()[-1:]
    if _FOR[kind].search(before) or (last and after and _PROSE.fullmatch(last[0]) and _PROSE.fullmatch(after)):
        context = "+"
    else:
        context = "-" if any(_DIGIT(x) for x in (*last, after)) else "0"
    return ("+" if strict else "-") + ("+" if gazetteer else "-") + context + ("-" if _AGAINST.search(before) else "0") + ("+" if edges else "-")


def shape(text: str, span: tuple[int, int, int]) -> str:
    """The kind of characters of a span, at most a few values."""
    what = text[span[0] : span[2]]
    marks = "".join(c for c in " -.+(:@" if c in what)
    return f"{marks}|{min(len(_NOT_DIGIT.sub('', what)), 20) // 3}"


def _patterns(text: str) -> list[str]:
    """kind, base or not, votes and shape of every candidate of a text."""
    base = base_spans(text)
    out = [f"{KINDS[s[1]]}\tb\t{votes(text, s, True)}\t{shape(text, s)}" for s in base]
    return out + [f"{KINDS[s[1]]}\tw\t{votes(text, s, False)}\t{shape(text, s)}" for s in _beside(wide_spans(text), base)]


def _beside(wide: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Wide candidates that overlap no base span, nor an earlier one of theirs."""
    out, taken = [], sorted((a, b) for a, _, b in base)
    starts = [a for a, _ in taken]
    furthest = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0, int)
    last = -1
    for a, k, b in wide:
        i = int(np.searchsorted(starts, b)) - 1  # the last base span that begins before this one's end
        if a >= last and (i < 0 or furthest[i] <= a):
            out.append((a, k, b))
            last = b
    return out


def reliabilities(counts: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], dict[str, float]]:
    """Likelihood of each vote pattern of one kind, and each labeler's accuracy, by expectation-maximisation.

    Labelers are taken as independent given the truth; each has a chance of each vote for personal data and for
    other text. The strict form starts as the most trusted.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    given = np.array([[{"+": 2, "0": 1, "-": 0}[c] for c in p] for p in patterns])
    start = np.array([0.9, 0.7, 0.7, 0.7, 0.6])
    chance = np.array([[[1 - a, 0.3, a], [a, 0.3, 1 - a]] for a in start])  # labeler, (personal, other), vote
    prior = 0.5
    for _ in range(rounds):
        logs = np.log(chance / chance.sum(axis=2, keepdims=True))
        each = np.array([[logs[j, y, row[j]] for j in range(len(start))] for row in given for y in (0, 1)]).sum(axis=1).reshape(-1, 2)
        each += np.log([prior, 1 - prior])
        p = 1 / (1 + np.exp(np.clip(each[:, 1] - each[:, 0], -50, 50)))
        prior = float((n * p).sum() + 1) / float(n.sum() + 2)
        for j, a in enumerate(start):
            for y, weight in enumerate((p, 1 - p)):
                seen = np.bincount(given[:, j], n * weight, 3)
                chance[j, y] = seen + 2 * np.array([1 - a, 0.3, a] if y == 0 else [a, 0.3, 1 - a])  # the start counts as two spans
    right = {v: float(chance[j, 0, 2] / chance[j, 0, [0, 2]].sum() + chance[j, 1, 0] / chance[j, 1, [0, 2]].sum()) / 2 for j, v in enumerate(VOTES)}
    return dict(zip(patterns, map(float, p), strict=True)), right


@dataclass(frozen=True)
class Model:
    """The span classifier's weights, and what is known of the labelers."""

    weights: dict[str, float]
    accuracy: dict[str, dict[str, float]]

    def likelihood(self, kind: str, vote: str, form: str) -> float:
        z = sum(self.weights.get(f, 0.0) for f in _span_features(kind, vote, form))
        return float(1 / (1 + np.exp(-z)))


def _span_features(kind: str, vote: str, form: str) -> list[str]:
    return ["bias", kind, f"{kind}/{form}", *(f"{kind}/{v}{c}" for v, c in zip(VOTES, vote, strict=True))]


def fit(counts: dict[tuple[str, str, str], int], rounds: int = 20) -> Model:
    """counts: of (kind, votes, shape) over all documents."""
    soft: dict[tuple[str, str, str], float] = {}
    accuracy = {}
    for kind in KINDS:
        by_vote: dict[str, int] = {}
        for (k, vote, _), n in counts.items():
            if k == kind:
                by_vote[vote] = by_vote.get(vote, 0) + n
        if by_vote:
            likely, accuracy[kind] = reliabilities(by_vote)
            soft |= {key: likely[key[1]] for key in counts if key[0] == kind}
    keys = sorted(counts)
    names = sorted({f for key in keys for f in _span_features(*key)})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(keys), len(names)))
    for i, key in enumerate(keys):
        x[i, [at[f] for f in _span_features(*key)]] = 1
    y, n = np.array([soft[k] for k in keys]), np.array([counts[k] for k in keys], float)
    n = n / max(1.0, n.sum() / 1000)  # the penalty keeps its share at any input size
    w = np.zeros(len(names))
    for _ in range(rounds if keys else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope, curve = x.T @ (n * (p - y)) + 0.1 * w, (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    return Model({f: round(float(w[i]), 9) for f, i in at.items()}, accuracy)


def train(docs: DataFrame, text: str = "text") -> Model:
    """Estimate on all documents."""
    common.tune(docs.sparkSession)

    def run(batches):
        for batch in batches:
            seen: dict[str, int] = {}
            for t in batch.column(0).to_pylist():
                for p in _patterns(t) if t else ():
                    seen[p] = seen.get(p, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["p", "n"])

    rows = docs.select(text).mapInArrow(run, "p string, n bigint").groupBy("p").agg(F.sum("n").alias("n")).collect()  # a row for each pattern
    counts: dict[tuple[str, str, str], int] = {}
    for p, n in rows:
        kind, _, vote, form = p.split("\t")
        counts[kind, vote, form] = counts.get((kind, vote, form), 0) + n
    return fit(counts)


def spans_of(text: str | None, model: Model, accepted: float = ACCEPTED) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text."""
    if not text:
        return [], []
    base = base_spans(text)
    more = [s for s in _beside(wide_spans(text), base) if model.likelihood(KINDS[s[1]], votes(text, s, False), shape(text, s)) >= accepted]
    return base, sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    """`kind:start:end`, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `n_email`, `n_ip`, `n_card`, `n_phone` (base), `base_sha256`, `spans` (all)."""
    common.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a weight for each labeler's vote and shape
    new = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    keep = [c for c in docs.columns if c not in new]
    at = keep.index(text)

    def run(batches):
        for batch in batches:
            both = [spans_of(t, shared.value) for t in batch.column(at).to_pylist()]
            columns = [pa.array([sum(s[1] == k for s in b) for b, _ in both], pa.int64()) for k in range(len(KINDS))]
            columns.append(pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in both], pa.string()))
            columns.append(pa.array([joined(s) for _, s in both], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*keep, *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select(*keep).mapInArrow(run, f"{schema}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Text with each span as its kind in brackets; of overlapping spans the first stands for all."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with personal data in `text` replaced; null texts stay null."""
    common.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            clean = [None if t is None else redacted(t, spans_of(t, shared.value)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, text, pa.array(clean, pa.string()))
        common.release()

    return docs.mapInArrow(run, docs.schema)


def op4_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, train(docs)).drop("text")
