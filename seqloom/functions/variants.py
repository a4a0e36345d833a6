"""Variants between a candidate and its reference, which reads support them, and how likely errors explain them."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import takewhile

TRUSTED = 43.0


@dataclass(frozen=True)
class Variant:
    """A differing column: position in the reference's and in the candidate's coordinates, S, I or D, its run's multiplicity, and the
    candidate's row from the column before it to the one after its run.
    """

    t: int
    c: int
    kind: str
    base: str
    run: int
    seen: str


def masked(a: str, b: str) -> tuple[int, int]:
    """First column after the gaps that a side begins with, and first column of the gaps that a side ends with."""
    lead = max(len(x) - len(x.lstrip("-")) for x in (a, b))
    tail = max(len(x) - len(x.rstrip("-")) for x in (a, b))
    return lead, len(a) - tail


def _run(s: str, base: str) -> int:
    return sum(1 for _ in takewhile(lambda x: x == base, s))


def variants(ref: str, cand: str) -> list[Variant]:
    """Variants of a gapped pair inside its mask; several inserted bases at one place count as the last of them."""
    start, end = masked(ref, cand)
    t, c = len(ref[:start].replace("-", "")), len(cand[:start].replace("-", ""))
    plain = ref.replace("-", "")
    found: dict[tuple[int, str], Variant] = {}
    for i in range(start, end):
        x, y = ref[i], cand[i]
        if x != y:
            if x == "-":
                around = _run(plain[t:], y) + _run(plain[:t][::-1], y)
                kind, base, run = "I", y, around + 1 if around else 1
            elif y == "-":
                kind, base, run = "D", x, _run(plain[t + 1 :], x) + _run(plain[: t + 1][::-1], x)
            else:
                kind, base, run = "S", y, 1
            found[t, kind] = Variant(t, c, kind, base, run, cand[max(0, i - 1) : i + run + 1])
        t += x != "-"
        c += y != "-"
    return sorted(found.values(), key=lambda v: (v.t, v.kind))


def _columns_of(gapped: str) -> list[int]:
    """Alignment column of each base."""
    return [i for i, x in enumerate(gapped) if x != "-"]


def supports(template: str, read: str, found: list[Variant], own: bool) -> bool:
    """Whether a read, aligned to its template, has the candidate's row at every variant, column by column, gaps included.

    own: the template is the candidate, and its own row counts; otherwise it is the reference, and what the candidate's row has in
    their alignment. An inserted base is numbered by the reference's base after it, so the window begins one column before.
    """
    columns = _columns_of(template)
    for v in found:
        at = v.c if own else v.t
        if at >= len(columns):
            return False
        earlier = 1 if v.kind == "I" and not own else 0
        a, b = max(0, columns[at] - 1 - earlier), columns[at] + v.run + 1 - earlier
        if read[a:b] != (template[a:b] if own else v.seen):
            return False
    return True


def qualities_at(template: str, read: str, phred: list[int], places: list[int]) -> list[int]:
    """Quality of the read's base at each place of its template; at a gap that of the base after it, at the end that of the last."""
    columns, before, n = _columns_of(template), [], 0
    for x in read:
        before.append(n)
        n += x != "-"
    out = []
    for at in places:
        column = columns[at] if at < len(columns) else len(read) - 1
        out.append(int(phred[min(before[column], len(phred) - 1)]))
    return out


def error_counts(template: str, read: str) -> tuple[int, int, int]:
    """Insertions, deletions and substitutions of a read inside the mask."""
    start, end = masked(template, read)
    pairs = list(zip(template[start:end], read[start:end], strict=True))
    return sum(x == "-" != y for x, y in pairs), sum(y == "-" != x for x, y in pairs), sum(x != y and "-" not in (x, y) for x, y in pairs)


def chance(found: list[Variant], errors: tuple[int, int, int], length: int) -> float:
    """Probability that a read with these errors has all variants by error, without qualities."""
    ins, dele, subs = (max(e, len(found)) for e in errors)
    p = 1.0
    for v in found:
        if v.kind == "S":
            p *= subs / length / 3 * v.run
        elif v.kind == "I":
            p *= min(0.5, ins / length / 4 * v.run)
        else:
            p *= min(0.5, dele / length * v.run)
    return p if p < 1 else 0.99999


def chance_by_quality(found: list[Variant], qualities: list[int], ratios: tuple[float, float, float], trusted: float = TRUSTED) -> float:
    """The same from the qualities at the variants; ratios: of insertions, deletions, substitutions among errors."""
    p = 1.0
    for v, q in zip(found, qualities, strict=True):
        e = 10 ** (-((q - 3) * (trusted - 3) / 90 + 3) / 10)
        if v.run > 1:
            p *= e
        else:
            p *= e * {"S": ratios[2] / 3, "I": ratios[0] / 4, "D": ratios[1]}[v.kind]
    return min(max(p, 1e-300), 0.99999)


def error_ratios(sums: tuple[int, int, int]) -> tuple[float, float, float]:
    """Shares of the kinds of errors, each sum at least 1."""
    floored = [max(s, 1) for s in sums]
    return tuple(s / sum(floored) for s in floored)
