"""Column functions on sequences, qualities and gapped alignments; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nucleotide codes and their complements.
COMPLEMENT_FROM = "ACGTUNRYSWKMBDHVXacgtunryswkmbdhvx"
COMPLEMENT_TO = "TGCAANYRSWMKVHDBXtgcaanyrswmkvhdbx"
# A trusted quality of 43 and the offset and range of quality characters.
PHRED_OFFSET, PHRED_MAX, TRUSTED_PHRED = 33, 93, 43


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_sequence(text: Column | str) -> Column:
    """Letters a to z and digits of a text as nucleotides; everything else goes."""
    kept = F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]", "")
    return F.translate(kept, "abcdefghijklmnopqrstuvwxyz0123456789", "ACGTACGTACGTACGTACGTACGTACGTACGTACGT")


def homopolymer_compressed(seq: Column | str) -> Column:
    """Runs of one character as one."""
    return F.regexp_replace(_c(seq), r"(.)\1+", "$1")


def reverse_complement(seq: Column | str) -> Column:
    """Complement of each nucleotide code, case kept, back to front; other characters are an error."""
    s = _c(seq)
    done = F.reverse(F.translate(s, COMPLEMENT_FROM, COMPLEMENT_TO))
    return F.when(s.rlike(f"[^{COMPLEMENT_FROM}]"), F.raise_error(F.lit("not a nucleotide code"))).otherwise(done)


def degapped(alignment: Column | str) -> Column:
    """An alignment's row without gaps."""
    return F.replace(_c(alignment), F.lit("-"), F.lit(""))


def phred_values(quality: Column | str) -> Column:
    """Quality string to integers; a value out of range is an error."""
    values = F.transform(F.filter(F.split(_c(quality), ""), lambda c: c != ""), lambda c: F.ascii(c) - PHRED_OFFSET)
    bad = F.exists(values, lambda v: (v < 0) | (v > PHRED_MAX))
    return F.when(bad, F.raise_error(F.lit("a quality is out of range"))).otherwise(values)


def error_probability(phred: Column | str) -> Column:
    """10^(-q/10)."""
    return F.pow(F.lit(10.0), -_c(phred) / 10)


def phred_of(probability: Column | str) -> Column:
    """-10 log10 p."""
    return -10 * F.log10(_c(probability))


def trusted_phred(phred: Column | str, most: float = TRUSTED_PHRED) -> Column:
    """Qualities 3 to 93 mapped linearly to 3 to `most`."""
    return (_c(phred) - 3) * (most - 3) / 90 + 3


def runs(seq: Column | str) -> Column:
    """The runs of equal characters, in their order."""
    return F.filter(F.split(_c(seq), r"(?s)(?<=(.))(?!\1)"), lambda r: r != "")


def run_ids(seq: Column | str) -> Column:
    """For each position the number of the run of equal characters that it stands in, from 0."""
    return F.flatten(F.transform(runs(seq), lambda r, i: F.array_repeat(i, F.length(r))))


def sorted_within_runs(seq: Column | str, phred: Column | str) -> Column:
    """Qualities in ascending order inside each run of equal characters."""
    pairs = F.arrays_zip(run_ids(seq).alias("r"), _c(phred).alias("q"))
    return F.transform(F.array_sort(pairs), lambda p: p["q"])


def read_key(acc: Column | str) -> Column:
    """What a read's accession shares with its quality record: its first two parts, of what stands before a space."""
    return F.substring_index(F.substring_index(_c(acc), " ", 1), "/", 2)


def consensus_coordinate(read: Column | str, full: Column | str, at: Column | str) -> Column:
    """Where the read's base `at` (from 0) stands in the consensus read that holds it; the end counts as its last base; null elsewhere."""
    whole = _c(full)
    begin = F.instr(whole, F.replace(_c(read), F.lit("-"), F.lit("")))
    place = begin - 1 + _c(at)
    return F.when((begin > 0) & (place <= F.length(whole)), F.least(place, F.length(whole) - 1))


def support_of(acc: Column | str) -> Column:
    """The support that a candidate's name carries; null without one."""
    found = F.regexp_extract(_c(acc), r"support_(\d+)", 1)
    return F.when(found != "", found.cast("int"))


def mask_start(a: Column | str, b: Column | str) -> Column:
    """Length of the run of gaps that one side of an alignment begins with."""
    return F.greatest(F.length(F.regexp_extract(_c(a), "^-*", 0)), F.length(F.regexp_extract(_c(b), "^-*", 0)))


def mask_end(a: Column | str, b: Column | str) -> Column:
    """Where the run of gaps that one side ends with begins; the length if there is none."""
    return F.length(_c(a)) - F.greatest(F.length(F.regexp_extract(_c(a), "-*$", 0)), F.length(F.regexp_extract(_c(b), "-*$", 0)))


def differs_by_exon(a: Column | str, b: Column | str, least: int = 20, ends: int = 15) -> Column:
    """Whether a side has `least` gaps in a row in the interior; up to `ends` columns at either end are forgiven."""
    a, b = _c(a), _c(b)
    start = F.least(F.lit(ends), mask_start(a, b))
    end = F.greatest(F.length(a) - ends, mask_end(a, b))
    inner = lambda s: F.substring(s, start + 1, F.greatest(end - start, F.lit(0)))
    return inner(a).rlike(f"-{{{least},}}") | inner(b).rlike(f"-{{{least},}}")


def _offset_in(a: Column, b: Column) -> Column:
    return F.instr(a, b) - 1


def overlaps_at_ends(a: Column | str, b: Column | str, ends: int) -> Column:
    """Whether a suffix of one is a prefix of the other and both overhangs are at most `ends`."""
    a, b = _c(a), _c(b)
    longest = F.greatest(F.length(a), F.length(b))
    lengths = F.sequence(F.greatest(longest - ends, F.lit(1)), F.greatest(longest, F.lit(1)))
    fits = lambda n: (n <= F.least(F.length(a), F.length(b))) & ((F.right(a, n) == F.left(b, n)) | (F.right(b, n) == F.left(a, n)))
    return F.exists(lengths, fits)


def equivalent_but_ends(a: Column | str, b: Column | str, ends: int) -> Column:
    """Whether b, no longer than a, is a but for at most `ends` characters at either end."""
    a, b = _c(a), _c(b)
    at = _offset_in(a, b)
    inside = (at >= 0) & (at <= ends) & (F.length(a) - at - F.length(b) <= ends)
    sizes = (F.length(b) <= F.length(a)) & (F.length(b) >= F.length(a) - 2 * ends)
    return sizes & (inside | overlaps_at_ends(a, b, ends))


def ln_choose(n: Column, k: Column) -> Column:
    """ln of the binomial coefficient; null where it is 0."""
    terms = F.when(k > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1)).cast("bigint")), lambda i: F.log((n - k + i) / i))).otherwise(F.array().cast("array<double>"))
    return F.when((k >= 0) & (k <= n), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))
