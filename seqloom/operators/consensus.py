"""Consensus correction over position-wise profiles.

`profile`, `majorities`, `error_counts` and `to_replace` work on any long table of
`center`, `member`, `col`, `char`, `degree`. `corrected` does the same for a
partition's aligned members without a row for each character: a center's profile is
an array of counters, counted by several tasks where it has many members, and merged.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import alignment as A
from seqloom.functions import profiles as P
from seqloom.operators.lineage import discard, written

#: Members of one center that one task counts or corrects, about.
MEMBERS = 2000


def positions(members: DataFrame) -> DataFrame:
    """`center`, `member`, `degree`, `col`, `char` of `center`, `member`, `degree`, `columns`."""
    return members.select("center", "member", "degree", F.posexplode("columns").alias("col", "char"))


def profile(long: DataFrame) -> DataFrame:
    """`center`, `col`, `char`, `n`: summed degrees."""
    return long.groupBy("center", "col", "char").agg(F.sum("degree").alias("n"))


def majorities(profiles: DataFrame) -> DataFrame:
    """`center`, `col`, `top`, `ambiguous`: the most frequent character; several make a column ambiguous."""
    best = profiles.groupBy("center", "col").agg(F.max("n").alias("_n"))
    return profiles.join(best, ["center", "col"]).where("n = _n").groupBy("center", "col").agg(F.min("char").alias("top"), (F.count("*") > 1).alias("ambiguous"))


def error_counts(profiles: DataFrame, tops: DataFrame) -> DataFrame:
    """`center`, `c_ins`, `c_del`, `c_subs` over unambiguous columns."""
    minor = profiles.join(tops.where("not ambiguous"), ["center", "col"]).where("char <> top")
    kind = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    gap, own = F.col("top") == "-", F.col("char") == "-"
    return minor.groupBy("center").agg(kind(gap).alias("c_ins"), kind(~gap & own).alias("c_del"), kind(~gap & ~own).alias("c_subs"))


def to_replace(long: DataFrame, profiles: DataFrame, tops: DataFrame, errors: DataFrame) -> DataFrame:
    """`center`, `member`, `col`, `top`, `frequency` of the less frequent half of a member's minority columns, with ties.

    Members with a degree over 1 are never changed.
    """
    minor = long.where("degree <= 1").join(tops.where("not ambiguous"), ["center", "col"]).where("char <> top")
    minor = minor.join(profiles, ["center", "col", "char"]).join(errors, "center")
    kind = F.when(F.col("top") == "-", F.col("c_ins")).when(F.col("char") == "-", F.col("c_del")).otherwise(F.col("c_subs"))
    mine = W.partitionBy("center", "member")
    ranked = minor.withColumn("frequency", F.col("n") / F.greatest(kind, F.lit(1))).withColumn("_rank", F.rank().over(mine.orderBy("frequency"))).withColumn("_n", F.count("*").over(mine))
    return ranked.where(F.col("_rank") <= F.ceil(F.col("_n") * 0.5)).select("center", "member", "col", "top", "frequency")


def aligned(partitions: DataFrame, ed: DataFrame | None = None) -> DataFrame:
    """`center`, `member`, `degree`, `ed`, `aln_c`, `aln_m` of partitions (`center`, `member`, `degree`)."""
    measured = partitions.withColumn("ed", F.levenshtein("center", "member"))
    rate = F.col("ed") / F.least(F.length("center"), F.length("member"))
    mismatch = F.when(rate <= 0.01, -1).when(rate <= 0.09, -2).otherwise(-4)
    return A.with_alignment(measured.withColumn("_mismatch", mismatch), "center", "member", "_mismatch", opening=2, extending=0).drop("_mismatch").withColumnsRenamed({"aln_a": "aln_c", "aln_b": "aln_m"})


def _batches(rows: list[tuple], schema: pa.Schema):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _widest(pairs: DataFrame) -> DataFrame:
    """`center`, `widest`: of each slot of a center in which some member has more than one character, the longest (the lesser, of several)."""
    schema = pa.schema([("center", pa.string()), ("slot", pa.int32()), ("s", pa.string())])

    def run(batches):
        for batch in batches:
            best: dict[tuple[str, int], str] = {}
            for center, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for slot, s in P.insertions(b, a):
                    best[center, slot] = min(best.get((center, slot), s), s, key=lambda x: (-len(x), x))
            yield from _batches([(*k, s) for k, s in best.items()], schema)

    found = pairs.select("center", "aln_c", "aln_m").mapInArrow(run, "center string, slot int, s string")
    longest = found.groupBy("center", "slot").agg(F.min(F.struct((-F.length("s")).alias("n"), "s")).alias("_w"))
    return longest.groupBy("center").agg(F.collect_list(F.struct("slot", F.col("_w.s").alias("s"))).alias("widest"))  # as many as the center has slots


def _by_center(pairs: DataFrame, centers: DataFrame, make, schema: str) -> DataFrame:
    """`make(rows of a center's members, its widest slots, its profile)` in Arrow, after each center's row has come in front of its members.

    Members of one center are dealt in shares of about `MEMBERS`, and its row goes to each. pairs: with `ways`, the number of shares.
    centers: `center`, `widest`, `characters`, `counts`, `ways`. A share's members come in parts, if they are more than an Arrow batch.
    """
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    first = centers.select("center", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ways") - 1)).alias("share"), F.lit(0).alias("kind"), none("string", "member"), none("bigint", "degree"), none("string", "aln_c"), none("string", "aln_m"), "widest", "characters", "counts")
    dealt = pairs.select("center", F.pmod(F.xxhash64("member"), F.col("ways")).alias("share"), F.lit(1).alias("kind"), "member", F.col("degree").cast("bigint").alias("degree"), "aln_c", "aln_m", *(F.lit(None).cast(centers.schema[c].dataType).alias(c) for c in ("widest", "characters", "counts")))
    stream = first.unionByName(dealt).repartition("center", "share").sortWithinPartitions("center", "share", "kind")
    out = pa.schema([(c.split()[0], {"string": pa.string(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}[c.split()[1]]) for c in schema.split(", ")])

    def run(batches):
        head, widest, profile, at, rows = None, {}, None, None, []
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if rows:
                        done += make(at, rows, widest, profile)
                    at, rows = row["center"], []
                    if head != row["center"] or profile is None:
                        head, widest = row["center"], {x["slot"]: x["s"] for x in row["widest"] or ()}
                        profile = P.Profile.unpacked(row["characters"], row["counts"]) if row["counts"] is not None else None
                        if profile is not None:
                            profile.settle()
                else:
                    rows.append(row)
            if rows:
                done += make(at, rows, widest, profile)
                rows = []
            yield from _batches(done, out)

    return stream.mapInArrow(run, schema)


def _counted(center: str, rows: list[dict], widest: dict[int, str], profile: None) -> list[tuple]:
    made, known = P.Profile(), {}
    for r in rows:
        made.add(P.in_columns(r["aln_m"], r["aln_c"], widest, known), r["degree"])
    return [(center, *made.packed())]


def _fixed(center: str, rows: list[dict], widest: dict[int, str], profile: P.Profile) -> list[tuple]:
    known: dict = {}
    return [(r["member"], profile.corrected(P.in_columns(r["aln_m"], r["aln_c"], widest, known), r["degree"])) for r in rows]


def _merged(parts: DataFrame) -> DataFrame:
    """`center`, `characters`, `counts`: the sum of each center's profiles, read one after the other."""
    schema = pa.schema([("center", pa.string()), ("characters", pa.list_(pa.int32())), ("counts", pa.binary())])

    def run(batches):
        center, total = None, None
        for batch in batches:
            done = []
            for name, characters, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != center:
                    if total is not None:
                        done.append((center, *total.packed()))
                    center, total = name, P.Profile()
                total.merge(P.Profile.unpacked(characters, counts))
            yield from _batches(done, schema)
        if total is not None:
            yield from _batches([(center, *total.packed())], schema)

    return parts.repartition("center").sortWithinPartitions("center").mapInArrow(run, "center string, characters array<int>, counts binary")


def corrected(pairs: DataFrame) -> DataFrame:
    """`member`, `seq` (corrected) for the members of partitions in which there is something to correct.

    pairs: `center`, `member`, `degree`, `aln_c`, `aln_m`, the center with itself included.
    """
    members, reads = F.count("*").alias("_members"), F.sum("degree").alias("_reads")
    busy = pairs.groupBy("center").agg(members, reads).where("_members > 1 and _reads > 2").select("center", F.ceil(F.col("_members") / MEMBERS).alias("ways"))
    inside = written(pairs.join(busy, "center").select("center", "member", "degree", "aln_c", "aln_m", "ways"), "members")
    centers = written(busy.join(_widest(inside), "center", "left"), "centers")
    none = centers.withColumn("characters", F.lit(None).cast("array<int>")).withColumn("counts", F.lit(None).cast("binary"))
    parts = _by_center(inside, none, _counted, "center string, characters array<int>, counts binary")
    profiled = written(centers.join(_merged(parts), "center"), "profiles")
    discard(centers)
    return _by_center(inside, profiled, _fixed, "member string, seq string")
