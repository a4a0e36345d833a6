"""The three verbs: candidates from reads, statistical filter of candidates, and both in turn.

Every step is one plan over all sequences; a step ends in a written table, and only
counts of distances, a threshold and a flag come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import alignment as A
from seqloom.functions import sequences as S
from seqloom.functions import variants as V
from seqloom.operators import consensus, graph, neighbors, significance
from seqloom.operators.lineage import written
from seqloom.operators.records import cluster_table as cluster_table
from seqloom.operators.records import final_records as final_records
from seqloom.operators.records import named


@dataclass(frozen=True)
class Parameters:
    """Options of the verbs."""

    neighbor_search_depth: int | None = None
    min_exon_diff: int = 20
    min_candidate_support: int = 2
    p_value_threshold: float = 0.01
    min_test_ratio: int = 5
    ignore_ends_len: int = 15
    max_phred_q_trusted: float = V.TRUSTED
    most_steps: int | None = None  # an error where a loop needs more; None: until it converges

    def check(self, steps: int) -> None:
        if self.most_steps is not None and steps >= self.most_steps:
            raise RuntimeError(f"not converged after {steps} steps")


#: Called after each step with its name and table, for outputs of every step.
OnStep = Callable[[str, DataFrame], None]


@dataclass(frozen=True)
class Candidates:
    """`candidates` (`acc`, `seq`, `support`), `assignment` (`read`, `candidate`) and `unassigned` (`acc`, `seq`)."""

    candidates: DataFrame
    assignment: DataFrame
    unassigned: DataFrame


def _members(nodes: DataFrame, edges: DataFrame, params: Parameters) -> DataFrame:
    """Aligned partitions without the members that differ by an exon, and `dropped` for those."""
    parts = graph.partition(nodes.select(F.col("seq").alias("node"), "degree"), edges)
    parts = parts.select("center", "member", F.when(F.col("center") == F.col("member"), F.col("degree")).otherwise(1).alias("degree"))
    pairs = consensus.aligned(parts)
    dropped = (F.col("center") != F.col("member")) & S.differs_by_exon("aln_c", "aln_m", params.min_exon_diff, params.ignore_ends_len)
    return written(pairs.withColumn("dropped", dropped), "partition")


def get_candidates(reads: DataFrame, params: Parameters = Parameters(), on_step: OnStep | None = None) -> Candidates:
    """Correct reads (`acc`, `seq`) to the consensus of their neighbourhood until nothing changes.

    on_step gets `candidates_step_<n>`, the centers of each step (`acc`, `seq`).
    """
    reads = written(reads.select("acc", "seq").where("seq <> ''"), "reads")
    current, history = reads, []
    while True:
        nodes = written(neighbors.distinct_sequences(current), "nodes")
        converged = not nodes.where("degree = 1").limit(1).count()
        edges = written(neighbors.neighbour_graph(current, params.neighbor_search_depth), "graph")
        pairs = _members(nodes, edges, params)
        kept = pairs.where("not dropped")
        distances = {r[0]: r[1] for r in kept.groupBy("ed").count().collect()}  # a row for each distance
        total, most = sum(e * n for e, n in distances.items()), max(distances, default=0)
        history.append((distances, total, most))
        if on_step:
            on_step(f"candidates_step_{len(history)}", named(pairs.where("center = member").select(F.col("center").alias("seq"), "degree")).select("acc", "seq"))
        stuck = len(history) > 2 and distances == history[-3][0]
        worse = len(history) > 1 and total > history[-2][1] and most > history[-2][2]
        if converged or stuck or worse or total == 0:
            break
        params.check(len(history))
        fixed = consensus.corrected(kept).select(F.col("member").alias("seq"), F.col("seq").alias("_new"))
        excluded = pairs.where("dropped").select(F.col("member").alias("seq")).distinct()
        moved = current.join(excluded, "seq", "left_anti").join(fixed, "seq", "left")
        current = written(moved.select("acc", F.coalesce("_new", "seq").alias("seq")), "corrected")
    centers = pairs.where("center = member").select(F.col("center").alias("seq"), F.col("degree"))
    candidates = written(named(centers.where("seq <> ''")), "candidates")
    owner = kept.select(F.col("member").alias("seq"), F.col("center"))
    assigned = current.join(owner, "seq").join(candidates.select(F.col("seq").alias("center"), F.col("acc").alias("candidate")), "center").select(F.col("acc").alias("read"), "candidate")
    merged = graph.collapsed(candidates.select("acc", F.col("degree").alias("support")), neighbors.equivalent_pairs(candidates.select("acc", "seq"), params.ignore_ends_len))
    merged = written(merged, "merged")
    survivors = candidates.join(merged.select(F.col("survivor").alias("acc")).distinct(), "acc", "left_semi").where(F.col("degree") >= params.min_candidate_support)
    survivors = written(survivors.select("acc", "seq", F.col("degree").alias("support")), "survivors")
    assignment = assigned.join(merged, F.col("candidate") == F.col("acc")).select("read", F.col("survivor").alias("candidate")).join(survivors.select(F.col("acc").alias("candidate")), "candidate", "left_semi")
    assignment = written(assignment.select("read", "candidate"), "assignment")
    return Candidates(survivors, assignment, graph.unassigned(reads, assignment))


def assign(reads: DataFrame, candidates: DataFrame, depth: int | None = None) -> DataFrame:
    """`read`, `candidate`: nearest candidates (of `depth` next to the read by length), and among those the greedy choice."""
    distinct, known = reads.select("seq").distinct(), candidates.select("seq").distinct()
    near = neighbors.nearest(distinct, known, self_join=False) if depth is None else neighbors.nearest_by_length(distinct, known, depth)
    targets = candidates.select(F.col("seq").alias("t"), F.col("acc").alias("candidate"))
    edges = reads.select(F.col("acc").alias("read"), F.col("seq").alias("q")).join(near.select("q", "t"), "q").join(targets, "t")
    return graph.greedy_assignment(edges.select("read", "candidate"))


def read_alignments(assignment: DataFrame, reads: DataFrame, candidates: DataFrame, params: Parameters) -> DataFrame:
    """`read`, `candidate`, `aln_c`, `aln_r` of assigned reads that don't differ by an exon."""
    phred = F.col("phred") if "phred" in reads.columns else F.lit(None).cast("array<int>")
    rows = assignment.join(reads.select(F.col("acc").alias("read"), F.col("seq").alias("_r"), phred.alias("phred")), "read").join(candidates.select(F.col("acc").alias("candidate"), F.col("seq").alias("_c")), "candidate")
    rate = F.levenshtein("_c", "_r") / F.least(F.length("_c"), F.length("_r"))
    rows = rows.withColumn("_m", F.when(rate <= 0.01, -1).when(rate <= 0.09, -2).otherwise(-4))
    pairs = A.with_alignment(rows, "_c", "_r", "_m", opening=2, extending=0)
    pairs = pairs.where(~S.differs_by_exon("aln_a", "aln_b", params.min_exon_diff, params.ignore_ends_len))
    return pairs.select("read", "candidate", F.col("aln_a").alias("aln_c"), F.col("aln_b").alias("aln_r"), "phred")


def error_shares(aligned: DataFrame) -> tuple[float, float, float]:
    """Shares of insertions, deletions and substitutions among all errors of all reads."""

    @F.pandas_udf("ins bigint, dels bigint, subs bigint")
    def errors(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([V.error_counts(x, y) for x, y in zip(a, b, strict=True)], columns=["ins", "dels", "subs"])

    sums = aligned.select(errors("aln_c", "aln_r").alias("e")).agg(*(F.coalesce(F.sum(f"e.{c}"), F.lit(0)) for c in ("ins", "dels", "subs"))).first()
    return V.error_ratios(tuple(sums))


@lru_cache(maxsize=4096)
def edge_variants(cand: str, ref: str) -> tuple[V.Variant, ...]:
    """Variants of an edge; of the alignments in either order the one with fewer, the first on ties."""
    one_t, one_c, _ = A.semi_global(ref, cand, 2, -3, 3, 1)
    two_c, two_t, _ = A.semi_global(cand, ref, 2, -3, 3, 1)
    one, two = V.variants(one_t, one_c), V.variants(two_t, two_c)
    return tuple(one if len(one) <= len(two) else two)


def edge_tests(edges: DataFrame, candidates: DataFrame, aligned: DataFrame, trusted: float = V.TRUSTED) -> DataFrame:
    """`candidate`, `reference`, `k`, `n_t`, `n_variants`, `ln_p`, `p_value`, `ln_factor`, `corrected` of each edge.

    A read with qualities (`phred`) has its chance from those at the variants, another one from its own count of errors.
    """
    shares = error_shares(aligned) if aligned.where("phred is not null").limit(1).count() else (1.0, 1.0, 1.0)
    seqs = candidates.select("acc", "seq")
    full = edges.join(seqs.withColumnsRenamed({"acc": "candidate", "seq": "_c"}), "candidate").join(seqs.withColumnsRenamed({"acc": "reference", "seq": "_t"}), "reference")
    reads = aligned.select(F.col("candidate").alias("_owner"), "aln_c", "aln_r", "phred")
    mine = full.join(reads, F.col("candidate") == F.col("_owner")).withColumn("_own", F.lit(True))
    theirs = full.join(reads, F.col("reference") == F.col("_owner")).withColumn("_own", F.lit(False))

    @F.pandas_udf("supports boolean, p double, n_variants int, ins int, dels int, subs int")
    def trial(c: pd.Series, t: pd.Series, own: pd.Series, template: pd.Series, read: pd.Series, phred: pd.Series) -> pd.DataFrame:
        rows = []
        for cand, ref, o, a, r, q in zip(c, t, own, template, read, phred, strict=True):
            found = list(edge_variants(cand, ref))
            kinds = [v.kind for v in found]
            if not found:
                p = 0.5
            elif q is not None and len(q):
                p = V.chance_by_quality(found, V.qualities_at(a, r, q, [v.c if o else v.t for v in found]), shares, trusted)
            else:
                p = V.chance(found, V.error_counts(a, r), len(ref))
            rows.append((V.supports(a, r, found, bool(o)), p, len(found), kinds.count("I"), kinds.count("D"), kinds.count("S")))
        return pd.DataFrame(rows, columns=["supports", "p", "n_variants", "ins", "dels", "subs"])

    trials = mine.unionByName(theirs).select("candidate", "reference", F.length("_t").alias("_len"), trial("_c", "_t", "_own", "aln_c", "aln_r", "phred").alias("_x")).select("candidate", "reference", "_len", "_x.*")
    key = ["candidate", "reference", "_len", "n_variants", "ins", "dels", "subs"]
    bound = significance.tail_bounds(trials, key)
    factor = significance.ln_factor(F.col("_len").cast("bigint"), F.col("ins"), F.col("dels"), F.col("subs"))
    none = F.col("n_variants") == 0
    tested = bound.withColumn("ln_factor", factor).withColumn("corrected", F.when(none, 0.0).otherwise(significance.corrected(F.col("ln_p"), F.col("ln_factor"))))
    tested = tested.withColumn("p_value", F.when(none, 0.0).otherwise(F.col("p_value")))
    left = edges.select("candidate", "reference").join(tested.select("candidate", "reference"), ["candidate", "reference"], "left_anti")
    untested = left.select("candidate", "reference", F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("n_t"), F.lit(0).alias("n_variants"), F.lit(0.0).alias("ln_p"), F.lit(1.0).alias("p_value"), F.lit(0.0).alias("ln_factor"), F.lit(1.0).alias("corrected"))
    return tested.select(untested.columns).unionByName(untested)


def members_of(aligned: DataFrame) -> DataFrame:
    """`acc`, `members`: which reads a candidate has, as a number and two sums of hashes."""
    sums = [F.sum(F.shiftrightunsigned(F.xxhash64("read", F.lit(seed)), 28)) for seed in (1, 2)]  # 36 bits, so that sums fit
    return aligned.groupBy(F.col("candidate").alias("acc")).agg(F.struct(F.count("*").alias("n"), sums[0].alias("a"), sums[1].alias("b")).alias("members"))


def tested_anew(pairs: DataFrame, members: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Pairs with `c_members`, `t_members` that have to be tested, and the results of tests whose reads have not changed."""
    for side, name in (("candidate", "c_members"), ("reference", "t_members")):
        pairs = pairs.join(members.select(F.col("acc").alias(side), F.col("members").alias(name)), side, "left")
    if before is None:
        return pairs, None
    key = ["candidate", "reference", "c_members", "t_members"]
    same = before.join(pairs.select(*key), key, "left_semi")
    return pairs.join(before.select(*key), key, "left_anti"), same


def p_value_labels(tests: DataFrame) -> DataFrame:
    """`label` (accession, k, corrected p-value, reads tested, variants) and `p_value` of tests."""
    fields = ("candidate", "k", F.least(F.lit(1.0), F.col("corrected")), "n_t", "n_variants")
    return tests.select(F.concat_ws("_", *((F.col(f) if isinstance(f, str) else f).cast("string") for f in fields)).alias("label"), "p_value")


def stat_filter(reads: DataFrame, candidates: DataFrame, params: Parameters = Parameters(), assignment: DataFrame | None = None, on_step: OnStep | None = None) -> tuple[DataFrame, DataFrame]:
    """Drop candidates that errors explain, until none is left to drop.

    reads: `acc`, `seq` and, if qualities count, `phred`. candidates: `acc`, `seq`, `support`. on_step gets
    `preprocessed_candidates`, and of each step `p_values_<n>`, `candidates_after_step_<n>` and `remaining_to_align`. Returns the final candidates (`acc`, `seq`, `n`, `p_value`, `corrected`, `n_t`,
    `n_variants`) and the assignment (`read`, `candidate`).
    """
    reads = written(reads.select("acc", "seq", *(["phred"] if "phred" in reads.columns else [])).where("seq <> ''"), "reads")
    alive = written(candidates.select("acc", "seq", "support").where(F.col("support").isNull() | (F.col("support") >= params.min_candidate_support)).dropDuplicates(["seq"]), "alive")
    static = written(neighbors.close_but_ends(alive.select("acc", "seq"), params.ignore_ends_len), "static")
    homopolymer = written(neighbors.homopolymer_pairs(alive).select(F.col("a").alias("q"), F.col("b").alias("t"), F.lit(1).alias("ed")), "homopolymer")
    if on_step:
        on_step("preprocessed_candidates", alive.select("acc", "seq"))
    state, results = 0, None
    empty = reads.sparkSession.createDataFrame([], "read string, candidate string")
    assignment = written(assignment if assignment is not None else empty, "assigned")
    steps = 0
    while True:
        if state == 1:
            assignment = written(empty, "assigned")
        open_ = graph.unassigned(reads, assignment)
        fresh = assign(open_, alive, params.neighbor_search_depth)
        assignment = written(assignment.unionByName(fresh), "assigned")
        aligned = written(read_alignments(assignment, reads, alive, params), "aligned")
        counts = written(aligned.groupBy(F.col("candidate").alias("acc")).agg(F.count("*").alias("n")), "counts")
        alive = written(graph.with_reads(alive, counts), "alive")
        edges = neighbors.survivors_nearest(static, alive.select("acc"))
        if state > 0:
            left = neighbors.survivors_nearest(homopolymer, alive.select("acc"))
            edges = graph.united(edges, left, ["q", "t"])
        pairs = edges.select(F.col("q").alias("candidate"), F.col("t").alias("reference"))
        pairs = significance.not_dominated(pairs, counts, params.min_test_ratio).select("candidate", "reference")
        fresh_pairs, same = tested_anew(pairs, members_of(aligned), results)
        fresh_pairs = written(fresh_pairs, "untested")
        tested = edge_tests(fresh_pairs.select("candidate", "reference"), alive, aligned, params.max_phred_q_trusted).join(fresh_pairs, ["candidate", "reference"])
        results = written(tested if same is None else tested.unionByName(same), "tests")
        worst = written(significance.worst_edges(results), "worst")
        limit = significance.threshold(worst.where("n_t > 0"), params.p_value_threshold).first()[0]
        drop = worst.where((F.col("n_t") > 0) & ((F.col("k") == 0) | (F.col("corrected") >= limit)))
        drop = drop.where((F.col("corrected") >= params.p_value_threshold) | (F.col("k") == 0)).select(F.col("candidate").alias("acc"))
        dropped = drop.limit(1).count() > 0
        alive = written(alive.join(drop, "acc", "left_anti"), "alive")
        assignment = written(assignment.join(alive.select(F.col("acc").alias("candidate")), "candidate", "left_semi").select("read", "candidate"), "assigned")
        if on_step:
            on_step(f"p_values_{steps}", p_value_labels(significance.worst_edges(results)))
            on_step(f"candidates_after_step_{steps}", alive.select("acc", "seq"))
            on_step("remaining_to_align", graph.unassigned(reads, assignment).select("acc", "seq"))
        if state == 1:
            state = 2
        elif state == 0 and not dropped:
            state, dropped = 1, True
        if not dropped or not alive.limit(1).count():
            break
        steps += 1
        params.check(steps)
    merged = written(graph.collapsed(alive.select("acc", F.coalesce("support", F.lit(1)).cast("bigint").alias("support")), neighbors.equivalent_pairs(alive.select("acc", "seq"), params.ignore_ends_len)), "merged")
    final = assignment.join(merged, F.col("candidate") == F.col("acc")).select("read", F.col("survivor").alias("candidate"))
    final = written(final, "final")
    counts = final.groupBy(F.col("candidate").alias("acc")).agg(F.count("*").alias("n"))
    tested = significance.worst_edges(results).select(F.col("candidate").alias("acc"), "p_value", "corrected", "n_t", "n_variants")
    out = alive.join(merged.select(F.col("survivor").alias("acc")).distinct(), "acc", "left_semi").join(counts, "acc").join(tested, "acc", "left")
    return out.select("acc", "seq", "n", "p_value", "corrected", "n_t", "n_variants"), final


def pipeline(reads: DataFrame, params: Parameters = Parameters(), on_step: OnStep | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates from reads, filtered."""
    found = get_candidates(reads, params, on_step)
    return stat_filter(reads, found.candidates, params, found.assignment, on_step)
