"""Graphs as tables: components, greedy partitions, greedy assignment, collapse of equivalent candidates.

A greedy partition is made in rounds of joins and aggregates too. Nodes that reach each other are one (`cycles`). Only nodes
that nothing else reaches can come first in the greedy order, as whatever reaches a node reaches all that it reaches; and
what one of them takes is closed, so the others stay what they are. So the choice is a weighted greedy cover: those sources,
and the nodes that each of them reaches (`reached`). A source that ranks first for every node it has left is taken at once
with all others like it, since weights only fall and so none that shares a node with it can come before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from seqloom.operators.lineage import discard, written


def transposed(edges: DataFrame, a: str = "q", b: str = "t") -> DataFrame:
    """Every edge the other way round."""
    return edges.select(*(F.col({a: b, b: a}.get(c, c)).alias(c) for c in edges.columns))


def symmetrised(edges: DataFrame, a: str = "q", b: str = "t", weight: str = "ed") -> DataFrame:
    """Both directions of every edge, at the least weight."""
    both = F.explode(F.array(F.struct(a, b, weight), F.struct(F.col(b).alias(a), F.col(a).alias(b), weight))).alias("e")
    return edges.select(both).select("e.*").groupBy(a, b).agg(F.min(weight).alias(weight))


def united(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` and those rows of `new` whose keys it does not have."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def numbered(nodes: DataFrame) -> DataFrame:
    """`nodes` (`node`, distinct) with `id`, in an order by hashes that has nothing to do with how nodes are linked."""
    keyed = nodes.withColumn("_h", F.xxhash64("node")).repartition("_h").sortWithinPartitions("_h", "node").drop("_h")
    return written(keyed.withColumn("id", F.monotonically_increasing_id()), "numbered")


def _with_ids(edges: DataFrame, ids: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct `x`, `y`: the edges from `a` to `b` by number, without loops. ids: `node`, `id`."""
    of = lambda c, name: ids.select(F.col("node").alias(c), F.col("id").alias(name))
    both = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).join(of("_a", "_x"), "_a").join(of("_b", "_y"), "_b")
    return both.where("_x <> _y").select(F.col("_x").alias("x"), F.col("_y").alias("y")).distinct()


def _until_still(first: DataFrame, step, label: str) -> DataFrame:
    """`step` again and again, each result written, until none of its rows is `moved`."""
    at = written(first, label)
    while True:
        seen = Observation()
        after = written(step(at).observe(seen, F.count_if("moved").alias("n")), label)
        discard(at)
        at = after
        if not seen.get["n"]:
            return at.drop("moved")


def least_reaching(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """`id`, `label`: the least number that reaches it over edges from `x` to `y`, itself included.

    What reaches a node's label reaches the node, so labels jump to their labels' labels.
    """

    def step(labels: DataFrame) -> DataFrame:
        near = edges.join(labels.select(F.col("id").alias("x"), "label"), "x").groupBy(F.col("y").alias("id")).agg(F.min("label").alias("_near"))
        far = labels.select(F.col("id").alias("label"), F.col("label").alias("_far"))
        least = F.least("label", "_near", "_far")
        return labels.join(near, "id", "left").join(far, "label").select("id", least.alias("label"), (least < F.col("label")).alias("moved"))

    return _until_still(ids.select("id", F.col("id").alias("label")), step, "labels")


def components(nodes: DataFrame, edges: DataFrame, node: str = "node", a: str = "q", b: str = "t") -> DataFrame:
    """`node`, `component` (least node of its weakly connected component), by least labels and pointer jumping."""
    ids = numbered(nodes.select(F.col(node).alias("node")).distinct())
    one_way = _with_ids(edges, ids, a, b)
    ways = F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")
    both = written(one_way.select(ways).select("e.*").distinct(), "edges")
    labels = least_reaching(ids, both)
    discard(both)
    named = ids.join(labels, "id")
    return named.join(named.groupBy("label").agg(F.min("node").alias("component")), "label").select(F.col("node").alias(node), "component")


def cycles(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """`id`, `scc` (one of the numbers that reach each other), over edges from `x` to `y`.

    In rounds. A number without edges on one side is alone. Among the others, those of one least number that reaches them are a
    class; of a class, those that reach that number are one, and no others are one with numbers of another class.
    """
    turned = lambda e: e.select(F.col("y").alias("x"), F.col("x").alias("y"))
    found, left = [], ids.select("id")
    while True:
        inner = edges.select(F.col("x").alias("id")).intersect(edges.select(F.col("y").alias("id")))
        active = written(inner, "active")
        found.append(written(left.join(active, "id", "left_anti").select("id", F.col("id").alias("scc")), "single"))
        if not active.limit(1).count():
            return reduce(DataFrame.union, found)
        within = written(edges.join(active.withColumnRenamed("id", "x"), "x", "left_semi").join(active.withColumnRenamed("id", "y"), "y", "left_semi").select("x", "y"), "edges")
        ahead = least_reaching(active, within)
        classes = _with_classes(within, ahead)
        back = least_reaching(active, turned(classes))
        both = written(ahead.join(back.withColumnRenamed("label", "_back"), "id").select("id", "label", (F.col("label") == F.col("_back")).alias("one")), "classes")
        found.append(both.where("one").select("id", F.col("label").alias("scc")))
        left = both.where("not one").select("id")
        rest = classes.join(left.withColumnRenamed("id", "x"), "x", "left_semi").join(left.withColumnRenamed("id", "y"), "y", "left_semi").select("x", "y")
        edges = written(rest, "edges")
        discard(within, classes, ahead, back)


def _with_classes(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges inside one class."""
    of = lambda c, name: labels.select(F.col("id").alias(c), F.col("label").alias(name))
    return written(edges.join(of("x", "_a"), "x").join(of("y", "_b"), "y").where("_a = _b").select("x", "y"), "edges")


def _units(ids: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(`id`, `unit`; `x`, `y`): numbers of a graph without cycles that have one unit before them only join it; edges between units."""
    units = written(ids.select("id", F.col("id").alias("unit")), "units")
    between = written(edges, "edges")
    while True:
        only = between.groupBy(F.col("y").alias("id")).agg(F.count("*").alias("_n"), F.min("x").alias("to")).where("_n = 1").select("id", "to")
        only = written(only, "single")
        if not only.limit(1).count():
            return units, between

        def step(at: DataFrame) -> DataFrame:  # to the parent's parent, until that has none of its own
            return at.join(at.select(F.col("id").alias("to"), F.col("to").alias("_far")), "to", "left").select("id", F.coalesce("_far", "to").alias("to"), F.col("_far").isNotNull().alias("moved"))

        ends = _until_still(only, step, "parents")
        moved = written(units.join(ends.select(F.col("id").alias("unit"), "to"), "unit", "left").select("id", F.coalesce("to", "unit").alias("unit")), "units")
        of = lambda c, name: ends.select(F.col("id").alias(c), F.col("to").alias(name))
        again = between.join(of("x", "_x"), "x", "left").join(of("y", "_y"), "y", "left").select(F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y"))
        again = written(again.where("x <> y").distinct(), "edges")
        discard(units, between, only, ends)
        units, between = moved, again


def reached(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """`source`, `unit`: what each source (`unit`) reaches over edges from `x` to `y`, itself included, step by step."""
    new = written(sources.select(F.col("unit").alias("source"), "unit"), "reached")
    every = [new]
    while new.limit(1).count():
        ahead = new.join(edges, F.col("unit") == F.col("x")).select("source", F.col("y").alias("unit")).distinct()
        new = written(ahead.join(reduce(DataFrame.union, every), ["source", "unit"], "left_anti"), "reached")
        every.append(new)
    return reduce(DataFrame.union, every)


def _parts(pairs: DataFrame, rank) -> DataFrame:
    """`unit`, `source`: again and again the source that ranks first takes all units it has left. pairs: `source`, `unit`, `weight`.

    rank gets what is left of `pairs` and gives `source` and `rank`, least first.
    """
    left, taken = pairs, []
    while left.limit(1).count():
        ranks = rank(left)
        first = left.join(ranks, "source").groupBy("unit").agg(F.min(F.struct("rank", "source")).alias("_f"))
        won = first.groupBy(F.col("_f.source").alias("source")).agg(F.count("*").alias("_won"))
        whole = won.join(left.groupBy("source").agg(F.count("*").alias("_n")), "source").where("_won = _n").select("source")
        picked = written(left.join(whole, "source", "left_semi").select("unit", "source"), "picked")
        taken.append(picked)
        after = written(left.join(picked.select("unit"), "unit", "left_anti"), "pairs")
        discard(left)
        left = after
    return reduce(DataFrame.union, taken) if taken else pairs.select("unit", "source")


def partition(nodes: DataFrame, edges: DataFrame, by_neighbours: bool = True) -> DataFrame:
    """`center`, `member` (the center is its own member), `weight` of the part, `degree` of the member.

    nodes: `node`, `degree` (above 0). edges: `q`, `t`, of nodes to their neighbours; the choice runs on the reverse.
    Again and again the node that reaches the greatest total degree is taken (ties: with by_neighbours more direct neighbours
    left first; then the lesser node); of what it reaches, itself included, the node with the greatest sum of its degree and the
    number of its direct neighbours left becomes the center (ties: the lesser node), all others its members, and all leave.
    """
    ids = numbered(nodes.select("node", F.col("degree").cast("bigint").alias("degree")))
    links = written(_with_ids(edges, ids, "t", "q"), "links")
    scc = written(cycles(ids, links), "scc")
    of = lambda c, name, table=scc, to="scc": table.select(F.col("id").alias(c), F.col(to).alias(name))
    dag = written(links.join(of("x", "_x"), "x").join(of("y", "_y"), "y").where("_x <> _y").select(F.col("_x").alias("x"), F.col("_y").alias("y")).distinct(), "edges")
    units, between = _units(scc.select(F.col("scc").alias("id")).distinct(), dag)
    own = written(ids.join(scc, "id").join(units.withColumnRenamed("id", "scc"), "scc").select("id", "node", "degree", "scc", "unit"), "own")
    weights = own.groupBy("unit").agg(F.sum("degree").alias("weight"))
    sources = own.select("unit").distinct().join(between.select(F.col("y").alias("unit")).distinct(), "unit", "left_anti")
    pairs = written(reached(sources, between).join(weights, "unit").select("source", "unit", "weight"), "pairs")
    # The nodes of a source's own cycle, and where their direct neighbours are.
    heads = own.join(sources, "unit", "left_semi").where("scc = unit").select("id", "node", F.col("unit").alias("source"))
    around = heads.join(links, F.col("id") == F.col("x"), "left").join(own.select(F.col("id").alias("y"), F.col("unit").alias("_to")), "y", "left")
    around = written(around.groupBy("source", "node", F.col("_to").alias("unit")).agg(F.count("y").alias("n")), "around")

    def rank(left: DataFrame) -> DataFrame:
        total = left.groupBy("source").agg(F.sum("weight").alias("_w"))
        if by_neighbours:
            alive = left.select("unit").distinct().withColumn("_left", F.lit(1))
            near = around.join(alive, "unit", "left").groupBy("source", "node").agg(F.sum(F.when(F.col("_left") == 1, F.col("n")).otherwise(0)).alias("_near"))
            first = near.groupBy("source").agg(F.min(F.struct((-F.col("_near")).alias("near"), "node")).alias("_first"))
        else:
            first = around.groupBy("source").agg(F.min(F.struct(F.lit(0).alias("near"), "node")).alias("_first"))
        return total.join(first, "source").select("source", F.struct((-F.col("_w")).alias("w"), "_first").alias("rank"))

    made = written(own.join(_parts(pairs, rank), "unit").select("id", "node", "degree", F.col("source").alias("part")), "parts")
    # A member's neighbours that were left when its part was taken are those of its part.
    of = lambda c, name: made.select(F.col("id").alias(c), F.col("part").alias(name))
    near = links.join(of("x", "_a"), "x").join(of("y", "_b"), "y").where("_a = _b").groupBy(F.col("x").alias("id")).agg(F.count("*").alias("_near"))
    score = F.struct((-F.col("degree") - F.coalesce("_near", F.lit(0))).alias("score"), "node")
    centers = made.join(near, "id", "left").groupBy("part").agg(F.min(score).alias("_c"), F.sum("degree").alias("weight"))
    discard(dag, units, between, around)
    return made.join(centers, "part").select(F.col("_c.node").alias("center"), F.col("node").alias("member"), "weight", "degree")


def greedy_assignment(edges: DataFrame) -> DataFrame:
    """`read`, `candidate`: again and again the candidate with most unassigned reads gets them all (ties: the lesser name).

    edges: `read`, `candidate`. In rounds: a candidate that ranks first for every read it has left is taken together with
    all others like it. Counts only fall, so none that shares a read with it can come before it.
    """
    left = written(edges.select("read", "candidate").dropna().distinct(), "open")
    taken = [left.limit(0)]
    while left.limit(1).count():
        counts = written(left.groupBy("candidate").agg(F.count("*").alias("n")), "counts")
        first = left.join(counts, "candidate").groupBy("read").agg(F.min(F.struct((-F.col("n")).alias("n"), "candidate")).alias("_f"))
        ranked = first.groupBy(F.col("_f.candidate").alias("candidate")).agg(F.count("*").alias("_won")).join(counts, "candidate")
        picked = written(left.join(ranked.where("_won = n").select("candidate"), "candidate", "left_semi").select("read", "candidate"), "picked")
        taken.append(picked)
        left = written(left.join(picked.select("read"), "read", "left_anti"), "open")
    return reduce(DataFrame.union, taken)


def unassigned(reads: DataFrame, assignment: DataFrame) -> DataFrame:
    """`reads` (`acc`) that `assignment` (`read`) gives to no candidate."""
    return reads.join(assignment.select(F.col("read").alias("acc")), "acc", "left_anti")


def with_reads(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """`candidates` (`acc`) that some read is left for. counts: `acc`, `n`."""
    return candidates.join(counts.where("n > 0").select("acc"), "acc", "left_semi")


def collapsed(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """`acc`, `survivor`: candidates that are equivalent but for their ends, by greedy partition.

    candidates: `acc`, `support`. pairs: `a`, `b`, counted in both directions.
    """
    both = pairs.select(F.col("a").alias("q"), F.col("b").alias("t")).union(pairs.select(F.col("b").alias("q"), F.col("a").alias("t"))).distinct()
    parts = partition(candidates.select(F.col("acc").alias("node"), F.col("support").alias("degree")), both, by_neighbours=False)
    return parts.select(F.col("member").alias("acc"), F.col("center").alias("survivor"))
