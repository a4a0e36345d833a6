"""Statistics of candidate tests: tail bound, multiple-testing factor, worst edge, threshold. All in log space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import sequences as S

#: ln of the largest double: a factor beyond it makes a corrected p-value of 1.
LN_MAX = 709.78


def ln_tail_bound(m: Column, y: Column) -> Column:
    """ln of the bound on a weighted sum of Bernoulli variables with mean m reaching y."""
    general = y - m - y * F.log(y / m)
    return F.when(y == 0, 0.0).when(y == m, F.log(F.lit(0.5))).otherwise(general)


def tail_bounds(trials: DataFrame, group: list[str]) -> DataFrame:
    """trials: `p`, `supports` (boolean) -> groups with `k`, `n_t`, `m`, `y`, `ln_p`, `p_value`.

    A trial's weight is ln p over the least ln p of its group, so the rarest error weighs 1.
    """
    least = trials.groupBy(*group).agg(F.min(F.log("p")).alias("_least"), F.count("*").alias("n_t"), F.sum(F.col("supports").cast("bigint")).alias("k"), F.sum(F.log("p") * F.col("p")).alias("_wp"), F.sum(F.when(F.col("supports"), F.log("p")).otherwise(0.0)).alias("_wy"))
    m, y = F.col("_wp") / F.col("_least"), F.col("_wy") / F.col("_least")
    bound = ln_tail_bound(F.col("m"), F.col("y"))
    return least.select(*group, "k", "n_t", m.alias("m"), y.alias("y")).withColumn("ln_p", bound).withColumn("p_value", F.exp("ln_p"))


def ln_factor(length: Column, insertions: Column, deletions: Column, substitutions: Column) -> Column:
    """ln of the number of ways to choose the variants; null where there is none."""
    return insertions * F.log(4.0 * (length + 1)) + S.ln_choose(length, deletions) + S.ln_choose(3 * (length - deletions), substitutions)


def corrected(ln_p: Column, factor: Column) -> Column:
    """p-value times factor; 1 beyond the largest double, 0 without a factor."""
    return F.when(factor.isNull(), 0.0).when(factor > LN_MAX, 1.0).otherwise(F.exp(ln_p + factor))


def worst_edges(tests: DataFrame) -> DataFrame:
    """Of each candidate the test with the greatest corrected p-value; ties go to the greater reference."""
    order = W.partitionBy("candidate").orderBy(F.desc("corrected"), F.desc("reference"))
    return tests.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def threshold(worst: DataFrame, floor: float = 0.01) -> DataFrame:
    """One row: the median of `corrected`, or `floor` if that is greater."""
    return worst.agg(F.greatest(F.coalesce(F.percentile("corrected", 0.5), F.lit(0.0)), F.lit(floor)).alias("threshold"))


def not_dominated(edges: DataFrame, counts: DataFrame, ratio: int = 5) -> DataFrame:
    """Edges `candidate`, `reference` without those whose candidate has `ratio` times the reference's reads or more."""
    c = counts.select(F.col("acc").alias("candidate"), F.col("n").alias("n_c"))
    t = counts.select(F.col("acc").alias("reference"), F.col("n").alias("n_t"))
    return edges.join(c, "candidate").join(t, "reference").where(F.col("n_c") < ratio * F.col("n_t"))
