"""How many reads it takes to tell two similar sequences apart: a seeded simulation, one task's work per replicate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Read lengths are triangular over 0, 10,000 and 45,000 bases.
LENGTHS = (0.0, 10_000.0, 45_000.0)


def replicate(seed: int, depth: int, length: int, variants: int, share: float) -> float:
    """p-value bound of one replicate: `depth` reads, of which `share` are from a sequence that differs at `variants` places."""
    rng = np.random.default_rng(seed)
    passes = np.maximum(1, np.floor(np.clip(rng.triangular(*LENGTHS, depth), length, None) / length))
    error = 0.15 / passes  # of a read, by its passes
    p = np.clip(error / 3, 1e-9, 0.5) ** variants
    supports = rng.random(depth) < share
    w = np.log(p) / np.log(p).min()
    m, y = float((w * p).sum()), float(w[supports].sum())
    if y == 0:
        return 1.0
    return 0.5 if y == m else float(np.exp(y - m - y * np.log(y / m)))


def simulate(spark: SparkSession, depths: list[int], replicates: int = 100, length: int = 2000, variants: int = 1, share: float = 0.05, seed: int = 1) -> DataFrame:
    """`depth`, `replicate`, `p_value`."""

    def run(batches):
        for part in batches:
            p = [replicate(seed * 1_000_003 + int(i), depths[int(i) // replicates], length, variants, share) for i in part["id"]]
            yield pd.DataFrame({"depth": [depths[int(i) // replicates] for i in part["id"]], "replicate": part["id"] % replicates, "p_value": p})

    return spark.range(len(depths) * replicates).mapInPandas(run, "depth int, replicate long, p_value double")


def quantiles(simulated: DataFrame, at: float = 0.9) -> DataFrame:
    """`depth`, `p_value`: of each depth the value that stands at floor(n * at) in ascending order."""
    from pyspark.sql import functions as F

    values = F.array_sort(F.collect_list("p_value"))
    return simulated.groupBy("depth").agg(values.alias("_v")).select("depth", F.element_at("_v", (F.floor(F.size("_v") * at) + 1).cast("int")).alias("p_value"))
