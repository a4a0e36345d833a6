"""The verbs' loops end when they converge; at a limit on steps they fail instead of returning what is not done."""

import pytest

from seqloom.plans import pipeline as P


def test_limit_is_an_error(spark):
    base = "ACGTTGCAAC" * 6
    reads = spark.createDataFrame([(f"r{i}", base if i < 6 else base[: 7 * i - 30] + base[7 * i - 29 :]) for i in range(9)], "acc string, seq string")
    once = P.Parameters(most_steps=1)
    with pytest.raises(RuntimeError, match="not converged"):
        P.get_candidates(reads, once)
    candidates = spark.createDataFrame([("c", base, 6)], "acc string, seq string, support int")
    with pytest.raises(RuntimeError, match="not converged"):
        P.stat_filter(reads, candidates, once)
    assert P.Parameters().most_steps is None
