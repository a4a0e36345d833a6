"""Names of candidates, and the rows of the output files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import neighbors
from seqloom.operators.lineage import written


def named(candidates: DataFrame) -> DataFrame:
    """`acc` from the lexicographic number of `seq` (distinct) and `degree`.

    Numbers follow from ranges of sequences, whose bounds Spark samples, and places inside a range, so no task orders all,
    however alike their beginnings are.
    """
    ranged = candidates.select("seq", "degree").repartitionByRange("seq").sortWithinPartitions("seq")
    ranged = written(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranged").withColumn("_part", F.shiftright("_id", 33))
    before = neighbors.running_before(ranged.groupBy("_part").count(), "_part", F.floor(F.col("_part") / 512))
    number = F.col("before") + F.col("_id") % (1 << 33)
    return ranged.join(before, "_part").select(F.concat(F.lit("transcript_"), number.cast("string"), F.lit("_support_"), F.col("degree").cast("string")).alias("acc"), "seq", "degree")


def final_records(final: DataFrame) -> DataFrame:
    """`acc` with support, p-value, reads tested and number of variants; `seq`; longest first when written."""
    fields = ["acc", F.col("n").cast("string"), F.coalesce(F.col("p_value").cast("string"), F.lit("not_tested")), F.coalesce(F.col("n_t").cast("string"), F.lit("0")), F.coalesce(F.col("n_variants").cast("string"), F.lit("0"))]
    return final.select(F.concat_ws("_", *fields).alias("acc"), "seq")


def cluster_table(assignment: DataFrame, reads: DataFrame, final: DataFrame) -> DataFrame:
    """`read`, `candidate`, `read_len`, `candidate_len`."""
    r = reads.select(F.col("acc").alias("read"), F.length("seq").alias("read_len"))
    c = final.select(F.col("acc").alias("candidate"), F.length("seq").alias("candidate_len"))
    return assignment.join(r, "read").join(c, "candidate").select("read", "candidate", "read_len", "candidate_len")
