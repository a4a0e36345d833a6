"""FASTQ files are read by many tasks, wherever their splits fall."""

import random

import pytest

from seqloom.sources import fasta


def content(seed, n, width, ending):
    """Records of several lines, with qualities that begin with `@`, `+` and `>`."""
    rng, lines, rows = random.Random(seed), [], []
    for i in range(n):
        seq = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 90)))
        qual = "".join(rng.choice("@+>I!") for _ in seq)
        cut = lambda s: [s[k : k + width] for k in range(0, len(s), width)]
        lines += [f"@r{i} x", *cut(seq), "+", *cut(qual)]
        rows.append((f"r{i} x", seq, qual))
    return ending.join(lines) + ending, rows


@pytest.mark.parametrize(("width", "ending"), [(1000, "\n"), (17, "\n"), (1000, "\r\n")])
@pytest.mark.parametrize("split", [64, 700, 1 << 20])
def test_any_split(spark, tmp_path, width, ending, split):
    text, rows = content(width + split, 300, width, ending)
    (tmp_path / "a.fq").write_text(text, newline="")
    (tmp_path / "b.fq").write_text("@lone\nACG\n+\n@I", newline="")  # ends within a record
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = fasta.read_fastq(spark, str(tmp_path))
        got = [tuple(r) for r in df.collect()]
        assert sorted(got, key=str) == sorted([*rows, ("lone", "ACG", None)], key=str)
        assert split > 1000 or df.rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
