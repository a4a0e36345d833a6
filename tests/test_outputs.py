"""Files of the verbs and of the FASTQ sinks."""

import os

from seqloom import __main__ as command
from seqloom.sources import fasta


def text_of(folder):
    return "".join(open(f"{folder}/{f}").read() for f in sorted(os.listdir(folder)) if f.startswith("part-"))


def test_tests_of_each_step_are_always_written(spark, tmp_path):
    p_values = spark.createDataFrame([("c_3_0.5_9_1", 0.1)], "label string, p_value double")
    reads = spark.createDataFrame([("r", "ACGT")], "acc string, seq string")
    for verbose in (False, True):
        out = f"{tmp_path}/{verbose}"
        write = command._each_step(out, verbose)
        write("p_values_0", p_values)
        write("candidates_after_step_0", reads)
        assert text_of(f"{out}/p_values_0.tsv") == "c_3_0.5_9_1\t0.1\n"
        assert os.path.isdir(f"{out}/steps/candidates_after_step_0.fa") == verbose


def test_passes_in_names(spark, tmp_path):
    reads = spark.createDataFrame([("m/1", "AC", "!I", 7)], "acc string, seq string, qual string, np int")
    fasta.write_fastq(reads, f"{tmp_path}/passes", passes="np")
    fasta.write_fastq(reads, f"{tmp_path}/plain")
    assert text_of(f"{tmp_path}/passes") == "@m/1_passes:7\nAC\n+\n!I\n" and text_of(f"{tmp_path}/plain") == "@m/1\nAC\n+\n!I\n"
