"""Command line: `python -m seqloom pipeline|get_candidates|stat_filter ...`."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seqloom.functions import sequences as S
from seqloom.operators import lineage
from seqloom.plans import pipeline as P
from seqloom.sources import fasta


def _reads(spark: SparkSession, path: str):
    read = fasta.read_fastq if fasta.kind_of(path) == "fastq" else fasta.read_fasta
    reads = read(spark, path)
    if "qual" in reads.columns:
        reads = reads.withColumn("phred", S.phred_values("qual")).drop("qual")
    return fasta.last_of_each(fasta.with_file_position(reads), "position")


def _each_step(out: str, verbose: bool):
    """Writes the tests of each step to `out`, and, if verbose, the tables of every step to its folder `steps`."""

    def write(name: str, table) -> None:
        logging.info("%s", name)
        if "p_value" in table.columns:
            for folder in [out, *([f"{out}/steps"] if verbose else [])]:
                table.write.mode("overwrite").csv(f"{folder}/{name}.tsv", sep="\t")
        elif verbose:
            fasta.write_fasta(table, f"{out}/steps/{name}.fa", mode="overwrite")

    return write


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="seqloom")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb in ("pipeline", "get_candidates", "stat_filter"):
        sub = verbs.add_parser(verb)
        sub.add_argument("-fl_reads", "--reads", required=True)
        sub.add_argument("-outfolder", "--out", required=True)
        if verb == "stat_filter":
            sub.add_argument("-candidates", "--candidates", required=True)
        sub.add_argument("--neighbor_search_depth", type=int)
        sub.add_argument("--min_exon_diff", type=int, default=20)
        sub.add_argument("--min_candidate_support", type=int, default=2)
        sub.add_argument("--p_value_threshold", type=float, default=0.01)
        sub.add_argument("--min_test_ratio", type=int, default=5)
        sub.add_argument("--ignore_ends_len", type=int, default=15)
        sub.add_argument("--ccs", help="consensus reads as SAM text, whose qualities count in the tests")
        sub.add_argument("--max_phred_q_trusted", type=float, default=43.0)
        sub.add_argument("--nr_cores", type=int, help="cores of a local session; a cluster's are the cluster's affair")
        sub.add_argument("--verbose", action="store_true", help="write the tables of every step")
        sub.add_argument("--cleanup", action="store_true", help="delete them again at the end")
        sub.add_argument("--logfile", help="file of the driver that the log goes to as well")
        sub.add_argument("--prefilter_candidates", action="store_true", help="accepted, without effect")
    o = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    if o.logfile:
        kept = logging.FileHandler(o.logfile)
        kept.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
        logging.getLogger().addHandler(kept)
    builder = SparkSession.builder.appName("seqloom")
    spark = (builder.master(f"local[{o.nr_cores}]") if o.nr_cores else builder).getOrCreate()
    params = P.Parameters(o.neighbor_search_depth, o.min_exon_diff, o.min_candidate_support, o.p_value_threshold, o.min_test_ratio, o.ignore_ends_len, o.max_phred_q_trusted)
    reads = _reads(spark, o.reads)
    if o.ccs and "phred" not in reads.columns:  # qualities of a FASTQ file come first
        placed = fasta.cropped(reads.select("acc", "seq"), fasta.read_sam(spark, o.ccs)).select("acc", "phred")
        reads = reads.select("acc", "seq").join(placed, "acc", "left")
    on_step = _each_step(o.out, o.verbose)
    if o.verb == "get_candidates":
        found = P.get_candidates(reads, params, on_step)
        fasta.write_fasta(found.candidates, f"{o.out}/candidates_converged.fa")
        fasta.write_fasta(found.unassigned, f"{o.out}/not_converged.fa")
        found.assignment.write.csv(f"{o.out}/cluster_info.tsv", sep="\t")
        return
    if o.verb == "stat_filter":
        candidates = fasta.read_fasta(spark, o.candidates).withColumn("support", S.support_of("acc"))
        final, assignment = P.stat_filter(reads, candidates, params, on_step=on_step)
    else:
        final, assignment = P.pipeline(reads, params, on_step)
    fasta.write_fasta(P.final_records(final), f"{o.out}/final_candidates.fa", [F.desc(F.length("seq")), "acc"])
    P.cluster_table(assignment, reads, final).write.csv(f"{o.out}/cluster_info.tsv", sep="\t")
    final.select(F.concat_ws("_", "acc", F.col("n").cast("string")).alias("label"), "p_value").write.csv(f"{o.out}/p_values.tsv", sep="\t")
    if o.cleanup and o.verbose:
        lineage.remove(spark, f"{o.out}/steps")
    logging.info("written to %s", o.out)


if __name__ == "__main__":
    main()
