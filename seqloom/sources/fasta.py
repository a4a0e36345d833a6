"""FASTA, FASTQ and SAM text as DataFrames, and back.

Files are split by Spark on record separators, so one large file is read by many tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import sequences as S


def kind_of(path: str) -> str:
    """`fastq` or `fasta`, by the last character of the path."""
    if path.endswith("q"):
        return "fastq"
    if path.endswith("a"):
        return "fasta"
    raise ValueError(f"{path}: reads are in files whose names end with q (FASTQ) or a (FASTA)")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """`acc`, `seq`: records that begin with `>` at a line's start; lines of a sequence are joined, spaces of a name become `_`."""
    text = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", r"\A>|\r", "")
    head = F.replace(F.trim(F.substring_index(record, "\n", 1)), F.lit(" "), F.lit("_"))
    body = F.when(F.instr(record, "\n") > 0, F.regexp_replace(F.substring(record, F.instr(record, "\n") + 1, F.length(record)), r"\s", "")).otherwise(F.lit(""))
    return text.where(F.trim("value") != "").select(head.alias("acc"), body.alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """`acc`, `seq`, `qual` (string; null where a record has none, or the file ends within it).

    Records may have several lines, and a quality line can begin with `@`, so where a record begins in the middle of a file is
    known only by the lengths of what follows. Each split of a file finds its first record by them and parses from there to its
    last one. That one, and the lines before the first, go to one task for each file, which puts them together in their order.
    """
    from functools import partial

    metadata = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_block_start")]
    lines = spark.read.option("lineSep", "\n").text(path).select("value", *metadata)
    schema = "acc string, seq string, qual string"
    inner = lines.mapInArrow(partial(_of_splits, False), schema)
    ends = lines.mapInArrow(partial(_of_splits, True), "file string, start bigint, part int, lines array<string>")
    joined = ends.repartition("file").sortWithinPartitions("file", "start", "part").mapInArrow(_joined, schema)
    return inner.union(joined)


def _batches(rows: list[tuple]):
    for at in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows[at : at + 4096], strict=True)], ["acc", "seq", "qual"])


def _is_start(lines: list[str], at: int, records: int = 3) -> bool:
    """Whether records begin at this line: sequence, `+`, as many qualities, and the next `@`, once at least, and again for some records."""
    sure = False
    for _ in range(records):
        if at >= len(lines):
            return sure
        if lines[at][:1] != "@":
            return False
        at, size = at + 1, 0
        while at < len(lines) and lines[at][:1] not in ("+", "@", ">"):
            size += len(lines[at].strip())
            at += 1
        if at >= len(lines):
            return sure
        if lines[at][:1] != "+" or not size:
            return False
        at += 1
        while at < len(lines) and size > 0:
            size -= len(lines[at].rstrip("\r"))
            at += 1
        if size < 0:
            return False
        sure = sure or at < len(lines) and lines[at][:1] == "@"
    return sure


def _of_splits(ends: bool, batches):
    """Records inside each split or, with `ends`, the lines in front of the first (part 0) and those of the last (part 1)."""
    where, lines, found, front = None, [], False, []

    def closed():
        rows = [(where[0], where[1], k, x) for k, x in ((0, front if found else front + lines), (1, lines if found else [])) if x]
        if ends and rows:
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "start", "part", "lines"])

    def parsed():
        """All records but the last, whose lines stay."""
        nonlocal lines, found, front
        if not found:
            at = 0 if where[1] == 0 else next((i for i in range(len(lines)) if _is_start(lines, i)), None)
            if at is None:
                return
            front, lines, found = front + lines[:at], lines[at:], True
        *some, last = [*_spans(lines)] or [(0, None)]
        if not ends and some:
            yield from _batches([r for _, r in some])
        lines = lines[last[0] :]

    for batch in batches:
        values, files, starts = (c.to_pylist() for c in batch.columns)
        at = 0
        while at < len(values):
            to = at
            while to < len(values) and (files[to], starts[to]) == (files[at], starts[at]):
                to += 1
            if where != (files[at], starts[at]):
                if where is not None:
                    yield from closed()
                where, lines, found, front = (files[at], starts[at]), [], False, []
            lines += values[at:to]
            if found or len(lines) > 200 or to < len(values):
                yield from parsed()
            at = to
    if where is not None:
        if not found:
            yield from parsed()
        yield from closed()


def _joined(batches):
    """Records of the lines that splits have left over, in the order of their files."""
    file, lines = None, []
    for batch in batches:
        done = []
        for name, _, part, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != file or part == 1:  # a last record begins where its lines begin
                done += _records(lines)
                file, lines = name, []
            lines += more
        yield from _batches(done)
    yield from _batches(list(_records(lines)))


def _records(lines: list[str]):
    return (record for _, record in _spans(lines))


def _spans(lines: list[str]):
    """(first line, (name, sequence, qualities)) of each record."""
    at = 0
    while at < len(lines):
        line, first = lines[at].rstrip("\r"), at
        at += 1
        if line[:1] not in ("@", ">"):
            continue
        fastq, name, seq = line[0] == "@", line[1:], []
        while at < len(lines) and lines[at][:1] not in ("+", "@", ">"):
            seq.append(lines[at].strip())
            at += 1
        sequence, quality = "".join(seq), None
        if fastq and at < len(lines) and lines[at][:1] == "+":
            at += 1
            some, size = [], 0
            while at < len(lines) and size < len(sequence):
                some.append(lines[at].rstrip("\r"))
                size += len(some[-1])
                at += 1
            quality = "".join(some) if size == len(sequence) else None
        yield first, (name, sequence, quality)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """`read_id`, `seq`, `phred`, `np` of consensus reads (`.../ccs`) in SAM text; the binary form needs a converter."""
    fields = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("@")).select(fields.alias("f"), "value")
    name = F.regexp_extract(F.col("f")[0], "^(.+)/ccs", 1)
    passes = F.regexp_extract("value", r"\tnp:i:(\d+)", 1)
    return lines.where(name != "").select(name.alias("read_id"), F.col("f")[9].alias("seq"), S.phred_values(F.col("f")[10]).alias("phred"), F.when(passes != "", passes.cast("int")).alias("np"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """`read`, `cluster` of a tab-separated table whose header row begins with `from`; a cluster's id is what follows its `/`."""
    rows = spark.read.csv(path, sep="\t").where(F.col("_c0") != "from")
    return rows.select(F.col("_c0").alias("read"), F.element_at(F.split("_c1", "/"), -1).alias("cluster"))


def last_of_each(reads: DataFrame, order: str) -> DataFrame:
    """Of rows with one accession that with the greatest `order`."""
    others = [c for c in reads.columns if c not in ("acc", order)]
    return reads.groupBy("acc").agg(F.max_by(F.struct(*others), order).alias("_r")).select("acc", "_r.*")


def fasta_text(acc: Column | str, seq: Column | str) -> Column:
    """A FASTA record."""
    return F.concat(F.lit(">"), acc if isinstance(acc, Column) else F.col(acc), F.lit("\n"), seq if isinstance(seq, Column) else F.col(seq))


def write_fasta(df: DataFrame, path: str, order: list | None = None, mode: str = "error") -> None:
    """`acc`, `seq` as FASTA files, in `order` (by accession if none is given) over the files."""
    df.orderBy(*(order or ["acc"])).select(fasta_text("acc", "seq").alias("value")).write.mode(mode).text(path)


def write_fastq(df: DataFrame, path: str, by: str | None = None, passes: str | None = None) -> None:
    """`acc`, `seq`, `qual` as FASTQ files; with `by` a folder for each of its values; with `passes` that column as a suffix of names."""
    name = F.concat("acc", F.lit("_passes:"), F.col(passes).cast("string")) if passes else F.col("acc")
    record = F.concat(F.lit("@"), name, F.lit("\n"), "seq", F.lit("\n+\n"), "qual")
    out = df.select(record.alias("value"), *([by] if by else []))
    (out.write.partitionBy(by) if by else out.write).text(path)


def clusters_to_fastq(reads: DataFrame, clusters: DataFrame, path: str, least: int = 1) -> None:
    """A folder of FASTQ files for each cluster of at least `least` reads. reads: `acc`, `seq`, `qual`; clusters: `read`, `cluster`."""
    large = clusters.groupBy("cluster").count().where(F.col("count") >= least).select("cluster")
    joined = reads.join(clusters.join(large, "cluster", "left_semi"), F.col("acc") == F.col("read"))
    write_fastq(joined, path, by="cluster")


def cropped(reads: DataFrame, consensus: DataFrame, reverse_minus: bool = True) -> DataFrame:
    """`acc`, `seq`, `phred`: each read's part of its consensus read, with that part's qualities.

    reads: `acc`, `seq`; consensus: `read_id`, `seq`, `phred`, `np`. On the minus strand (`strand=-` in the accession) the
    consensus is reverse-complemented and its qualities run backwards, and qualities are sorted within runs.
    """
    full = consensus.select("read_id", F.col("seq").alias("_full"), F.col("phred").alias("_phred"), "np")
    joined = reads.withColumn("read_id", S.read_key("acc")).join(full, "read_id")
    minus = F.col("acc").contains("strand=-")
    whole = F.when(minus & F.lit(reverse_minus), S.reverse_complement("_full")).otherwise(F.col("_full"))
    values = F.when(minus, F.reverse("_phred")).otherwise(F.col("_phred"))
    at = F.instr(whole, F.col("seq"))
    placed = joined.withColumn("_at", at).withColumn("_values", values).where("_at > 0")
    part = F.slice("_values", F.col("_at"), F.length("seq"))
    return placed.select("acc", "seq", F.when(minus, S.sorted_within_runs("seq", part)).otherwise(part).alias("phred"), "np")


def with_file_position(reads: DataFrame) -> DataFrame:
    """`reads` with `position`, ascending in input order (for `last_of_each`)."""
    return reads.withColumn("position", F.monotonically_increasing_id())


def quality_string(phred: Column | str) -> Column:
    """Integers to a quality string."""
    values = F.col(phred) if isinstance(phred, str) else phred
    return F.array_join(F.transform(values, lambda v: F.char(v + S.PHRED_OFFSET)), "")
