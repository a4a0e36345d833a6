"""Operator 8: WARC archives whose records are compressed one by one with a shared Zstandard dictionary.

An archive is what one task writes. A dictionary is trained on records spread over the
archive and stands, compressed, in a skippable frame (magic number 0x184D2A5D) at its
start; each record is a frame of its own that needs that dictionary, so a reader can
start at any record once it has the first frame.

Archives are a table (`archive_id`, `seq`, `frame`): frames in the order of `seq` are
the file's bytes. A table is what executors of a cluster can write without a shared
disk; `export` writes the files where there is one.

Records with the same payload: the one with the smallest page id is a response, others
are revisits that refer to it and hold no payload. The digests are grouped first, so
that a payload that a third of all pages repeat is one row on that side; the pages
themselves meet their decision by page id.

Defined results: a null html is an empty payload; a null url an empty one; very long
pages are one record; rows without a page id are left out; every other row is one
record, and rows with the same page id are decided each by their own payload; a row
that repeats a page id together with its payload is decided as that row is, and no
page refers to itself; an empty table gives no archives; further columns are not
carried.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import common

MAGIC = 0x184D2A5D
#: Bytes of records of an archive, about; of its dictionary; and of the records that it is trained on, at most.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 20, 64 << 10, 4 << 20
#: Any fixed time: equal input gives equal archives.
DATE = "2000-01-01T00:00:00Z"
_SPACE = uuid.UUID("6f1d2c1e-5a60-4d5e-9c5b-0c6a3b8f7e21")


def payload_digest(payload: bytes) -> str:
    """SHA-1 in base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {digest}')}"


def record(page_id: int, url: str, payload: bytes | None, refers_to: int | None, size: int | None = None, digest: str | None = None) -> bytes:
    """One record: a response, or a revisit of the response of page `refers_to`, whose payload's size and digest are enough."""
    if payload is not None:
        size, digest = len(payload), payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_uri(page_id, digest)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        f"X-Page-ID: {page_id}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{_uri(refers_to, digest)}>",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's headers (names in lower case), the HTTP headers of its block under `http`, its payload, and whether the block's digest is right."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    inner = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    fine = headers["warc-block-digest"] == f"sha1:{payload_digest(block)}"
    return {"version": lines[0], "headers": headers, "http": inner, "payload": payload, "intact": fine}


def frames(records: list[bytes], level: int = 3) -> list[bytes]:
    """The dictionary's skippable frame, and a frame for each record."""
    import zstandard

    taken, size, step = [], 0, max(1, sum(map(len, records)) // SAMPLE_BYTES)
    for r in records[::step]:
        if size < SAMPLE_BYTES:
            taken.append(r[: SAMPLE_BYTES >> 4])
            size += len(taken[-1])
    dictionary = None
    if len(taken) >= 16 and size >= 8 * 1024:
        try:
            dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, size // 8), taken, k=256, d=8, level=level)
        except zstandard.ZstdError:  # the records are too alike or too short to train on
            dictionary = None
    if dictionary is None:
        dictionary = zstandard.ZstdCompressionDict(b"".join(taken)[-DICTIONARY_BYTES:] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packed = zstandard.ZstdCompressor(level=level).compress(dictionary.as_bytes())
    compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    return [struct.pack("<II", MAGIC, len(packed)) + packed, *(compressor.compress(r) for r in records)]


def reader(first: bytes):
    """A function from frames to records, given an archive's first frame."""
    import zstandard

    magic, size = struct.unpack("<II", first[:8])
    if magic != MAGIC or size != len(first) - 8:
        raise ValueError("the archive does not begin with a dictionary")
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(first[8:]))
    return zstandard.ZstdDecompressor(dict_data=dictionary).decompress


def decisions(df: DataFrame, at_least: int = 0) -> DataFrame:
    """`page_id`, `url`, `size`, `sha1` (hexadecimal), `payload`, and `refers_to` and no payload where the page revisits another with
    the same payload of at least so many bytes."""
    pages = df.where(F.col("page_id").isNotNull()).select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    pages = pages.select("*", F.octet_length("payload").alias("size"), F.sha1("payload").alias("sha1"))
    digest = pages.where(F.col("size") >= at_least).select("page_id", "sha1", "size")
    first = digest.groupBy("sha1", "size").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("_last")).where("refers_to < _last").drop("_last")
    revisits = digest.distinct().join(first, ["sha1", "size"]).where("page_id <> refers_to")  # one row for a page and payload
    joined = pages.join(revisits, ["page_id", "sha1", "size"], "left")
    return joined.select("page_id", "url", F.col("size").cast("bigint").alias("size"), "sha1", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "refers_to")


def write(decided: DataFrame) -> DataFrame:
    """Archives of the decided pages: `archive_id`, `seq`, `frame`."""
    common.tune(decided.sparkSession)

    def run(batches):
        records, size = [], 0

        def out():
            made = frames(records)
            name = uuid.uuid5(_SPACE, hashlib.sha1(made[-1] + made[0] + str(len(made)).encode()).hexdigest()).hex
            for at in range(0, len(made), common.BATCH_ROWS):
                part = made[at : at + common.BATCH_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.binary())], ["archive_id", "seq", "frame"])

        for batch in batches:
            for page_id, url, length, sha1, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                records.append(record(page_id, url, payload, refers, length, base64.b32encode(bytes.fromhex(sha1)).decode()))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield from out()
                    records, size = [], 0
        if records:
            yield from out()

    return decided.mapInArrow(run, "archive_id string, seq bigint, frame binary")


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of archives: `page_id`, `url`, `payload_bytes`, `payload_digest`, `record_type`, `refers_to`, `payload` (null for revisits)."""
    common.tune(archives.sparkSession)
    tasks = max(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), archives.where("seq = 0").count())  # an archive is of bounded size
    whole = archives.select("archive_id", "seq", "frame").repartition(tasks, "archive_id").sortWithinPartitions("archive_id", "seq")

    def run(batches):
        unpack = None
        for batch in batches:
            rows = []
            for seq, frame in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if seq == 0:
                    unpack = reader(frame)
                    continue
                one = parse(unpack(frame))
                h, kind = one["headers"], one["headers"]["warc-type"]
                if not one["intact"]:
                    raise ValueError(f"page {h['x-page-id']}: the block does not have the digest that its record names")
                refers = h.get("x-refers-to-page-id")
                rows.append((int(h["x-page-id"]), h["warc-target-uri"], int(one["http"]["content-length"]), h["warc-payload-digest"].removeprefix("sha1:"), kind, None if refers is None else int(refers), one["payload"] if with_payload and kind == "response" else None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return whole.mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def export(archives: DataFrame, folder: str) -> None:
    """Write each archive as `<archive_id>.warc.zst` into a folder that all executors see."""
    import os

    os.makedirs(folder, exist_ok=True)

    def run(rows):
        name, out = None, None
        for archive, frame in rows:
            if archive != name:
                if out:
                    out.close()
                name, out = archive, open(f"{folder}/{archive}.warc.zst", "wb")  # noqa: SIM115
            out.write(frame)
        if out:
            out.close()

    archives.repartition("archive_id").sortWithinPartitions("archive_id", "seq").select("archive_id", "frame").foreachPartition(run)


def op8_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    archives = common.materialize(write(decisions(common.table(spark, sf_dir, "pages"))), "warc")
    return read(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
