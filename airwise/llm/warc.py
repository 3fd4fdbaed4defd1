r"""Operator 1, WARC: monolithic gzip archives rewritten with one member per record and an offset index.

``write_monolithic`` writes records as WARC/1.1 text through Spark's text writer with gzip: every
file is one gzip stream, which nobody can enter in the middle.

``normalise`` inflates each such file once, as a stream.  Spark's reader cuts the inflated stream
at blank lines (CR LF CR LF), in order, within one task per file; the pieces are joined again and
records are cut by their Content-Length, so blank lines inside a payload are no boundaries.  A
record is rewritten as its own gzip member.  Only the current record, 4 MiB of members and the
lines of one index member are held in memory.  Archives and index leave in one job with Spark's commit protocol, so a lost or repeated task leaves no half
file: ``kind=archive/part-N`` holds the members, ``kind=index/part-N`` the sidecar: gzip members
of lines, one JSON list per record (offset, length, record id, type, target).

After each member the writer puts an empty gzip member, ``SYNC``.  It inflates to nothing, so the
files stay ordinary .warc.gz streams for any reader; but Spark can split such a file anywhere and
find the next record, which makes one large archive readable by many tasks.  A record whose
compressed bytes hold ``SYNC`` is compressed in another way until they don't.

``read_records`` reads archives by SYNC in parallel; ``read_index`` reads the sidecars.

Rows: null html is an empty payload, null url an empty target.  Repeated rows become records each.
A null page_id is written as an empty id and read as null; as it is no number, it is a response's
id only for records with null ids alone.  Bytes are kept exactly, whatever line ends a text has.
Empty tables give empty folders and results; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airwise.llm.common import scratch_path, stored, text_batches

BLANK = "\r\n\r\n"
MIN_REVISIT = 100
#: Fixed value: an empty gzip member (header with unknown system, empty deflate block, zero checksum and size).
SYNC = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
LINES_PER_MEMBER = 1000


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload (binary), payload_bytes, payload_digest, record_type, refers_to.

    Per digest the smallest id is a partial aggregate.  Only pages that are not the smallest of their
    digest are revisits; they are found on narrow rows and joined back by id."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("html"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    # stored, so that the join deals both sides anew and AQE can split a payload that many pages share
    first = stored(rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
                   .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
                   .select(F.col("payload_digest").alias("_digest"), "first"), "first-payloads")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") >= min_bytes), "left") \
        .select("page_id", "url", F.when(~revisit, F.col("html")).otherwise("").alias("html"), "payload_bytes", "payload_digest",
                F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def _clean(c):
    return F.regexp_replace(c, r"[\r\n]+", " ")


def record_text(c_body: str = "html"):
    """A record as text: named fields, a blank line, the block.  The writer adds the closing blank line."""
    head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("record_type")),
            F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
            F.concat(F.lit("WARC-Target-URI: "), _clean(F.col("url"))), F.lit("Content-Type: text/html; charset=utf-8"),
            F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
            F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
            F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")),
            F.concat(F.lit("Content-Length: "), F.octet_length(c_body).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *head), F.lit(BLANK), F.col(c_body))


def write_monolithic(records: DataFrame, path: str) -> None:
    """Each task's records as one gzip stream."""
    records.select(record_text().alias("value")).write.option("compression", "gzip").option("lineSep", BLANK).text(path)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records (fields, blank line, block) from the pieces between blank lines of one stream."""
    blank, parts, missing = BLANK.encode(), [], 0  # missing: bytes of the block still to come
    for piece in pieces:
        if parts:
            if len(piece) < missing:  # the blank line that cut the block belongs to it
                cut = blank[:missing - len(piece)]
                parts += [piece, cut]
                missing -= len(piece) + len(cut)
                if not missing:
                    yield b"".join(parts)
                    parts = []
                continue
            yield b"".join([*parts, piece[:missing]])
            parts, piece = [], piece[missing:]
        head = piece.lstrip(b"\r\n")
        if head:  # fields of the next record
            missing = int(_fields(head).get("content-length", 0))
            parts = [head, blank]
            if not missing:
                yield b"".join(parts)
                parts = []
    if parts:
        raise ValueError(f"the stream ends {missing} bytes before the end of a record")


def member(record: bytes) -> bytes:
    """The record with its closing blank line as one gzip member that doesn't hold SYNC."""
    data = record + BLANK.encode()
    for level, strategy in ((6, zlib.Z_DEFAULT_STRATEGY), (9, zlib.Z_DEFAULT_STRATEGY), (6, zlib.Z_HUFFMAN_ONLY), (6, zlib.Z_FIXED)):
        z = zlib.compressobj(level, zlib.DEFLATED, 31, 9, strategy)
        out = z.compress(data) + z.flush()
        if SYNC not in out:
            return out
    raise ValueError("a record can't be compressed without the sync member in it")


def _rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    offset, seq, index = 0, 0, []  # index: lines of the index member that isn't full yet

    def streams() -> Iterator[tuple[str, Iterator[bytes]]]:
        """The pieces of one file after the other; files of a task follow each other."""
        rows = ((f, bytes(v)) for b in batches for f, v in zip(b["file"], b["value"]))
        current = next(rows, None)
        while current is not None:
            name = current[0]

            def one() -> Iterator[bytes]:
                nonlocal current
                while current is not None and current[0] == name:
                    yield current[1]
                    current = next(rows, None)

            yield name, one()

    kinds, seqs, values, size = [], [], [], 0

    def index_member() -> None:
        nonlocal index, size
        kinds.append("index"), seqs.append(seq), values.append(member("\n".join(index).encode()))
        index, size = [], size + len(values[-1])

    for _, stream in streams():
        for record in split_records(stream):
            f, m = _fields(record.partition(BLANK.encode())[0]), member(record)
            index.append(json.dumps([offset, len(m), f.get("warc-record-id", ""), f.get("warc-type", ""), f.get("warc-target-uri", "")]))
            kinds.append("archive"), seqs.append(seq), values.append(m)
            offset, seq, size = offset + len(m) + len(SYNC), seq + 1, size + len(m)
            if len(index) == LINES_PER_MEMBER:
                index_member()
            if size > 1 << 22:
                yield pd.DataFrame({"kind": kinds, "seq": seqs, "value": values})
                kinds, seqs, values, size = [], [], [], 0
    if index:
        index_member()
    if kinds:
        yield pd.DataFrame({"kind": kinds, "seq": seqs, "value": values})


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """Rewrite every monolithic archive below ``source``: member per record and sidecar index below ``target``."""
    text_batches(spark)
    # .gz files are never split, so a task sees whole streams, in order
    raw = spark.read.option("lineSep", BLANK).text(source).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    members = raw.mapInPandas(_rewrite, "kind string, seq long, value binary").sortWithinPartitions("kind", "seq")
    members.select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind") \
        .option("lineSep", SYNC.decode("latin-1")).option("encoding", "ISO-8859-1").text(target)


def _members(spark: SparkSession, path: str, kind: str) -> DataFrame:
    rows = spark.read.option("lineSep", SYNC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    here = F.col("kind") == kind if "kind" in rows.columns else F.lit(False)  # no archive was written for an empty table
    return rows.where(here).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, target, payload_bytes, payload_digest (both as declared), refers_to, block: one row per member.

    A response's declared digest and length are checked against its block; a difference is an error."""
    text_batches(spark)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            out = []
            for v in b["value"]:
                if not v:
                    continue
                record = zlib.decompress(bytes(v), 31)
                head, _, rest = record.partition(BLANK.encode())
                f = _fields(head)
                block = rest[:int(f.get("content-length", 0))]
                digest = f.get("warc-payload-digest", "").removeprefix("sha256:")
                if f.get("warc-type") == "response" and (hashlib.sha256(block).hexdigest(), len(block)) != (digest, int(f.get("x-payload-length", -1))):
                    raise ValueError(f"record {f.get('warc-record-id')}: the block is not the payload that was written")
                out.append((f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), int(f.get("x-payload-length", len(block))),
                            digest, f.get("warc-refers-to"), block))
            if out:
                yield pd.DataFrame(out, columns=["record_id", "record_type", "target", "payload_bytes", "payload_digest", "refers_to", "block"])

    return _members(spark, path, "archive").select("value").mapInPandas(
        rows, "record_id string, record_type string, target string, payload_bytes long, payload_digest string, refers_to string, block binary")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """archive (file path), offset, length, record_id, record_type, target: the sidecar rows."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(re.sub("kind=index", "kind=archive", f), *json.loads(x)) for f, v in zip(b["file"], b["value"]) if v
                   for x in zlib.decompress(bytes(v), 31).decode().removesuffix(BLANK).split("\n")]
            if out:
                yield pd.DataFrame(out, columns=["archive", "offset", "length", "record_id", "record_type", "target"])

    return _members(spark, path, "index").mapInPandas(
        rows, "archive string, offset long, length long, record_id string, record_type string, target string")


def _page(c: str):
    return F.expr(f"try_cast(nullif(regexp_extract({c}, '<urn:page:(.*)>', 1), '') AS bigint)")


def roundtrip(pages: DataFrame) -> DataFrame:
    """Write a record per page, normalise the archives, read them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to, all from the records read."""
    spark = pages.sparkSession
    source, target = scratch_path(spark, "warc-monolithic"), scratch_path(spark, "warc-members")
    write_monolithic(with_revisits(pages), source)
    normalise(spark, source, target)
    return read_records(spark, target).select(_page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                                              _page("refers_to").alias("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest,
       CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h
"""
