"""WARC archives: writing with revisit records, and reading with boundary-chain verification.

Archives are written by Spark's text writer, whose line separator is the blank lines that end a record, so they
reach any store Spark writes to and commit as a whole. A reader task takes one archive: every place where a record
could begin is a candidate with the offset of its successor; pointer jumping from the start of the file, doubling
the stride each round, keeps the candidates that the chain of records reaches, which rejects a record's magic
inside a payload.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

_MAGIC = b"WARC/1.1\r\n"
_END = "\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
#: Records in an archive at most; with them an archive's bytes are what one reader task holds.
RECORDS_PER_FILE = 2000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: eight groups of five hex digits, four letters each."""
    letters = F.lit(_BASE32)
    parts = []
    for k in range(8):
        group = F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(letters, F.shiftright(group, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*parts)


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """_id, url, html, digest and refers_to: the largest page_id of an equal payload of at least `least` bytes, for
    every other page with it.

    Only payloads that occur more than once are looked up; what they refer to is written first, so that Spark knows
    its size when it chooses how to join."""
    rows = pages.select(F.col("page_id").cast("long").alias("_id"), F.col("url").cast("string").alias("url"), common.null_as_empty("html").alias("html"))
    keyed = rows.withColumn("_sha", F.sha1("html"))
    light = keyed.where(F.octet_length("html") >= least).select("_id", "_sha")
    most = light.groupBy("_sha").agg(F.max("_id").alias("_largest"), F.count("*").alias("_n")).where("_n > 1 and _largest is not null").drop("_n")
    revisits = light.join(most, "_sha").where(F.col("_id").isNull() | (F.col("_id") < F.col("_largest"))).distinct()
    revisits = common.stash(revisits.select(F.col("_id").alias("_of"), F.col("_sha").alias("_same"), F.col("_largest").alias("refers_to")), "warc-revisits")
    found = keyed.join(revisits, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_sha") == F.col("_same")), "left")
    return found.select("_id", "url", "html", base32(F.col("_sha")).alias("digest"), "refers_to")


def _header(*lines: Column | str) -> Column:
    return F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in lines])


def records(rows: DataFrame) -> DataFrame:
    """The text of each record, without the blank lines that end it."""
    size = F.octet_length("html").cast("string")
    http = _header("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", size, "\r\n\r\n")
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    ident = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    head = _header(
        _MAGIC.decode(), "WARC-Type: ", F.when(revisit, "revisit").otherwise("response"),
        "\r\nWARC-Record-ID: <urn:page:", ident, ">\r\nWARC-Date: ", _DATE,
        F.when(F.col("url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), target)).otherwise(""),
        "\r\nWARC-Payload-Digest: sha1:", F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        "\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: ", F.octet_length(body).cast("string"), "\r\n\r\n",
    )
    return rows.select(F.concat(head, body).alias("value"))


def write(pages: DataFrame, path: str, least: int = 0, per_file: int = RECORDS_PER_FILE) -> str:
    """Writes gzipped archives of pages (page_id, url, html) below path.

    A null html is an empty payload; of records with equal payloads of at least `least` bytes the one with the
    largest page_id is the response and the others revisit it; null page_ids count as the smallest, and if no page_id
    of a payload is known, all its records are responses, as are equal rows with the largest page_id. Line breaks in a url become spaces. No pages: no
    records. Other columns are not read."""
    out = records(with_revisits(pages, least))
    out.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    return path


def chain(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, start of the content, its end) of each record of an archive, by pointer jumping over candidates."""
    starts, nexts, spans = [], [], []
    for m in re.finditer(re.escape(_MAGIC), data):
        head = data.find(b"\r\n\r\n", m.start())
        length = re.search(rb"\r\nContent-Length: (\d+)(?:\r\n|$)", data[m.start() : head]) if head >= 0 else None
        if length:
            end = head + 4 + int(length[1])
            starts.append(m.start())
            nexts.append(end + len(_END))
            spans.append((m.start(), head + 4, end))
    if not starts:
        return []
    n, at = len(starts), np.asarray(starts)
    follow = np.searchsorted(at, nexts)  # n is the end of every chain
    follow = np.append(np.where(at[np.minimum(follow, n - 1)] == nexts, follow, n), n)
    reached = np.zeros(n + 1, bool)
    reached[0] = starts[0] == 0
    while True:
        more = reached.copy()
        more[follow[reached]] = True
        follow = follow[follow]
        if (more == reached).all() or (follow == n).all():
            reached = more
            break
        reached = more
    return [spans[k] for k in np.flatnonzero(reached[:n])]


def parse(data: bytes) -> Iterator[dict]:
    """The records of an archive, verified; a content that ends beyond the file is an error."""
    import base64
    import hashlib

    for offset, start, end in chain(data):
        if end > len(data):
            raise ValueError(f"the record at {offset} is cut off")
        fields = dict(x.split(": ", 1) for x in data[offset : start - 4].decode().split("\r\n")[1:])
        http, _, payload = data[start:end].partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "response" and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
            raise ValueError(f"the payload of the record at {offset} has another digest")
        ident = lambda x: int(v) if (v := x[len("<urn:page:") : -1]) else None
        yield {
            "page_id": ident(fields["WARC-Record-ID"]),
            "url": fields.get("WARC-Target-URI"),
            "payload_bytes": size,
            "payload_digest": digest,
            "record_type": fields["WARC-Type"],
            "refers_to": ident(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
            "payload": payload if fields["WARC-Type"] == "response" else None,
        }


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives below path: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to and payload (null for revisits). An empty archive has no records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        schema = None
        for batch in batches:
            for value in batch.column("content"):
                data = value.as_py()
                if data[:2] == b"\x1f\x8b":
                    parts = []
                    while data:
                        member = zlib.decompressobj(31)
                        parts.append(member.decompress(data))
                        data = member.unused_data
                    data = b"".join(parts)
                rows = list(parse(data))
                schema = schema or pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
                for k in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 500], schema)

    files = common.bound_batches(spark).read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, _RECORDS)
