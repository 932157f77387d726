import base64
import gzip
import hashlib

import pytest

from tarnloom.llm import common, warc

TRAP = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9999\r\n\r\n"


def expected(rows, least=0):
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        top = largest.get(h or "")
        again = top is not None and (i is None or i < top) and len(p) >= least
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 4])
def test_round_trip(spark, least):
    rows = [(1, "u\r\nx", "<p>a"), (2, None, "<p>a"), (3, "u", None), (4, "u", ""), (5, "u", TRAP), (6, "u", "x" * 300_000 + "é\r\n\r\n"), (7, "u", "é"), (7, "u", "é"), (None, "u", "é"), (None, None, "alone"), (9, "u", "<p>a")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, digest int, refers_to string")
    path = warc.write(pages, common.work_path(spark, "t"), least=least, per_file=4)
    got = warc.read(spark, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows, least)
    texts = {(i, (h or "").encode()) for i, _, h in rows}
    assert all((r.page_id, bytes(r.payload)) in texts for r in got if r.record_type == "response")


def test_chain_rejects_magic_in_payloads():
    def record(body):
        return b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)

    bodies = [b"a", TRAP.encode(), record(record(b"inner")), b"", b"z" * 1000]
    data = b"".join(map(record, bodies))
    assert [data[s:e] for _, s, e in warc.chain(data)] == bodies
    assert warc.chain(b"") == [] and warc.chain(b"x" + data) == []


def test_no_pages(spark):
    path = warc.write(spark.createDataFrame([], "page_id long, url string, html string"), common.work_path(spark, "t"))
    assert warc.read(spark, path).collect() == []


def test_archives_are_plain_warc(spark, tmp_path):
    path = warc.write(spark.createDataFrame([(1, "u", "<p>a")], "page_id long, url string, html string"), f"file://{tmp_path}/a")
    data = b"".join(gzip.open(f).read() for f in tmp_path.glob("a/part-*.gz"))
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"<p>a\r\n\r\n")
