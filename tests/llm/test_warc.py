"""Operator 2: round trips of archives, revisits against brute force, filters and foreign files."""

import base64
import gzip
import hashlib
import random
import time
from collections import Counter

import pytest

from reportmill.llm import warc

SCHEMA = "page_id long, url string, html string, key string, keep long"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows, least=0):
    last, many = {}, Counter()
    for i, _, html in rows:
        many[html or ""] += 1
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", i))
    out = Counter()
    for i, url, html in rows:
        keep = last.get(html or "") if len((html or "").encode()) >= least and many[html or ""] > 1 else None
        again = keep is not None and i != keep
        out[i, len((html or "").encode()), digest(html), "revisit" if again else "response", keep if again else None, url] += 1
    return out


def rows():
    long = "<p>" + "x é 漢 " * 40_000
    out = [(i, f"http://h/{i}", f"<p>page {i % 7}</p>") for i in range(40)]
    out += [(100, None, None), (101, "u\r\nWARC-Type: response", ""), (102, "u", long), (103, "ü", long), (104, "u", "HTTP/1.1 200\r\n\r\nWARC/1.1\r\n\r\n")]
    return [*out, (None, "u", "<p>page 1</p>"), (None, "u", "only here"), (105, "u", "same"), (105, "u", "same")]


def table(spark, data):
    return spark.createDataFrame([(*x, "k", 7) for x in data], SCHEMA).repartition(3)


@pytest.mark.parametrize("least", [0, 20])
def test_archive_and_back(spark, tmp_path, least):
    path = f"file://{tmp_path}/a"
    warc.archive_pages(table(spark, rows()), path, least)
    got = warc.read_pages(spark, path, payload=True).collect()
    want = brute(rows(), least)
    clean = lambda u: u and warc.clean(u)
    assert Counter((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to, x.url) for x in got) == Counter(
        {(*k[:5], clean(k[5])): n for k, n in want.items()}
    )
    texts = {i: (html or "").encode() for i, _, html in rows()}
    assert all(bytes(x.payload) == texts[x.page_id] for x in got if x.record_type == "response" and x.page_id is not None)


def test_filters_and_no_payload(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.archive_pages(table(spark, rows()), path)
    read = spark.read.format("warc").option("path", path).option("payload", "false").option("partition_bytes", "1").load()
    want = Counter(k[3] for k in brute(rows()).elements())
    for kind in ("revisit", "response"):
        assert read.filter(f"record_type = '{kind}'").count() == want[kind]
    assert read.filter("record_type IN ('revisit', 'warcinfo') AND refers_to IS NULL").count() == 0
    assert read.filter("target_uri LIKE 'http://h/1%'").count() == 11
    assert read.filter("payload_bytes > 100000 AND record_type = 'response'").count() == 1
    assert read.filter("payload IS NOT NULL").count() == 0


def test_foreign_files(spark, tmp_path):
    row = {"record_id": "urn:x-page:1", "record_type": "response", "refers_to": None, "target_uri": "u", "payload": b"a\r\n\r\nb" * 900}
    data = [warc.record(row | {"record_id": f"urn:x-page:{i}"}, "2020-01-01T00:00:00Z") for i in range(3)]
    (tmp_path / "plain.warc").write_bytes(b"".join(data))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    got = warc.read_pages(spark, f"file://{tmp_path}", payload=True).collect()
    assert sorted(x.page_id for x in got) == [0, 0, 1, 1, 2, 2]
    assert {bytes(x.payload) for x in got} == {row["payload"]}
    one = warc.read_pages(spark, f"file://{tmp_path}/members.warc.gz")
    assert one.filter("record_type = 'response'").count() == 3


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.archive_pages(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_pages(spark, path).count() == 0


def test_large_gzip_records_are_read_in_one_pass(spark, tmp_path):
    """64 MB that hardly compress: time follows the size, not its square."""
    data = random.Random(1).randbytes(48 << 20).hex()[: 64 << 20]
    block = b"HTTP/1.1 200 OK\r\n\r\n" + data.encode()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    path = tmp_path / "a.warc.gz"
    path.write_bytes(warc.member(head + block + b"\r\n\r\n", 1))
    began = time.process_time()
    with path.open("rb") as f:
        [(got, length, payload)] = list(warc.records(warc.Stream(f), lambda _: True, True))
    assert length == len(data) and payload == data.encode() and time.process_time() - began < 10
