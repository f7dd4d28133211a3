import gzip
import time
from hashlib import sha256

import numpy as np

from newsloom.llm import warc
from newsloom.llm.common import shared_dir

FAKE = warc.MAGIC.decode() + "WARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def plain(rows):
    first, out = {}, []
    for i, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        digest = sha256(raw).hexdigest()
        if len(raw) >= 100:
            first.setdefault(digest, i)
        source = first.get(digest, i)
        out.append((i, len(raw), digest, "response" if source == i else "revisit", None if source == i else source))
    return sorted(out, key=str)


def round_trip(spark, rows, partitions=1):
    folder = shared_dir(spark)
    df = spark.createDataFrame([(i, None if k % 2 else "http://x\r\ny", h, "e") for k, (i, h) in enumerate(rows)], "page_id long, url string, html string, digest string")
    warc.write(df.coalesce(partitions), folder, size=4000)
    return sorted((tuple(r)[:5] for r in warc.read_back(spark, folder).collect()), key=str)


def test_odd_pages(spark):
    rows = list(enumerate(["x" * 100, "x" * 100, "x" * 99, "x" * 99, FAKE * 3, "é" * 60, "é" * 60, "", None, FAKE + "y" * 200 + FAKE, "a\r\n\r\nb\n" * 50, FAKE * 3, "z" * 200_000]))
    rows += [(3, "q" * 150), (3, "q" * 150), (7, "q" * 150), (None, "q" * 150)]
    assert round_trip(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert round_trip(spark, []) == []


def test_only_reachable_candidates_are_records():
    data = b"".join(
        warc.MAGIC + f"WARC-Type: response\r\nWARC-Record-ID: <{k}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
        for k, body in enumerate([FAKE.encode(), b"", FAKE.encode() * 5, b"end"])
    )
    assert len(warc.candidates(data)) == 10
    assert [h["warc-record-id"] for h, _ in warc.records(data)] == ["<0>", "<1>", "<2>", "<3>"]
    assert warc.records(data[5:]) == [] and warc.records(b"") == []


def test_hostile_payloads_cost_in_proportion():
    def seconds(copies):
        body = warc.MAGIC * copies
        data = warc.MAGIC + f"WARC-Type: response\r\nWARC-Record-ID: <1>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
        start = time.perf_counter()
        assert len(warc.records(data)) == 1
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(400_000) < 3 * seconds(200_000) + 0.3


def test_archives_are_bounded_by_bytes(spark):
    folder = shared_dir(spark)
    df = spark.createDataFrame([(k, "u", f"{k} " * 2000) for k in range(64)], "page_id long, url string, html string")
    warc.write(df, folder, size=50_000)
    files = spark.read.format("binaryFile").load(folder).select("content").collect()
    sizes = [len(gzip.decompress(r["content"])) for r in files]
    assert len(sizes) >= 5 and max(sizes) < 5 * 50_000 and warc.read_back(spark, folder).count() == 64


def test_pointer_jumping():
    offsets = np.array([0, 10, 15, 30, 40], np.int64)
    successors = np.array([10, 30, 40, 99, 99], np.int64)
    assert warc.reachable(offsets, successors).tolist() == [True, True, False, True, False]
    assert warc.reachable(np.empty(0, np.int64), np.empty(0, np.int64)).tolist() == []
