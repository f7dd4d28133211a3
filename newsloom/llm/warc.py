"""WARC archives: writing pages with revisit records, and reading by boundary-chain verification.

A payload may hold text that looks like a record's beginning. So every place with the magic is
only a candidate: tasks parse its header and emit the pair of its offset and its successor's.
Pointer jumping from the file's start then marks, in as many rounds as the logarithm of the
number of candidates, what the chain of true records reaches; the rest is rejected.

Archives are gzip files, which can't be split; so they are bounded by bytes, and an archive's
candidates and its chain are one task's.
"""

from __future__ import annotations

import gzip
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, narrow, read, shared_dir, text_of

MAGIC = b"WARC/1.1\r\n"
NAME = "urn:newsloom:page:"
#: Bytes from which equal payloads are written once, and about how many an archive holds: at most
#: and, where that gives too few archives to occupy all cores, at least.
LEAST, SIZE, SMALL = 100, 64 << 20, 4 << 20


def revisits(pages: DataFrame) -> DataFrame:
    """``page_id, digest, refers_to`` of pages (page_id, digest, bytes) whose payload a smaller
    page_id has. Rows that share the smallest id are all responses."""
    large = pages.where(F.col("bytes") >= LEAST)
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return (
        large.join(first.drop("n"), "digest")
        .where("refers_to is not null and not page_id <=> refers_to")
        .select("page_id", "digest", "refers_to")
        .distinct()
    )


def write(
    pages: DataFrame,
    folder: str,
    id: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    size: int = SIZE,
) -> None:
    """Writes a record per row into gzip-compressed archives of about ``size`` bytes of payload.

    Ids are whole numbers. A null payload counts as empty; a null url becomes the record's own
    name; line ends in a url are escaped; a null id gives a record with an empty name. Repeated
    rows are written again, into one archive. A very long payload makes its archive as long. An
    empty table gives archives without records. Other columns, whatever their names, are not read.
    """
    rows = narrow(pages, page_id=id, url=url, html=html)
    body, digest = text_of("html"), F.sha2(text_of("html"), 256)
    keyed = rows.select("page_id", digest.alias("digest"), F.octet_length(body).alias("bytes"))
    total = keyed.agg(F.sum("bytes")).first()[0] or 0
    archives = max(1, -(-total // size), min(-(-total // SMALL), spark_cores(pages)))
    # by one key, so that the rows that are dealt to archives meet their revisits where they are
    key = lambda id: F.substring(F.unhex(F.sha2(F.concat_ws(":", "digest", F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)), 1, 16)
    again = revisits(keyed).select(key("page_id").alias("key"), "refers_to")
    all_rows = rows.select("page_id", "url", body.alias("html"), digest.alias("digest"))
    joined = all_rows.withColumn("key", key("page_id")).repartition(archives, "key").join(again, "key", "left")
    name = F.concat(F.lit(f"<{NAME}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    length = F.octet_length("html").cast("string")
    is_new = F.col("refers_to").isNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit("\r\n\r\n"))
    block = F.when(is_new, F.concat(http, "html")).otherwise(http)
    line = lambda key, *value: F.concat(F.lit(f"{key}: "), *value, F.lit("\r\n"))
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    head = F.concat(
        F.lit(MAGIC.decode()),
        F.when(is_new, line("WARC-Type", F.lit("response"))).otherwise(line("WARC-Type", F.lit("revisit"))),
        line("WARC-Record-ID", name),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.coalesce(F.regexp_replace("url", r"[\r\n]", "%0A"), name)),
        line("WARC-Payload-Digest", F.lit("sha256:"), F.col("digest")),
        F.when(is_new, F.lit("")).otherwise(
            F.concat(
                line("WARC-Refers-To", F.lit(f"<{NAME}"), F.coalesce(F.col("refers_to").cast("string"), F.lit("")), F.lit(">")),
                line("WARC-Profile", F.lit(profile)),
                line("WARC-Payload-Length", length),
            )
        ),
        line("Content-Type", F.lit("application/http;msgtype=response")),
    )
    whole = joined.select(head.alias("head"), block.alias("block")).select(
        # the writer adds the last line feed of the record's end
        F.concat("head", line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"), "block", F.lit("\r\n\r"))
    )
    whole.write.option("lineSep", "\n").option("compression", "gzip").text(folder)


def spark_cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def candidates(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, where its block begins, successor's offset) of whatever looks like a record. No
    header holds the magic, so each ends before the next one, and every byte is looked at once."""
    found = []
    places = [m.start() for m in re.finditer(re.escape(MAGIC), data)]
    for at, following in zip(places, [*places[1:], len(data)], strict=False):
        end = data.find(b"\r\n\r\n", at, following)
        size = re.search(rb"\r\nContent-Length: *([0-9]{1,18})\r\n", data[at : end + 2], re.I) if end >= 0 else None
        if size:
            after = end + 4 + int(size[1])
            if data[after : after + 4] == b"\r\n\r\n":
                found.append((at, end + 4, after + 4))
    return found


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which records the chain from offset 0 reaches, by pointer jumping."""
    n = len(offsets)
    place = np.searchsorted(offsets, successors)
    found = (place < n) & (offsets[np.minimum(place, n - 1)] == successors) if n else np.zeros(0, bool)
    jump = np.r_[np.where(found, place, n), n]  # n: the end, or nowhere
    reached = np.zeros(n + 1, bool)
    reached[:1] = n > 0 and offsets[0] == 0
    for _ in range(max(n, 1).bit_length()):
        reached[jump[reached]] = True
        jump = jump[jump]
    return reached[:n]


def records(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of an archive's true records, in order."""
    found = candidates(data)
    places = np.array(found, np.int64).reshape(-1, 3)
    out = []
    for at, begin, end in places[reachable(places[:, 0], places[:, 2])].tolist():
        lines = data[at + len(MAGIC) : begin - 4].decode().split("\r\n")
        out.append(({k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, data[begin : end - 4]))
    return out


def _id(name: str) -> int | None:
    number = name.strip("<>").removeprefix(NAME)
    return int(number) if number else None


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url`` of each record in
    the archives below ``folder``; a revisit's payload is described by its header. An empty name
    gives a null id; archives without records, or that don't begin with one, give no rows. A task
    holds a whole archive."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def make():
        def step(batch: pa.RecordBatch):
            for content in batch.column("content"):
                data = content.as_py()
                rows = []
                for head, block in records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    page, kind = _id(head["warc-record-id"]), head["warc-type"]
                    if kind == "revisit":
                        size = int(head["warc-payload-length"])
                        digest, refers = head["warc-payload-digest"].removeprefix("sha256:"), _id(head["warc-refers-to"])
                    else:
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        size, digest, refers = len(payload), sha256(payload).hexdigest(), None
                    rows.append((page, size, digest, kind, refers, head["warc-target-uri"]))
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        return step

    files = spark.read.format("binaryFile").load(folder).select("content")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return arrow_map(files, make, schema, rows=1)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back from it."""
    folder = f"{shared_dir(spark)}/warc"
    write(read(spark, sf_dir, "pages"), folder)
    return read_back(spark, folder).drop("url")


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {LEAST} GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= {LEAST}"""
