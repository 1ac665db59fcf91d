import base64
import gzip
import hashlib
import io

from perilake.llm import warc
from perilake.llm.shared import fresh_path

MARK = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
ROWS = [(3, "http://a/3", "same"), (1, "http://a/1", "same"), (2, "http://a/2", MARK), (4, None, None), (5, "u", ""),
        (6, "x\r\ny", "é" * 10), (None, "n", "same"), (7, "", "\r\n\r\n"), (8, "big", "z" * 100_000), (1, "http://a/1", "same")]


def through(spark, rows, **how):
    pages = spark.createDataFrame([(*r, "s", 1) for r in rows], "page_id long, url string, html string, payload string, source_id int")
    a, b = fresh_path(spark, "a"), fresh_path(spark, "b")
    warc.write(warc.captured(pages), a)
    crawl = warc.read(spark, a)
    warc.write(warc.deduplicated(crawl, **how), b)
    return crawl.collect(), warc.resolved(warc.read(spark, b)).collect()


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_archives_return_all_payloads(spark):
    crawl, slim = through(spark, ROWS)
    key = lambda x: str(x)
    assert sorted(((r.source_id, r.payload, r.payload_digest, r.payload_bytes) for r in crawl), key=key) == sorted(
        ((i, t or "", digest(t), len((t or "").encode())) for i, _, t in ROWS), key=key)
    assert {r.source_id: r.uri for r in crawl}[6] == "x%0D%0Ay" and {r.source_id: r.uri for r in crawl}[4] is None
    ids = {r.record_id: r for r in slim}
    for r in slim:
        if r.record_type == "revisit":
            assert r.payload is None and ids[r.refers_to].source_id == r.original_id
            assert ids[r.refers_to].payload_digest == r.payload_digest
    assert sorted(((r.source_id, r.record_type, r.original_id, r.payload_bytes) for r in slim), key=key) == sorted([
        (1, "response", None, 4), (1, "response", None, 4), (3, "revisit", 1, 4), (None, "revisit", 1, 4),
        (2, "response", None, len(MARK)), (4, "response", None, 0), (5, "revisit", 4, 0), (6, "response", None, 20),
        (7, "response", None, 4), (8, "response", None, 100_000)], key=key)


def test_small_payloads_stay_and_an_empty_table(spark):
    _, slim = through(spark, ROWS, min_bytes=4)
    assert {r.record_type for r in slim if r.payload_bytes < 4} == {"response"}
    assert sum(r.record_type == "revisit" for r in slim) == 2
    assert through(spark, []) == ([], [])


def test_files_are_bounded_and_records_have_ids_of_their_own(spark):
    pages = spark.range(400).selectExpr(
        "CAST(id % 100 AS LONG) AS page_id", "'u' AS url",
        "CASE WHEN id % 100 IN (3, 98) THEN repeat('é\r\n\r\n', 30000) ELSE repeat('z', CAST(id % 7 AS INT)) END AS html",
        "id AS file", "'v' AS value").coalesce(2)
    path = fresh_path(spark, "bounded")
    warc.write(warc.captured(pages), path, file_bytes=20_000)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).collect()
    rows = [[*warc.parsed(gzip.open(io.BytesIO(f.content)))] for f in files]
    sizes = [len(gzip.decompress(f.content)) for f in files]
    assert all(size <= 20_000 or len(r) == 1 for size, r in zip(sizes, rows)) and sum(len(r) == 1 for r in rows) >= 8
    assert len({x[2] for r in rows for x in r}) == 400 == sum(map(len, rows))
    back = warc.read(spark, path)
    assert back.columns == warc.read(spark, path).drop("file").columns and back.count() == 400
    assert back.filter("payload_bytes = 180000").count() == 8
