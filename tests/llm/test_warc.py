"""Archives: round trip, revisits and the merged index."""

import hashlib
import random

from pyspark.sql import functions as F

from sluice.llm.shared import scratch
from sluice.llm.warc import LoserTree, archive_pages, records, url_key

SCHEMA = "page_id long, url string, html string, offset string"


def _brute(rows):
    payloads = [(i, (h or "").encode()) for i, _, h, _ in rows]
    home = {}
    for i, p in payloads:
        if i is not None and len(p) >= 100:
            home[p] = min(home.get(p, i), i)
    again = lambda i, p: i is not None and home.get(p, i) != i
    return sorted(((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again(i, p) else "response", home[p] if again(i, p) else None) for i, p in payloads), key=str)


def test_round_trip(spark):
    evil = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n\r\n\r\n" * 5
    same = "é" * 60
    rows = [(1, "http://a.b/c", evil), (2, "http://a.b/c\r\nX: 1", evil), (3, None, None), (4, "x", ""), (5, "http://[::1", same), (6, "https://www.A.com:8080/q?z=1#f", same), (7, "u", "short"), (8, "u", "short"), (None, "q", evil), (6, "dup", same), (5, "http://[::1", same), (9, "http://a.b/c", "z" * 3_000_000), (10, "", "y" * 99), (11, "", "y" * 99), (12, "", "y" * 100), (13, "", "y" * 100)]
    rows = [(*r, "x") for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    out = archive_pages(df, captured=F.timestamp_seconds(F.coalesce("page_id", F.lit(0)))).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=str) == _brute(rows)
    order = [(r["urlkey"], r["captured"] or "", "" if r["page_id"] is None else str(r["page_id"])) for r in out]
    assert order == sorted(order)


def test_archives_are_read_by_length(spark):
    path = scratch(spark, "warc-test")
    df = spark.createDataFrame([(1, "http://a/", "<p>one\r\n\r\n", "x"), (2, "http://b/", "two", "x")], SCHEMA)
    archive_pages(df, path)
    raw = b"".join(__import__("gzip").decompress(r["content"]) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect())
    found = list(records(raw))
    assert [h["WARC-Type"] for _, _, h, _ in found] == ["response"] * 2
    assert sorted(bytes(b).split(b"\r\n\r\n", 1)[1] for *_, b in found) == [b"<p>one\r\n\r\n", b"two"]


def test_loser_tree():
    rnd = random.Random(1)
    for k in range(12):
        runs = [sorted(rnd.randint(0, 40) for _ in range(rnd.randint(0, 9))) for _ in range(k)]
        assert list(LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert url_key("https://www.Example.com/A?b=C#d") == "com,example)/a?b=c"
    assert url_key("http://example.com:8080") == "com,example:8080)/"
    assert url_key(None) == ")/"


def test_no_rows(spark):
    assert archive_pages(spark.createDataFrame([], SCHEMA)).collect() == []
