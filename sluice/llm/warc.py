"""Web archives: writing, reading back, and an external merge of their indexes."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote_plus, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.shared import cut, scratch, ship, stored

#: Payloads smaller than this are always written in full.
MIN_REVISIT_BYTES = 100
#: Index entries that a task merges, on average.
ENTRIES = 200_000
#: Payload bytes of an archive on average; readers hold one archive at a time.
ARCHIVE_BYTES = 32 << 20
END = "\r\n"
BLANK_LINE = b"\r\n\r\n"
INDEX = "urlkey string, captured string, id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, archive string, offset long, length long"


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Add ``refers_to`` to rows of ``id``, ``payload_bytes`` and ``payload_digest``: the smallest id with an equal payload, else null.

    Only ids and digests are grouped and joined, with partial aggregates; the
    few rows that refer to another are a stored table.
    """
    keys = pages.where(F.col("id").isNotNull() & (F.col("payload_bytes") >= min_bytes)).select("id", "payload_digest")
    first = keys.groupBy("payload_digest").agg(F.min("id").alias("refers_to"), F.max("id").alias("last")).where("refers_to < last").select("payload_digest", "refers_to")
    again = stored(keys.join(first, "payload_digest").where("id <> refers_to").distinct(), "warc-revisits")
    return pages.join(again, ["id", "payload_digest"], "left")


def _urn(id_: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.url_encode(id_.cast("string")), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line; nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write ``id, url, html, captured`` rows as gzipped archives of WARC records.

    Rows are dealt to as many archives as their bytes need, by a hash that a
    row number of the scan goes into, so that equal rows spread as well, and
    sorted within each by URL and time.
    """
    pages = pages.withColumn("row", F.monotonically_increasing_id())
    sized = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2("html", 256))
    total = sized.agg(F.sum("payload_bytes").alias("b")).first()["b"] or 0
    rows = with_revisits(sized, min_bytes).repartition(max(1, -(-total // ARCHIVE_BYTES)), F.xxhash64("id", "url", "payload_digest", "row"))
    answer = F.concat(F.lit(END.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", ""])), _field("Content-Length", F.col("payload_bytes").cast("string")), F.lit(END), F.col("html"))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(answer)
    record = F.concat(
        F.lit("WARC/1.1" + END),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", F.coalesce(_urn(F.col("id")), F.lit("<urn:page>"))),
        _field("WARC-Date", F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _field("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _field("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(_field("WARC-Refers-To", _urn(F.col("refers_to"))), _field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
        block,
    )
    rows.sortWithinPartitions("url", "captured", "id").select(record.alias("value")).write.option("lineSep", 2 * END).option("compression", "gzip").text(path)


def records(raw: bytes) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """Offset, length, header and block of each record of an archive."""
    view, at = memoryview(raw), 0
    while at < len(raw):
        begin = raw.index(BLANK_LINE, at) + len(BLANK_LINE)
        lines = raw[at:begin].decode().strip().split(END)
        header = dict(line.split(": ", 1) for line in lines[1:])
        stop = begin + int(header["Content-Length"])
        if lines[0] != "WARC/1.1" or raw[stop : stop + len(BLANK_LINE)] != BLANK_LINE:
            raise ValueError(f"no whole record at byte {at}")
        yield at, stop + len(BLANK_LINE) - at, header, view[begin:stop]
        at = stop + len(BLANK_LINE)


def url_key(url: str | None) -> str:
    """Sort key of a URL: the host's labels from the last to the first, then path and query, in lower case."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").lower()
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _page(urn: str | None) -> str | None:
    return unquote_plus(urn[len("<urn:page:") : -1]) if urn and urn.startswith("<urn:page:") else None


def entry(archive: str, at: int, length: int, header: dict[str, str], block: memoryview) -> tuple:
    """Index entry of a record, with the digest of the payload that was read."""
    size, digest = int(header["X-Payload-Length"]), header["WARC-Payload-Digest"].removeprefix("sha256:")
    if header["WARC-Type"] == "response":
        payload = block[bytes(block[:4096]).index(BLANK_LINE) + len(BLANK_LINE) :]
        if (size, digest) != (len(payload), hashlib.sha256(payload).hexdigest()):
            raise ValueError(f"{archive}: the record at byte {at} isn't what its header says")
    url = header.get("WARC-Target-URI")
    return (url_key(url), header.get("WARC-Date"), _page(header["WARC-Record-ID"]), url, header["WARC-Type"], size, digest, _page(header.get("WARC-Refers-To")), archive, at, length)


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [(n, pa.int64() if k == "long" else pa.string()) for n, k in (f.split(" ") for f in INDEX.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Read archives back: an index entry for each record, after its payload's digest was checked."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1), strict=True):
                name = archive.as_py()
                if rows := [entry(name, *r) for r in records(gzip.decompress(content.as_buffer()))]:
                    yield _arrow(sorted(rows, key=_order))

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content").mapInArrow(run, INDEX)


def _order(entry_: tuple) -> tuple:
    """URL key and time, then id as text (null first); archive and offset settle ties."""
    return (entry_[0], entry_[1] or "", entry_[2] or "", entry_[8], entry_[9])


class LoserTree:
    """Merge sorted runs: a tree of losers whose root names the run with the smallest head.

    After the winner's run moves on, only the path from its leaf to the root
    is played again.
    """

    def __init__(self, runs: Iterable[Iterator], key) -> None:
        self.runs, self.key = [iter(r) for r in runs], key
        self.size = max(1, len(self.runs))
        self.heads = [self._next(r) for r in range(len(self.runs))]
        self.losers = [-1] * self.size
        self.winner = self._play(1) if self.runs else -1

    def _next(self, run: int):
        """Key and value of a run's next entry; a key above all others at its end."""
        for value in self.runs[run]:
            return (0, self.key(value), run), value
        return (1, None, run), None

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a][0], self.heads[b][0]
        return (x[0], x[2]) < (y[0], y[2]) if x[0] or y[0] else x < y

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        first, second = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = second
        return first

    def __iter__(self):
        while self.winner >= 0 and not self.heads[self.winner][0][0]:
            yield self.heads[self.winner][1]
            run = self.winner
            self.heads[run] = self._next(run)
            node = (run + self.size) // 2
            while node:
                if self._less(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def _merge(batches):
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs.setdefault(row[8], []).append(row)
    waiting = []
    for row in LoserTree(runs.values(), _order):
        waiting.append(row)
        if len(waiting) == 4096:
            yield _arrow(waiting)
            waiting = []
    if waiting:
        yield _arrow(waiting)


def merge_index(index: DataFrame) -> DataFrame:
    """Merge the archives' sorted runs into one globally ordered capture history.

    Tasks take ranges of the order (URL key, time, id), cut by Spark from a
    sample, so a host or page with very many captures spreads over several
    tasks; there are as many ranges as the entries need at ``ENTRIES`` each.
    Within a task the runs come one after the other, each sorted, and
    a loser tree merges them; it holds its range of index entries, not pages.
    """
    ship(index.sparkSession)
    order = ["urlkey", "captured", "id", "archive", "offset"]
    runs = cut(index)
    return runs.repartitionByRange(max(1, -(-runs.count() // ENTRIES)), *order).sortWithinPartitions("archive", *order[:3], "offset").mapInArrow(_merge, INDEX)


def archive_pages(pages: DataFrame, path: str | None = None, captured: Column | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write pages as WARC archives, read them back, and return the merged index.

    Each page becomes a record whose payload is its HTML in UTF-8.  Of pages
    with equal payloads of at least ``min_bytes`` bytes, the one with the
    smallest id is a response record and the others are revisit records that
    refer to it.  ``path`` is a folder that all executors share (by default a
    new one in the shared folder), ``captured`` the time of capture.

    Returns the id column and the rest of ``INDEX``, in the global order of
    URL key, time and id (as text).  Cases: null HTML is an empty payload; a
    null id is always a response; rows with the same smallest id are all
    responses; a null URL has no target header and sorts as an empty host;
    blanks and control characters in a URL are written as ``%20``; payloads
    may hold any text, record headers included; other columns are not
    returned; no rows give no rows.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    time = F.lit("2020-01-01 00:00:00").cast("timestamp") if captured is None else captured
    write_archives(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), time.alias("captured")), path, min_bytes)
    kind = pages.schema[id_col].dataType
    index = merge_index(read_index(spark, path))
    return index.withColumn("refers_to", F.col("refers_to").cast(kind)).select(F.col("id").cast(kind).alias(id_col), *[c for c in index.columns if c != "id"])
