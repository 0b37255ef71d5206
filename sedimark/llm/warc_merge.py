"""WARC archives and their index by external merge.

``write`` makes one WARC record a row with Spark's text sink: the row is the
record up to its last byte, and the line separator is the two line ends that
close a record, so archives go to any file system that Spark knows, under its
commit protocol. They aren't packed, so a record's offset and length in the index
are what a range read needs. A worker begins a new archive when one has
``most_bytes``; a larger record has one of its own. ``read`` opens the archives,
walks the records by their Content-Length and leaves one index run for each
archive, sorted by URL key and time. ``merge`` deals the runs out by ranges of
(URL key, time, page) and merges the parts of all runs that meet in a range with a
loser tree, so the ranges, one after the other, are the globally ordered capture
history; ``place`` is a capture's place in it. A URL with a third of all captures
spreads over many ranges, since time and page are part of the key.

Which record a page's is, response or revisit, is decided over (page_id, digest)
rows; the pages themselves pass one shuffle only where they meet that decision.

Defined cases: a null page is an empty payload, a null URL an empty one; records
with payloads of under ``least`` bytes are all responses; rows that share the
largest page_id and the payload are all responses; a null page_id comes before all
others, is dated to the first second of 1970 and is null again in the index; an
empty table gives no row; line ends in a URL are escaped in its header; a payload
may hold anything, record headers included; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.llm.common import fresh_path, materialise, shuffles_freed, table

RECORD_END = "\r\n\r\n"
#: Bounds the size of an archive and with it the memory of a reader.
MOST_BYTES = 32 << 20
#: Index rows that one merging task holds.
ROWS_A_RANGE = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def classify(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, payload_digest, payload_bytes and the page_id that the record refers to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1(F.col("payload").cast("binary"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # one row a text that occurs twice, in a table of its own: few rows, and a join that adaptive execution can split
    known = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = materialise(known, "captures")
    joined = rows.join(known, "payload_digest", "left")
    later = F.col("kept").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("kept"))) & (F.col("payload_bytes") >= least)
    return joined.withColumn("refers_to", F.when(later, F.col("kept"))).drop("kept")


def record(rows: DataFrame) -> DataFrame:
    """The text of each row's WARC record, without what closes it."""
    end = F.lit("\r\n")

    def name(page):
        return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))

    # a date in UTC, whatever the session's time zone
    seconds = F.coalesce("page_id", F.lit(0))
    clock = F.pmod(seconds, F.lit(86_400))
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int")), "yyyy-MM-dd")
    stamp = F.concat(date, F.format_string("T%02d:%02d:%02dZ", F.floor(clock / 3600), F.floor(clock / 60) % 60, clock % 60))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit(RECORD_END))
    common = F.concat(
        F.lit("WARC-Record-ID: "), name(F.col("page_id")), end,
        F.lit("WARC-Date: "), stamp, end,
        F.lit("WARC-Target-URI: "), F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), end,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), end,
        F.lit("WARC-Payload-Length: "), F.col("payload_bytes"), end,
        F.lit("Content-Type: application/http; msgtype=response"), end,
    )
    response = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\n"), common, F.lit("Content-Length: "), F.octet_length(http) + F.col("payload_bytes"), F.lit(RECORD_END), http, F.col("payload"))
    revisit = F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("refers_to")), end, common, F.lit("Content-Length: "), F.octet_length(http), F.lit(RECORD_END), http)
    return rows.select(F.when(F.col("refers_to").isNull(), response).otherwise(revisit).alias("value"))


def write(rows: DataFrame, path: str, most_bytes: int = MOST_BYTES) -> None:
    """Archives of classified rows under ``path``, in folders by their place among a worker's archives."""

    def number(batches):
        archive = held = 0
        for batch in batches:
            archives = []
            for size in pc.binary_length(batch.column(0)).to_pylist():
                if held and held + size > most_bytes:
                    archive, held = archive + 1, 0
                held += size + len(RECORD_END)
                archives.append(archive)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(archives, pa.int32())], ["value", "archive"])

    dealt = record(rows).mapInArrow(number, "value string, archive int")
    with shuffles_freed(rows.sparkSession):
        dealt.write.partitionBy("archive").option("lineSep", RECORD_END).text(path)


def url_key(url: str) -> str:
    """The URL with its host's labels in reverse order, lower case, without scheme, user, port 80/443 and fragment: captures of a site stand together."""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    labels = ",".join(reversed(host.split(".")))
    return labels + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """(offset, length, headers, block) of each record of an archive."""
    view, at = memoryview(data), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        first, *lines = data[at : max(end, at)].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record starts at {at}")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        close = end + 4 + int(headers["content-length"])
        if data[close : close + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} isn't closed")
        yield at, close + 4 - at, headers, view[end + 4 : close]
        at = close + 4


INDEX = "url_key string, captured string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, record_offset long, record_length long"
SCHEMA = pa.schema([(c.split()[0], pa.string() if c.split()[1] == "string" else pa.int64()) for c in INDEX.split(", ")])
ORDER = ["url_key", "captured", "page_id"]


def order(row: tuple) -> tuple:
    """URL key, time and page, a null one first; then the record's place."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def _batch(rows, schema=SCHEMA):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


def read(spark, path: str) -> DataFrame:
    """One index run for each archive under ``path``. Payload lengths and digests of responses come from their bytes and must be what the header says."""

    def number(name: str | None):
        tail = name.strip("<>").rpartition(":")[2] if name else ""
        return int(tail) if tail else None

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1), strict=True):
                archive, rows = archive.as_py(), []
                for offset, length, headers, block in records(content.as_py()):
                    digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["warc-payload-length"])
                    if headers["warc-type"] == "response":
                        payload = block[bytes(block[:1024]).index(b"\r\n\r\n") + 4 :]
                        if (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"the payload at {offset} of {archive} isn't what its header says")
                    rows.append((url_key(headers["warc-target-uri"]), headers["warc-date"], number(headers["warc-record-id"]), headers["warc-type"], number(headers.get("warc-refers-to")), size, digest, archive, offset, length))
                yield _batch(sorted(rows, key=order))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return files.select(F.regexp_extract("path", "[^/]+/[^/]+$", 0).alias("archive"), "content").mapInArrow(run, INDEX)


class LoserTree:
    """K-way merge: each inner node holds the loser of its match, so the next row costs one path of matches."""

    def __init__(self, runs: list[Iterator], key) -> None:
        self.runs, self.key = runs, key
        self.heads = [next(r, None) for r in runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * max(1, len(runs))
        self.winner = -1
        for i in range(len(runs)):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and self.keys[a] is not None
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, i: int) -> None:
        node = (len(self.runs) + i) // 2
        while node:
            other = self.losers[node]
            if other < 0:  # the first to come waits
                self.losers[node] = i
                return
            if self._before(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self):
        while self.runs and self.keys[self.winner] is not None:
            i = self.winner
            yield self.heads[i]
            head = self.heads[i] = next(self.runs[i], None)
            self.keys[i] = None if head is None else self.key(head)
            self._play(i)


def merge(index: DataFrame, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """All runs of ``index`` in global order, ``place`` counting from 0."""
    index = materialise(index, "index-runs")
    ranges = max(1, -(-index.count() // rows_a_range))
    schema = SCHEMA.append(pa.field("range_no", pa.int64())).append(pa.field("position", pa.int64()))

    def run(batches):
        by_run: dict[str, list] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_run.setdefault(row[7], []).append(row)
        out, no = [], TaskContext.get().partitionId()
        for position, row in enumerate(LoserTree([iter(r) for r in by_run.values()], order)):
            out.append((*row, no, position))
            if len(out) == 10_000:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)

    dealt = index.repartitionByRange(ranges, *ORDER, "archive", "record_offset").sortWithinPartitions("archive", *ORDER, "record_offset")
    merged = materialise(dealt.mapInArrow(run, f"{INDEX}, range_no long, position long"), "index-ranges")
    # a range's first place: one row a range, in one window
    before = F.coalesce(F.sum("n").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = merged.groupBy("range_no").agg(F.count("*").alias("n")).select("range_no", before.alias("first"))
    return merged.join(starts, "range_no").withColumn("place", F.col("first") + F.col("position")).drop("range_no", "position", "first")


def op5_warc_merge(spark, sf_dir: str) -> DataFrame:
    """All pages written as WARC, read back, and their merged index."""
    path = fresh_path(spark, "warc")
    write(classify(table(spark, sf_dir, "pages")), path)
    return merge(read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "captured", "url_key", "place")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, lower(trim(coalesce(url, ''))) AS u FROM pages),
     q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS kept,
             strftime(to_timestamp(page_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS captured,
             array_to_string(list_reverse(string_split(regexp_extract(u, '^[a-z]+://([^/:?#]+)', 1), '.')), ',')
               || regexp_replace(regexp_extract(u, '^[a-z]+://[^/:?#]+(:\d+)?', 1), '^:(80|443)$', '') || ')'
               || coalesce(nullif(regexp_extract(u, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), ''), '/') || regexp_extract(u, '(\?[^#]+)', 1) AS url_key FROM p)
SELECT page_id, payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < kept THEN kept END AS refers_to,
       captured, url_key, row_number() OVER (ORDER BY encode(url_key), captured, page_id) - 1 AS place
FROM q
"""
