"""Media columns: interleaved document sequences with payloads resolved by digest.

``sequences`` turns each page into ordered items, text blocks and media references,
each with its position and (for media) its caption: all captions of the figure
around it, wherever in the figure they stand, else its alt text. ``store`` writes
the payloads as media rows, ``features`` reads them back. ``resolve`` joins
references to what was stored, so positions and captions stay beside the payload's
values, and ``interleave`` does so for whole sequences. Payload bytes are read back
from the store and never pass a shuffle: the join moves digests.

The query makes a page of each document, its lines as paragraphs around a figure
that refers to the payload by digest, parses it and resolves it.

A payload is kept as an 8-bit greyscale PNG of 576 samples a row (lossless); its
last row is filled with 255.

Defined cases: a null or empty text is a payload of one row of 255; a null page
has no items; a head that isn't closed ends where its page's body must have begun;
a reference to nothing stored resolves to nulls; equal payloads are stored once a
batch and give one joined row a reference; rows that share an id are sequences of
their own; an empty table gives no row; a payload or page of any length is taken
whole; other columns of the input are left out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from sedimark.llm.common import fresh_path, materialise, table

WIDTH = 576
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
MEDIA = frozenset("audio embed img source video".split())
HIDDEN = frozenset("script style template title".split())
#: What may stand in a head; anything else ends it, closed or not.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())


class _Items(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.in_head = self.in_caption = False
        self.figures: list[tuple[int, list[str]]] = []  # of the open figures: the first item, captions

    def flush(self) -> None:
        text = "".join(self.text).strip()
        self.text.clear()
        if not text:
            return
        if self.in_caption and self.figures:
            self.figures[-1][1].append(text)
        else:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "ref": None, "caption": None})

    def end_head(self) -> None:
        if self.in_head:
            self.in_head, self.hidden = False, 0

    def end_figure(self) -> None:
        first, captions = self.figures.pop()
        for item in self.items[first:] if captions else ():
            if item["kind"] == "media" and "own" not in item:
                item["caption"], item["own"] = " ".join(captions), True

    def handle_starttag(self, tag, attrs):
        if tag == "head":
            self.in_head = True
        elif tag not in HEAD:
            self.end_head()
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BLOCKS or tag in MEDIA:
            self.flush()
        if tag == "figure":
            self.figures.append((len(self.items), []))
        elif tag == "figcaption":
            self.in_caption = True
        elif tag in MEDIA and not self.hidden:
            found = dict(attrs)
            if found.get("src"):
                self.items.append({"position": len(self.items), "kind": "media", "text": None, "ref": found["src"], "caption": found.get("alt")})

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag == "head":
            self.end_head()
        if tag in BLOCKS:
            self.flush()
        if tag == "figcaption":
            self.in_caption = False
        elif tag == "figure":
            self.in_caption = False
            if self.figures:
                self.end_figure()

    def handle_data(self, data):
        if self.in_head and not self.hidden and data.strip():
            self.end_head()
        if not self.hidden:
            self.text.append(data)


def parse_html(page: str | None) -> list[dict]:
    """Items of a page in order: position, kind ('text' or 'media'), text, ref, caption (the innermost figure's captions, else the alt text)."""
    parser = _Items()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    while parser.figures:
        parser.end_figure()
    for item in parser.items:
        item.pop("own", None)
    return parser.items


ITEM = StructType().add("position", "integer").add("kind", "string").add("text", "string").add("ref", "string").add("caption", "string")


def sequences(pages: DataFrame, id_column: str, html_column: str, others: list[str] | None = None) -> DataFrame:
    """(id, others, items) of each page."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
    kept = pages.select(F.col(id_column).cast("long").alias(id_column), *(others or []))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([parse_html(p) for p in batch.column(batch.num_columns - 1).to_pylist()], kind)], [*batch.schema.names[:-1], "items"])

    rows = pages.select(F.col(id_column).cast("long").alias(id_column), *(others or []), F.col(html_column).cast("string").alias("items"))
    return rows.mapInArrow(run, StructType([*kept.schema.fields]).add("items", ArrayType(ITEM)))


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b"\xff" * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))


def to_png(payload: bytes) -> bytes:
    """A greyscale PNG, 8 bits a sample, of rows of ``WIDTH``."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = rows
    chunks = ((b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(lines.tobytes(), 1)), (b"IEND", b""))
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in chunks)


def from_png(media: bytes) -> bytes:
    """The samples of a PNG that ``to_png`` made."""
    at, data = 8, b""
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            data += media[at + 8 : at + 8 + n]
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, WIDTH + 1)[:, 1:].tobytes()


def describe(payload: bytes) -> str:
    """Size, mean, deviation and a 16-step histogram of the samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    values = np.arange(256)
    mean = (counts * values).sum() / len(payload)
    deviation = max(0.0, (counts * values * values).sum() / len(payload) - mean * mean) ** 0.5
    return f"{WIDTH}x{len(payload) // WIDTH};mean={mean:.4f};std={deviation:.4f};hist=" + ",".join(map(str, counts.reshape(16, 16).sum(1)))


def store(docs: DataFrame, path: str) -> DataFrame:
    """Write the payloads of ``docs`` (text) as media rows (digest, media) under ``path`` and open what was written. Equal payloads of a batch are written once."""

    def run(batches):
        for batch in batches:
            rows, size = {}, 0
            for text in batch.column(0).to_pylist():
                payload = payload_of(text)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in rows:
                    rows[digest] = to_png(payload)
                    size += len(rows[digest])
                if size > 8 << 20:  # what is written already is held by name only
                    yield pa.RecordBatch.from_arrays([pa.array(rows.keys(), pa.string()), pa.array(rows.values(), pa.binary())], ["digest", "media"])
                    rows, size = {}, 0
            yield pa.RecordBatch.from_arrays([pa.array(rows.keys(), pa.string()), pa.array(rows.values(), pa.binary())], ["digest", "media"])

    docs.select(F.col("text").cast("string")).mapInArrow(run, "digest string, media binary").write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.schema("digest string, media binary").parquet(path)


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """One row for each digest, computed from the stored bytes."""

    def run(batches):
        for batch in batches:
            rows = []
            for digest, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload = from_png(stored)
                own = hashlib.sha256(payload).hexdigest()
                if own != digest:
                    raise ValueError(f"the stored bytes of {digest} have changed")
                rows.append((digest, len(payload), own, zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(payload)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in FEATURES.split(", ")])

    found = media.mapInArrow(run, FEATURES)
    return found.groupBy("digest").agg(*(F.min(c).alias(c) for c in found.columns[1:]))


def resolve(refs: DataFrame, found: DataFrame) -> DataFrame:
    """Each reference (any columns, with ``digest``) beside what its digest has; unresolved ones keep nulls."""
    return refs.join(found.hint("merge"), "digest", "left")


def interleave(found: DataFrame, media: DataFrame, id_column: str) -> DataFrame:
    """(id, items) of ``sequences`` with what each reference resolves to in ``media`` (digest, ...) beside it, in order."""
    rows = found.withColumn("sequence", F.monotonically_increasing_id()).select("sequence", id_column, F.explode_outer("items").alias("i"))
    rows = rows.withColumn("digest", F.regexp_extract("i.ref", "^sha256:(.*)$", 1))
    values = F.struct(*(F.col(c) for c in media.columns if c != "digest")).alias("media")
    whole = resolve(materialise(rows, "items"), media.select("digest", values))
    item = F.when(F.col("i").isNotNull(), F.struct("i.position", "i.kind", "i.text", "i.ref", "i.caption", "media"))
    return whole.groupBy("sequence", id_column).agg(F.sort_array(F.collect_list(item)).alias("items")).drop("sequence")


def pages_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, html) of each document (doc_id, text): its lines as paragraphs, and in their middle its payload as a figure by digest."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long")).withColumn("lines", F.split("text", "\n"))
    length = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / WIDTH)) * WIDTH
    digest = F.sha2(F.rpad(F.col("text").cast("binary"), length.cast("int"), F.lit(b"\xff")), 256)
    middle = F.ceil(F.size("lines") / 2).cast("int")

    def paragraphs(lines):
        escaped = F.transform(lines, lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))
        return F.concat(F.lit("<p>"), F.array_join(escaped, "</p><p>"), F.lit("</p>"))

    figure = F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('" alt=""><figcaption>'), F.col("n_bytes"), F.lit(" bytes</figcaption></figure>"))
    rest = F.slice("lines", middle + 1, F.size("lines"))
    page = F.concat(F.lit("<article>"), paragraphs(F.slice("lines", F.lit(1), middle)), figure, F.when(F.size(rest) > 0, paragraphs(rest)).otherwise(""), F.lit("</article>"))
    return rows.select("doc_id", "n_bytes", page.alias("html"))


def op4_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every document's payload, stored, referred to from a page, and resolved from that page's parsed sequence."""
    docs = table(spark, sf_dir, "documents")
    found = materialise(features(store(docs, fresh_path(spark, "media"))), "features")
    parsed = sequences(pages_of(docs), "doc_id", "html", ["n_bytes"])
    media = F.filter("items", lambda i: i["kind"] == "media")[0]
    refs = parsed.select("doc_id", "n_bytes", F.size("items").alias("n_items"), media["position"].alias("position"), media["caption"].alias("caption"), F.substring(media["ref"], 8, 64).alias("digest"))
    return resolve(refs, found).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_items", "position", "caption")
