"""Exact deduplication with a cuckoo-filter index of live digests.

An ``Index`` is a cuckoo filter over 16-bit fingerprints beside the content that
it stands for: for each live digest the normalised text (packed), the row that is
kept and the number of rows. A row whose fingerprint isn't in the filter is new
for certain. A hit is only a hint, and is verified against the stored content byte
by byte. When an insertion finds no place, the table is doubled and filled anew
from the stored keys. What the filter buys is a few bytes a key that answer most
rows, so content is looked up, and unpacked, for hits alone.

On Spark the index is used twice, each time with bounded content. Each worker
keeps one index over all that it reads: a text seen again only moves its row
count, and when the content exceeds ``most_bytes`` the texts that were hit longest
ago leave the worker and their digests are deleted from the filter. So a text with
a third of all rows stays, and leaves a worker once. Survivors are dealt out and
sorted by the first bits of their digest; a task goes through these buckets in
order, and an index is closed at a bucket's end once it holds ``most_bytes``, so
memory depends neither on the input nor on the number of partitions. The groups
found are joined back to the (doc_id, digest) pairs; that join moves no text, and
its hot keys are split by adaptive execution.

Defined cases: a null text is an empty one; texts are equal when identical after
lower-casing A-Z; of equal texts the row with the largest doc_id stays, where a
null doc_id is smaller than any other; rows that share even the doc_id that stays
are each reported as kept; an empty table gives no row; texts of any length are
compared whole; other columns of the input are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import shuffle_partitions, table


def normalise(text: bytes | None) -> bytes:
    """``bytes.lower`` changes A-Z alone."""
    return (text or b"").lower()


class CuckooFilter:
    """Fingerprints of 16 bits in slots of four, two places for each key; supports insertion, lookup and deletion."""

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int = 64) -> None:
        self.mask = 1
        while (self.mask + 1) * self.SLOTS < capacity:
            self.mask = self.mask * 2 + 1
        self.table: list[list[int]] = [[] for _ in range(self.mask + 1)]

    def places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, first, self.other(first, mark)

    def other(self, place: int, mark: int) -> int:
        return place ^ (mark * 0x5BD1E995 & self.mask)

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        return mark in self.table[a] or mark in self.table[b]

    def insert(self, digest: bytes) -> bool:
        """False when there is no place; the filter is then to be rebuilt larger."""
        mark, a, b = self.places(digest)
        for place in (a, b):
            if len(self.table[place]) < self.SLOTS:
                self.table[place].append(mark)
                return True
        place = b
        for kick in range(self.KICKS):
            self.table[place].append(mark)
            mark = self.table[place].pop(kick % self.SLOTS)
            place = self.other(place, mark)
            if len(self.table[place]) < self.SLOTS:
                self.table[place].append(mark)
                return True
        return False

    def delete(self, digest: bytes) -> None:
        """Only for digests that were inserted."""
        mark, a, b = self.places(digest)
        self.table[a if mark in self.table[a] else b].remove(mark)


def larger(a: int | None, b: int | None) -> int | None:
    """The doc_id that stays; null is smaller than any."""
    return b if a is None or (b is not None and b > a) else a


class Index:
    """Live digests in a cuckoo filter, their content beside it, least recently hit first."""

    def __init__(self, capacity: int = 64) -> None:
        self.filter = CuckooFilter(capacity)
        self.content: dict[bytes, list[tuple[bytes, int | None, int]]] = {}  # digest: (packed text, doc_id that stays, rows)
        self.resized = self.bytes = 0

    def _insert(self, digest: bytes) -> None:
        if not self.filter.insert(digest):
            self.resize()

    def resize(self) -> None:
        """Double the table until all stored keys have a place."""
        size = (self.filter.mask + 1) * CuckooFilter.SLOTS
        while True:
            size *= 2
            self.resized += 1
            self.filter = CuckooFilter(size)
            if all(self.filter.insert(d) for d, held in self.content.items() for _ in held):
                return

    def add(self, digest: bytes, text: bytes, doc_id: int | None, rows: int = 1) -> bool:
        """Take a row in. True if its text is new here."""
        held = self.content.get(digest, []) if digest in self.filter else []
        for i, (packed, kept, n) in enumerate(held):
            if zlib.decompress(packed) == text:
                held[i] = (packed, larger(kept, doc_id), n + rows)
                self.content[digest] = self.content.pop(digest)  # to the end: the latest hit
                return False
        packed = zlib.compress(text, 1)
        self.content.setdefault(digest, []).append((packed, doc_id, rows))
        self.bytes += len(packed)
        self._insert(digest)
        return True

    def remove(self, digest: bytes, text: bytes) -> bool:
        """Delete a live text, if it is here."""
        held = self.content.get(digest, []) if digest in self.filter else []
        for i, (packed, _, _) in enumerate(held):
            if zlib.decompress(packed) == text:
                self._delete(digest, i)
                return True
        return False

    def _delete(self, digest: bytes, i: int) -> tuple[bytes, int | None, int]:
        self.filter.delete(digest)
        found = self.content[digest].pop(i)
        self.bytes -= len(found[0])
        if not self.content[digest]:
            del self.content[digest]
        return found

    def evict(self, most_bytes: int) -> Iterator[tuple[bytes, bytes, int | None, int]]:
        """(digest, packed text, doc_id, rows) of the texts that were hit longest ago, deleted until no more than so many bytes are held."""
        while self.content and self.bytes > most_bytes:
            digest = next(iter(self.content))
            yield (digest, *self._delete(digest, 0))


LOCAL = pa.schema([("bucket", pa.int32()), ("digest", pa.binary()), ("packed", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
GROUPS = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
#: Bits of a digest that name its bucket.
BUCKET_BITS = 24


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


def groups(docs: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """(digest, keep_id, group_size) of each distinct normalised text of ``docs`` (doc_id, text)."""

    def local(batches):
        index = Index()

        def leave(most: int):
            rows, size = [], 0
            for digest, packed, kept, n in index.evict(most):
                rows.append((int.from_bytes(digest[10:14], "big") >> 32 - BUCKET_BITS, digest, packed, kept, n))
                size += len(packed)
                if size > 8 << 20:
                    yield _rows(LOCAL, rows)
                    rows, size = [], 0
            yield _rows(LOCAL, rows)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = normalise(text)
                index.add(hashlib.sha256(text).digest(), text, doc_id)
                if index.bytes > most_bytes:
                    yield from leave(most_bytes // 2)
        yield from leave(-1)

    def in_buckets(batches):
        index, at = Index(), None

        def close():
            return _rows(GROUPS, [(d, k, m) for d, held in index.content.items() for _, k, m in held])

        for batch in batches:
            for bucket, digest, packed, kept, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at and index.bytes > most_bytes:
                    yield close()
                    index = Index()
                at = bucket
                index.add(digest, zlib.decompress(packed), kept, n)
        yield close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    dealt = rows.mapInArrow(local, "bucket int, digest binary, packed binary, keep_id long, group_size long")
    dealt = dealt.repartition(shuffle_partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(in_buckets, "digest binary, keep_id long, group_size long")


def assign(docs: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """Each row of ``docs`` with the row that stays for it."""

    def digests(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(normalise(t)).digest() for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "digest"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(digests, "doc_id long, digest binary")
    joined = rows.join(groups(docs, most_bytes).hint("merge"), "digest")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for its text."""
    return assign(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
