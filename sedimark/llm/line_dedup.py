"""Line deduplication by pairwise alignment of documents that share rare line hashes.

A passage is a run of consecutive lines of at least ``least_chars`` characters in
all; blank lines neither count nor break it.

Documents that overlap are found through hashes of their shortest passages: from
each line the shortest run onward and the shortest run back that has
``least_chars`` characters (a long line is its own). A hash is rare when at most
``RARE`` rows hold it; a document is paired with the first holder of each of its
rare hashes, so a group of copies makes a pair a document and not all pairs.

The line sequences of a pair, whole, are aligned with patience diff. Each aligned
place is extended to the common block around it, and blocks of ``least_chars``
characters go from the later document. Lines whose block is shorter anchor nothing
from then on, and what is left of the later document is aligned with the earlier
one again, as passages may stand in another order, until nothing aligns or after
``ROUNDS`` rounds. Patience diff can't tell which occurrence of a repeated line meets
which: passages with a line that occurs twice on a side (and, after the last round,
those that are left) are compared run by run inside the pair. A rare passage is
deleted in no other way.

Frequent hashes (a licence, a footer) make no pairs: their runs go from all but
their first holder by one join on the hash. ``n_aligned`` and ``n_frequent`` tell how
many lines went in which way; a line of both kinds counts as aligned.

Defined cases: a null text has no lines and stays null; a blank line goes when the
lines before and after it go, and when nothing else is left of the document; rows
that share a doc_id are documents of their own, none of them earlier than the
other, and rows alike in doc_id and text lose the same lines; rows without a doc_id
keep all lines; a document whose every line goes keeps an empty text; an empty
table gives no row; very long texts are hashed whole; columns of the input called
places, n_aligned or n_frequent are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from hashlib import blake2b
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import lean, materialise, table

LEAST_CHARS = 40
#: So many rows at most hold a rare hash.
RARE = 32
#: Rounds of alignment of one pair.
ROUNDS = 8


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs, sorted by their first places, whose second places increase too."""
    ends: list[int] = []
    chain: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        back[n] = chain[at - 1] if at else -1
        if at == len(ends):
            ends.append(j)
            chain.append(n)
        else:
            ends[at], chain[at] = j, n
    out, n = [], chain[-1] if chain else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _anchors(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of elements that occur once in a and once in b, as the longest chain that increases on both sides."""
    in_a, in_b = Counter(a), Counter(b)
    at = {x: j for j, x in enumerate(b) if in_b[x] == 1}
    return _chain([(i, at[x]) for i, x in enumerate(a) if in_a[x] == 1 and x in at])


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal elements, increasing on both sides."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        found = _anchors(a[a0:a1], b[b0:b1])
        if found:
            at_a, at_b = a0, b0
            for i, j in found:
                todo.append((at_a, a0 + i, at_b, b0 + j))
                out.append((a0 + i, b0 + j))
                at_a, at_b = a0 + i + 1, b0 + j + 1
            todo.append((at_a, a1, at_b, b1))
    return sorted(out)


def _block(earlier: list[int], later: list[int], i: int, j: int) -> tuple[int, int, int]:
    """(first place, end) in ``later`` of the common block around the equal lines i and j, and its shift to ``earlier``."""
    start, end = j, j + 1
    while start > 0 and i - (j - start) > 0 and later[start - 1] == earlier[i - (j - start) - 1]:
        start -= 1
    while end < len(later) and i + (end - j) < len(earlier) and later[end] == earlier[i + (end - j)]:
        end += 1
    return start, end, i - j


def common_blocks(earlier: list[tuple[int, int]], later: list[tuple[int, int]], chars: dict[int, int], least_chars: int) -> list[int]:
    """Places to delete in the later document. Sides are all its lines as (place, hash); chars is each hash's length."""
    places, earlier, later = [p for p, _ in later], [x for _, x in earlier], [x for _, x in later]
    return [places[j] for j in _common(earlier, later, [chars[x] for x in later], least_chars)]


def _common(earlier: list[int], later: list[int], sizes: list[int], least_chars: int) -> list[int]:
    """Indices of ``later`` in the blocks that it has in common with ``earlier``."""
    shared, chars = set(earlier) & set(later), [0, *accumulate(sizes)]
    own = [(i, x) for i, x in enumerate(earlier) if x in shared]
    gone: set[int] = set()
    idle: set[int] = set()  # places whose block was too short, which anchor nothing any more
    for _ in range(ROUNDS):
        rest = [(j, x) for j, x in enumerate(later) if x in shared and j not in gone and j not in idle]
        aligned = patience([x for _, x in own], [x for _, x in rest])
        if not aligned:
            repeated = {x for side in (earlier, later) for x, n in Counter(side).items() if n > 1}
            return sorted(gone | _common_runs(earlier, later, sizes, least_chars, repeated & shared))
        covered = (-1, -1, 0)
        for a, b in aligned:
            i, j = own[a][0], rest[b][0]
            if not (covered[0] <= j < covered[1] and i - j == covered[2]):  # else in the block of the place before
                covered = _block(earlier, later, i, j)
            start, end, _ = covered
            if chars[end] - chars[start] >= least_chars:
                gone.update(range(start, end))
            else:
                idle.add(j)
    return sorted(gone | _common_runs(earlier, later, sizes, least_chars, shared))


def _common_runs(earlier: list[int], later: list[int], sizes: list[int], least_chars: int, through: set[int]) -> set[int]:
    """Places of ``later`` in runs of enough characters that stand in ``earlier`` and hold an element of ``through``."""
    if not through:
        return set()
    size_of = dict(zip(later, sizes, strict=True))
    there = {tuple(earlier[a:b]) for a, b in shortest_runs([size_of.get(x, least_chars) for x in earlier], least_chars)}
    runs = [(a, b) for a, b in shortest_runs(sizes, least_chars) if not through.isdisjoint(later[a:b])]
    return {p for a, b in runs if tuple(later[a:b]) in there for p in range(a, b)}


def shortest_runs(sizes: list[int], least_chars: int) -> set[tuple[int, int]]:
    """(first, end) of the shortest run of enough characters onward from each line, and back from each."""
    n, found = len(sizes), set()
    end = size = 0
    for at in range(n):  # onward
        while end < n and size < least_chars:
            size += sizes[end]
            end += 1
        if size < least_chars:
            break
        found.add((at, end))
        size -= sizes[at]
    start, size = n, 0
    for at in range(n, 0, -1):  # back
        while start > 0 and size < least_chars:
            start -= 1
            size += sizes[start]
        if size < least_chars:
            break
        found.add((start, at))
        size -= sizes[at - 1]
    return found


class Lines:
    """The lines of a text that aren't blank: place, size and digest of each."""

    def __init__(self, text: str) -> None:
        self.places, self.sizes, self.digests = [], [], []
        for i, line in enumerate(text.split("\n")):
            line = line.strip(" ")
            if line:
                self.places.append(i)
                self.sizes.append(len(line))
                self.digests.append(blake2b(line.encode(), digest_size=8).digest())

    def hashes(self) -> list[int]:
        return [int.from_bytes(d, "little", signed=True) for d in self.digests]

    def runs(self, least_chars: int = LEAST_CHARS) -> dict[int, list[tuple[int, int]]]:
        """The hash of each shortest run of enough characters, and the first and last places of its lines."""
        places, digests = self.places, self.digests
        out: dict[int, list[tuple[int, int]]] = {}
        for a, b in shortest_runs(self.sizes, least_chars):
            key = digests[a] if b == a + 1 else blake2b(b"".join(digests[a:b]), digest_size=8).digest()
            out.setdefault(int.from_bytes(key, "little", signed=True), []).append((places[a], places[b - 1]))
        return out


#: A row of a text's run, or (hash is null) of its whole sequence of lines.
FOUND = "doc_id long, text_key long, hash long, ranges array<int>, lines array<long>, sizes array<int>"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]


def lines_of(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Each text's runs, ranges being first and last places in turn, and its sequence of lines, ranges being their places. Rows of one doc_id are told apart by text_key."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = Lines(text)
                rows.append((doc_id, key, None, lines.places, lines.hashes(), lines.sizes))
                rows += [(doc_id, key, h, [p for r in x for p in r], None, None) for h, x in lines.runs(least_chars).items()]
            columns = zip(*rows, strict=True) if rows else [()] * len(KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], [f.split()[0] for f in FOUND.split(", ")])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), text.alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(lean(run), FOUND)


def aligned(shared: DataFrame, found: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, text_key, places) of the blocks that each document has in common with the first holders of its rare hashes."""
    pairs = shared.where(F.col("df") <= RARE).select("doc_id", "text_key", "owner", "owner_key").distinct()
    whole = materialise(found.where("hash is null").dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", "ranges", "lines", "sizes"), "sequences")
    earlier = whole.select(F.col("doc_id").alias("owner"), F.col("text_key").alias("owner_key"), F.col("lines").alias("earlier"))
    both = materialise(pairs, "pairs").join(whole.hint("merge"), ["doc_id", "text_key"]).join(earlier.hint("merge"), ["owner", "owner_key"])

    def run(batches):
        for batch in batches:
            ids, keys, out = [], [], []
            for doc_id, key, places, lines, sizes, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks = common_blocks(list(enumerate(other)), list(enumerate(lines)), dict(zip(lines, sizes, strict=True)), least_chars)
                if blocks:
                    ids.append(doc_id)
                    keys.append(key)
                    # blank lines between two lines of a block go too
                    out.append([p for a, b in zip(blocks, [*blocks[1:], -1]) for p in (range(places[a], places[b]) if b == a + 1 else (places[a],))])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "text_key", "places"])

    return both.select("doc_id", "text_key", "ranges", "lines", "sizes", "earlier").mapInArrow(lean(run), "doc_id long, text_key long, places array<int>")


def deletions(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, text_key, places, n_aligned, n_frequent) of the lines that go, and how many of them go by alignment and by frequent hashes; texts that keep all have no row."""
    found = materialise(lines_of(docs, least_chars), "lines")
    runs = found.where("hash is not null").select("doc_id", "text_key", "hash", "ranges")
    first = F.min(F.struct("doc_id", "text_key"))
    owners = runs.groupBy("hash").agg(first.alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("df")).where("last > first.doc_id")
    # a table of its own, so that the join on a frequent hash can be split
    owners = materialise(owners.select("hash", F.col("first.doc_id").alias("owner"), F.col("first.text_key").alias("owner_key"), "df"), "owners")
    shared = materialise(runs.join(owners.hint("merge"), "hash").where("doc_id > owner"), "shared")
    places = F.flatten(F.transform(F.sequence(F.lit(0), F.size("ranges") - 2, F.lit(2)), lambda i: F.sequence(F.get(F.col("ranges"), i), F.get(F.col("ranges"), i + 1))))
    none = F.array().cast("array<int>")
    frequent = shared.where(F.col("df") > RARE).select("doc_id", "text_key", none.alias("aligned"), places.alias("frequent"))
    by_pairs = aligned(shared, found, least_chars).select("doc_id", "text_key", F.col("places").alias("aligned"), none.alias("frequent"))
    every = frequent.unionByName(by_pairs).groupBy("doc_id", "text_key").agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("aligned", "frequent")))
    return every.select("doc_id", "text_key", F.sort_array(F.array_union("aligned", "frequent")).alias("places"), F.size("aligned").alias("n_aligned"), F.size(F.array_except("frequent", "aligned")).alias("n_frequent"))


LOST = ["places", "n_aligned", "n_frequent"]


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with the lines gone, n_chars brought up to date where it exists, ``places`` (null: nothing went), ``n_aligned`` and ``n_frequent``."""
    gone = materialise(deletions(docs, least_chars), "deletions").select(F.col("doc_id").alias("gone id"), F.col("text_key").alias("gone key"), *LOST)
    names = [*(c for c in docs.columns if c.lower() not in LOST), *LOST]
    own = docs.select(*(F.col(f"`{c}`") for c in names[: -len(LOST)]))
    same = (own["doc_id"].cast("long") == gone["gone id"]) & (F.xxhash64(own["text"].cast("string")) == gone["gone key"])
    joined = own.join(gone.hint("merge"), same, "left").select(*(F.col(f"`{c}`") for c in names))

    def run(batches):
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts, gone = columns["text"].to_pylist(), columns["places"].to_pylist()
            for i, places in enumerate(gone):
                if places:
                    away, own = set(places), texts[i].split("\n")
                    filled = [n for n, x in enumerate(own) if x.strip(" ")]
                    away |= {p for a, b in zip(filled, filled[1:]) if b > a + 1 and a in away and b in away for p in range(a + 1, b)}
                    gone[i] = sorted(away)
                    left = [x for n, x in enumerate(own) if n not in away]
                    if not any(x.strip(" ") for x in left):
                        left, gone[i] = [], list(range(len(own)))
                    texts[i] = "\n".join(left)
            columns["places"] = pa.array(gone, columns["places"].type)
            columns["text"] = pa.array(texts, columns["text"].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t or "") for t in texts], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=pa.schema([pa.field(n, columns[n].type) for n in names]))

    return joined.mapInArrow(lean(run), joined.schema)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its number of lines, the places of those deleted, and the digest of what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = dedup_lines(docs.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0))))
    return left.select("doc_id", "n_lines", F.coalesce(F.size("places"), F.lit(0)).alias("n_deleted"), *(F.coalesce(c, F.lit(0)).alias(c) for c in LOST[1:]), F.coalesce("places", F.array().cast("array<int>")).alias("deleted"), F.length("text").alias("chars_left"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
