"""Harmonic packing of token sequences into training sequences of a fixed capacity.

Lengths belong to reciprocal-capacity classes: class k holds what is longer than
capacity/(k+1) and not longer than capacity/k, and a bin of class k takes k
pieces. Documents may be cut, so each is cut where its pieces fill a class
exactly: whole capacities, then halves, quarters and so on down to ``smallest``
tokens (powers of two, k = 1, 2, 4, ...), and a tail shorter than that in the
class k = capacity // tail.

Each worker fills the bins of each class on its own while it reads its
documents: a bin is full after k pieces and leaves at once, so a worker holds
less than one open bin a class. Nothing is shuffled for full bins. What is left
in open bins at a worker's end (its number depends on the classes, not on the
data) goes through a second round of the same filling over groups of workers,
native windows on a few integers a piece, and the last open bins of a group share
sequences: powers of two in descending order meet every border of a sequence,
and tails go by their running sum.

Defined cases: a null or empty text is one piece with the closing id alone;
repeated rows are packed as often as they occur; an empty table gives no row;
very long texts become full pieces, one sequence each, and so do endless runs of
white space; rows with a null doc_id are packed like others; other columns of the
input, whatever their names, aren't carried on.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.llm.common import lean, materialise, table
from sedimark.llm.trie_bpe import SPACE, TrieBpe, byte_symbols

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker int, sequence_id long, offset long"
#: Sequence ids of the second round start here; those of workers are worker * 2^32 + bin.
SECOND = 1 << 60
#: So many workers share a second round.
WORKERS_A_GROUP = 256


def cuts(tokens: int, capacity: int = 1024, smallest: int = 32) -> list[int]:
    """Lengths of a document's pieces, longest first: at most log2(capacity / smallest) + 1 besides the full ones."""
    lengths = [capacity] * (tokens // capacity)
    rest, size = tokens % capacity, capacity // 2
    while size >= smallest:
        if rest >= size:
            lengths.append(size)
            rest -= size
        size //= 2
    return lengths + [rest] * (rest > 0)


class OpenBins:
    """The bins of one worker, one open bin for each class."""

    def __init__(self, worker: int, capacity: int) -> None:
        self.worker, self.capacity, self.bins = worker, capacity, 0
        self.open: dict[int, list[tuple]] = {}

    def add(self, piece: tuple) -> list[tuple]:
        """The rows of the bin that this piece fills, or none."""
        count = self.capacity // piece[2]
        members = self.open.setdefault(count, [])
        members.append(piece)
        if len(members) < count:
            return []
        del self.open[count]
        rows, offset = [], 0
        for p in members:
            rows.append((*p, self.worker, (self.worker << 32) + self.bins, offset))
            offset += p[2]
        self.bins += 1
        return rows

    def rest(self) -> list[tuple]:
        return [(*p, self.worker, None, None) for members in self.open.values() for p in members]


def tiktoken_of(vocabulary: str):
    """The vocabulary file as a ``tiktoken`` encoding, whose ids are those of ``tokenizers``: ranks are ids where merges come in the order of ids."""
    import tiktoken

    from sedimark.llm.trie_bpe import PATTERN

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    symbols, vocab = byte_symbols(), spec["model"]["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if made != sorted(made):
        raise ValueError("the merges aren't in the order of their ids")
    ranks = {bytes(symbols[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


#: Runs of white space for which ``tiktoken`` needs a stack as deep as they are long.
LONG_SPACE = re.compile(f"[{SPACE}]{{1000}}")


class Ids:
    """Ids of texts: by ``tiktoken``, and by the trie where a text has a run of white space that ``tiktoken`` can't take."""

    def __init__(self, vocabulary: str) -> None:
        self.vocabulary, self.fast, self.trie = vocabulary, tiktoken_of(vocabulary), None

    def encode(self, text: str) -> np.ndarray:
        if not LONG_SPACE.search(text):
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), "<u4")
        if self.trie is None:
            self.trie = TrieBpe(self.vocabulary)
        return np.asarray(next(self.trie.encode_batch([text])), "<u4")


def first_round(docs: DataFrame, vocabulary: str, capacity: int, closing_id: int) -> DataFrame:
    def run(batches):
        coder, bins = Ids(vocabulary), OpenBins(TaskContext.get().partitionId(), capacity)
        schema = pa.schema([(f.split()[0], {"long": pa.int64(), "int": pa.int32()}[f.split()[1]]) for f in PIECES.split(", ")])
        rows: list[tuple] = []

        def out():
            columns = zip(*rows, strict=True) if rows else [()] * len(schema)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            rows.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(coder.encode(text or ""), np.uint32(closing_id)).astype("<u4")
                view, start = memoryview(ids.tobytes()), 0
                for length in cuts(len(ids), capacity):
                    rows += bins.add((doc_id, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), len(ids)))
                    start += length
                if len(rows) > 20_000:
                    yield out()
        rows += bins.rest()
        yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), PIECES)


def second_round(left: DataFrame, capacity: int, smallest: int = 32) -> DataFrame:
    """Fill bins with the pieces of workers' open bins. A group holds the open bins of so many workers, whatever the input's size."""
    left = left.withColumn("team", F.floor(F.col("worker") / WORKERS_A_GROUP)).withColumn("holds", F.floor(F.lit(capacity) / F.col("length")))
    # the same filling, over all workers of a group: k pieces of class k to a bin
    by_class = Window.partitionBy("team", "holds")
    place = by_class.orderBy("worker", "doc_id", "start", "ids_crc32")
    left = left.withColumn("nth", F.row_number().over(place) - 1).withColumn("n", F.count("*").over(by_class)).withColumn("bin", F.floor(F.col("nth") / F.col("holds")))
    full = (F.col("bin") + 1) * F.col("holds") <= F.col("n")
    ids = F.lit(SECOND) + F.col("team") * F.lit(1 << 40)
    filled = left.where(full).withColumn("sequence_id", ids + F.col("holds") * F.lit(1 << 28) + F.col("bin"))
    # the last open bins of all classes share sequences
    tail = (F.col("length") < smallest).cast("int")
    in_order = Window.partitionBy("team", "tail").orderBy(F.desc("length"), "worker", "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    last = left.where(~full).withColumn("tail", tail).withColumn("before", F.coalesce(F.sum("length").over(in_order), F.lit(0)))
    # a tail that starts before capacity - (smallest - 1) ends inside the sequence
    span = F.when(F.col("tail") == 1, capacity - smallest + 2).otherwise(capacity)
    last = last.withColumn("sequence_id", ids + F.lit(1 << 39) + F.col("tail") * F.lit(1 << 38) + F.floor(F.col("before") / span))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "worker", "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    both = filled.select(*COLUMNS, "worker").unionByName(last.select(*COLUMNS, "worker"))
    return both.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).select(*COLUMNS, "offset")


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, closing_id: int = 0) -> DataFrame:
    """One row for each piece: where it is in its document and in its sequence."""
    pieces = materialise(first_round(docs, vocabulary, capacity, closing_id), "pieces")
    done = pieces.where("sequence_id is not null").select(*COLUMNS, "offset")
    return done.unionByName(second_round(pieces.where("sequence_id is null").drop("sequence_id", "offset"), capacity))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens of the 50k byte-level vocabulary."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
