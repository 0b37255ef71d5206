"""Vectors in cells: exact search that passes over cells by their bounds, and an approximate index with quantised residuals.

Cells are the centres of spherical k-means on a bounded sample (``sample`` rows by
the hash of their id). Every vector belongs to the cell of its nearest centre, and
a query meets cells, not vectors: its rows are dealt out by cell and joined with
blocks of that cell's vectors on the cell's number. A null vector (all entries 0) is
as near to everything, so these have a cell of their own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.operators.scratch import shared_path, written, written_in_small_batches

#: Vectors of one block, queries of one row, rows that centres and codes are learnt from at most, cells at most.
BLOCK, ASKED, SAMPLE, MOST_CELLS = 4096, 256, 16_384, 1024
#: Rows with a block each that Python is handed at a time.
FEW = 4


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query of (query, doc, score), ties by doc, with their rank."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def each_row(batch: pa.RecordBatch):
    """The rows of ``batch``, whose columns are lists or bytes, one at a time: lists as arrays without a Python object for each entry, bytes as buffers."""
    for n in range(batch.num_rows):
        values = (c[n] for c in batch.columns)
        yield tuple(v.values.to_numpy() if isinstance(v, pa.ListScalar) else v.as_buffer() for v in values)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def matrix(column: pa.Array) -> np.ndarray:
    """A batch of vectors of one length."""
    if not len(column):
        return np.zeros((0, 0))
    flat = np.asarray(column.flatten(), np.float64)
    if len(flat) % len(column) or len(np.unique(np.diff(np.asarray(column.offsets)))) > 1:
        raise ValueError("vectors of one search have one length")
    return flat.reshape(len(column), -1)


def means(x: np.ndarray, own: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The mean of each group; a group without members keeps the old one."""
    n = np.bincount(own, minlength=len(old))
    total = np.zeros_like(old)
    np.add.at(total, own, x)
    return np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], old)


def clusters(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of spherical k-means over rows of length 1."""
    c = x[np.random.default_rng(5).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        c = unit(means(x, (x @ c.T).argmax(1), c))
    return c


def codebook(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Centres of plain k-means, for the parts of residuals."""
    c = x[np.random.default_rng(6).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        c = means(x, (x @ c.T - (c**2).sum(1) / 2).argmax(1), c)
    return c


def sampled(rows: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """At most ``sample`` vectors of ``rows`` (id, vector), by the hash of their id, at length 1; null ones left out."""
    some = rows.select("vector", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(sample).select("vector").toArrow()
    x = matrix(some["vector"].combine_chunks()) if some.num_rows else np.zeros((0, 0))
    return unit(x[np.abs(x).sum(1) > 0]) if len(x) else x


@dataclass
class Cells:
    """Centres; one more cell, the last, holds null vectors."""

    centres: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row of ``x`` (length 1 or 0)."""
        if not len(self.centres):
            return np.zeros(len(x), np.int32)
        return np.where(np.abs(x).sum(1) > 0, (x @ self.centres.T).argmax(1), len(self.centres)).astype(np.int32)


def cells(rows: DataFrame, n: int | None = None, sample: int = SAMPLE) -> tuple[Cells, np.ndarray]:
    """Cells of ``rows`` (id, vector), about half the root of their number, and the sample that they come from."""
    x = sampled(rows, sample)
    n = n or max(1, min(MOST_CELLS, round(math.sqrt(len(x) if len(x) < sample else rows.count()) / 2)))
    return Cells(clusters(x, n) if len(x) else x), x


def celled(rows: DataFrame, own: Cells) -> DataFrame:
    """(cell, id, vector) of ``rows`` (id, vector), vectors at length 1."""

    def run(batches):
        for batch in batches:
            x = unit(matrix(batch.column(1)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * (x.shape[1] if len(x) else 0), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(own.of(x), pa.int32()), batch.column(0), flat], ["cell", "id", "vector"])

    return rows.select(F.col("id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(run, "cell int, id long, vector array<double>")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`celled` in order of cell; a large cell goes to several tasks."""
    return rows.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")


def runs_of_cells(batches, size: int = BLOCK):
    """(cell, ids, vectors) of rows in order of cell, at most ``size`` of one cell at a time."""
    cell, ids, parts, held = None, [], [], 0
    for batch in batches:
        own, key, x = np.asarray(batch.column(0)), np.asarray(batch.column(1)), matrix(batch.column(2))
        edges = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            while a < b:
                if held and (own[a] != cell or held == size):
                    yield cell, np.concatenate(ids), np.concatenate(parts)
                    ids, parts, held = [], [], 0
                cell, n = own[a], min(b - a, size - held)
                ids.append(key[a : a + n])
                parts.append(x[a : a + n])
                held, a = held + n, a + n
    if held:
        yield cell, np.concatenate(ids), np.concatenate(parts)


def asked(rows: DataFrame, where) -> DataFrame:
    """(cell, queries, asked, least) of ``rows`` (id, vector, least): the queries of each cell that ``where`` (vectors at length 1, least) marks, at most ASKED in a row."""

    def run(batches):
        for batch in batches:
            x = unit(matrix(batch.column(1)))
            ids, least = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            marks = where(x, least) if len(x) else np.zeros((0, 0), bool)
            out: list[tuple] = []
            for cell in np.flatnonzero(marks.any(0)):
                own = np.flatnonzero(marks[:, cell])
                for at in range(0, len(own), ASKED):
                    part = own[at : at + ASKED]
                    out.append((int(cell), ids[part], x[part].tobytes(), least[part]))
            columns = zip(*out, strict=True) if out else [()] * 4
            kinds = (pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["cell", "queries", "asked", "least"])

    return rows.select("id", "vector", "least").mapInArrow(run, "cell int, queries array<long>, asked binary, least array<double>")


def best(queries, ids, scores: np.ndarray, least, k: int) -> pa.RecordBatch:
    """(query, doc, score) of the k best of each row of ``scores`` that reach its ``least``, itself left out; ties by id."""
    queries, ids = np.asarray(queries, np.int64), np.asarray(ids, np.int64)
    scores = np.where(queries[:, None] == ids, -np.inf, scores)
    kth = np.partition(scores, -k, axis=1)[:, -k] if k < scores.shape[1] else np.full(len(scores), -np.inf)
    taken = (scores >= np.maximum(kth, least)[:, None]) & (scores > -np.inf)
    for n in np.flatnonzero(taken.sum(1) > k):  # more than k by ties with the k-th
        some = np.flatnonzero(taken[n])
        taken[n] = False
        taken[n, some[np.lexsort((ids[some], -scores[n, some]))[:k]]] = True
    q, d = np.nonzero(taken)
    return pa.RecordBatch.from_arrays([pa.array(queries[q]), pa.array(ids[d]), pa.array(scores[q, d])], ["query", "doc", "score"])


FOUND = "query long, doc long, score double"


def knn(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(query, doc, score, rank): the k nearest of ``corpus`` (doc, vector) for each of ``queries`` (query, vector), itself left out. Exact, by cosine rounded to six places, ties by doc.

    A query looks into its nearest cell first. Its k-th score there is a bound, and it
    then goes to those other cells alone that may hold a better one by the angle
    between query and centre and the cell's radius.
    """
    rows = corpus.select(F.col("doc").alias("id"), "vector")
    own, _ = cells(rows, sample=2048)
    n = len(own.centres)

    def block(batches):
        for cell, ids, x in runs_of_cells(batches):
            angle = float(np.arccos(np.clip(x @ own.centres[cell], -1, 1)).max()) if cell < n else np.pi
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()), pa.array([angle])], ["cell", "ids", "vectors", "radius"])

    blocks = written(dealt(celled(rows, own)).mapInArrow(block, "cell int, ids array<long>, vectors binary, radius double"), "cells")
    radius = np.full(n + 1, -1.0)
    for r in blocks.groupBy("cell").agg(F.max("radius").alias("radius")).collect():  # one row a cell
        radius[r.cell] = r.radius
    there = radius >= 0

    def nearest(x, least):
        marks = np.zeros((len(x), n + 1), bool)
        if n:
            near = np.where(there[:n], x @ own.centres.T, -2).argmax(1)
            marks[np.arange(len(x)), near] = there[near]
        return marks

    def open_yet(x, least):
        """Cells besides the first that may hold a score of ``least`` or more."""
        angles = np.concatenate([np.arccos(np.clip(x @ own.centres.T, -1, 1)), np.zeros((len(x), 1))], axis=1) if n else np.zeros((len(x), 1))
        bound = np.cos(np.clip(angles - radius, 0, np.pi))
        # a query without direction has score 0 everywhere
        bound[np.abs(x).sum(1) == 0] = 1
        return there & (bound >= np.round(least, 6)[:, None] - 1e-5) & ~nearest(x, least)

    def score(batches):
        for batch in batches:
            for asked_ids, q, least, ids, v in each_row(batch):
                x, y = np.frombuffer(q).reshape(len(asked_ids), -1), np.frombuffer(v).reshape(len(ids), -1)
                yield best(asked_ids, ids, np.round(x @ y.T, 6), least, k)

    def scored(marked, name):
        both = marked.join(blocks.drop("radius"), "cell").select("queries", "asked", "least", "ids", "vectors")
        return written_in_small_batches(top_k(both.mapInArrow(score, FOUND), k), name, FEW)

    q = written(queries.select(F.col("query").cast("long").alias("id"), F.col("vector").cast("array<double>")), "asked")
    first = scored(asked(q.withColumn("least", F.lit(-2.0)), nearest), "first")
    return top_k(first.drop("rank").unionByName(scored(asked(bounded(q, first, k), open_yet), "others").drop("rank")), k)


def bounded(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``queries`` (id, vector) with ``least``, the score of their k-th row in ``found``; -2 if they have fewer."""
    kth = found.where(F.col("rank") == k).select(F.col("query").alias("id"), F.col("score").alias("least"))
    return queries.join(kth, "id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))


# --- the approximate index


@dataclass
class Quantiser:
    """A cell's centre and, for each part of the residual, one of up to 256 codes."""

    cells: Cells
    books: list[np.ndarray]

    def edges(self) -> np.ndarray:
        return np.cumsum([0, *(b.shape[1] for b in self.books)])

    def encode(self, cell: np.ndarray, x: np.ndarray) -> np.ndarray:
        residual, e = x - self.centre(cell), self.edges()
        return np.stack([(residual[:, a:b] @ book.T - (book**2).sum(1) / 2).argmax(1) for a, b, book in zip(e[:-1], e[1:], self.books, strict=True)], axis=1).astype(np.uint8)

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centre(cell) + np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)

    def centre(self, cell: np.ndarray) -> np.ndarray:
        return np.concatenate([self.cells.centres, np.zeros((1, self.cells.centres.shape[1]))])[cell]


@dataclass
class Index:
    """``codes`` (cell, ids, codes) is what a search scans, ``vectors`` (doc, vector) what it looks its candidates up in; ``probes`` cells are searched, ``depth`` candidates of each query ranked exactly."""

    quantiser: Quantiser
    codes: str
    vectors: str
    probes: int
    depth: int


def quantiser(own: Cells, x: np.ndarray, parts: int = 16) -> Quantiser:
    residual = x - own.centres[own.of(x)]
    return Quantiser(own, [codebook(p, 256) for p in np.array_split(residual, min(parts, x.shape[1]), axis=1)])


def tuned(q: Quantiser, x: np.ndarray, k: int, depth: int, recall: float, asked_of: int = 256) -> int:
    """The number of cells to probe with which every so many rows of the sample ``x`` find that share of their true k nearest in it."""
    cell = q.cells.of(x)
    near = x[:: max(1, len(x) // asked_of)]
    places = np.arange(len(x))[:: max(1, len(x) // asked_of)]
    exact, rough = near @ x.T, near @ q.decode(cell, q.encode(cell, x)).T
    exact[np.arange(len(near)), places] = rough[np.arange(len(near)), places] = -9
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    true = np.argpartition(-exact, k - 1, axis=1)[:, :k]
    order = np.argsort(np.argsort(-(near @ q.cells.centres.T), axis=1), axis=1)  # how near each centre is
    probes, n = 1, len(q.cells.centres)
    while probes < n:
        seen = np.where(order[:, cell] < probes, rough, -9)
        kept = np.argpartition(-seen, min(depth, len(x)) - 1, axis=1)[:, :depth]
        hit = [np.isin(t, c[s[c] > -9]).mean() for t, c, s in zip(true, kept, seen, strict=True)]
        if np.mean(hit) >= recall:
            break
        probes = min(n, max(probes + 1, probes * 5 // 4))
    return probes


def build(corpus: DataFrame, k: int = 10, recall: float = 0.95, n_cells: int | None = None, depth: int = 200, sample: int = SAMPLE) -> Index | None:
    """Index all of ``corpus`` (doc, vector); None if it has no vector with a direction.

    Centres, codes and the number of cells to probe are learnt from at most
    ``sample`` rows; every row is indexed.
    """
    rows = corpus.select(F.col("doc").cast("long").alias("id"), F.col("vector").cast("array<double>"))
    own, x = cells(rows, n_cells, sample)
    if not len(x):
        return None
    q = quantiser(own, x)
    spark = corpus.sparkSession
    codes, vectors = shared_path(spark, "codes"), shared_path(spark, "vectors")
    celled(rows, own).select(F.col("id").alias("doc"), "cell", "vector").write.parquet(vectors)

    def block(batches):
        for cell, ids, m in runs_of_cells(batches):
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([q.encode(np.full(len(m), cell), m).tobytes()], pa.binary())], ["cell", "ids", "codes"])

    dealt(spark.read.parquet(vectors).select("cell", F.col("doc").alias("id"), "vector")).mapInArrow(block, "cell int, ids array<long>, codes binary").write.parquet(codes)
    return Index(q, codes, vectors, tuned(q, x, k, depth, recall), depth)


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query, doc, score, rank) of the k nearest that ``index`` finds for ``queries`` (query, vector), itself left out; scores are exact cosines."""
    spark, own, q = queries.sparkSession, index.quantiser.cells, index.quantiser
    n = len(own.centres)

    few = -(-index.probes // 8)

    def probed(after: int, upto: int):
        def marked(x, least):
            marks = np.zeros((len(x), n + 1), bool)
            np.put_along_axis(marks, np.argsort(-(x @ own.centres.T), axis=1, kind="stable")[:, after:upto], True, axis=1)
            return marks

        return marked

    def rough(batches):
        for batch in batches:
            for cell, asked_ids, asked_x, least, ids, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(asked_x).reshape(len(asked_ids), -1)
                y = q.decode(np.full(len(ids), cell), np.frombuffer(codes, np.uint8).reshape(len(ids), -1))
                yield best(asked_ids, ids, x @ y.T, least, index.depth)

    def scanned(marked):
        return top_k(marked.join(blocks, "cell").select("cell", "queries", "asked", "least", "ids", "codes").mapInArrow(rough, FOUND), index.depth)

    def exact(batches):
        for batch in batches:
            x, y = unit(matrix(batch.column(2))), matrix(batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round((x * y).sum(1), 6) if len(x) else [], pa.float64())], ["query", "doc", "score"])

    rows = written(queries.select(F.col("query").cast("long").alias("id"), F.col("vector").cast("array<double>")), "asked")
    blocks = spark.read.parquet(index.codes)
    # the nearest cells give each query a score that candidates of the others have to reach
    first = written(scanned(asked(rows.withColumn("least", F.lit(-2.0)), probed(0, few))), "first")
    near = first if few == index.probes else first.unionByName(scanned(asked(bounded(rows, first, index.depth), probed(few, index.probes))))
    near = written(top_k(near.drop("rank"), index.depth).select("query", "doc"), "candidates")
    there = spark.read.parquet(index.vectors).select("doc", F.col("vector").alias("there"))
    both = near.join(there, "doc").join(rows.select(F.col("id").alias("query"), "vector"), "query").select("query", "doc", "vector", "there")
    return top_k(both.mapInArrow(exact, FOUND), k)


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """One row (n_true, n_found, recall): how many of the true (query, doc) are among those found."""
    hits = true.select("query", "doc").join(found.select("query", "doc").withColumn("hit", F.lit(1)), ["query", "doc"], "left")
    counts = hits.agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"))
    return counts.withColumn("recall", F.coalesce(F.try_divide("n_found", "n_true"), F.lit(1.0)))
