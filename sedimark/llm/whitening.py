"""Whitening of embeddings: principal components by a randomised range finder.

*Numbers.* A vector's entries c become whole numbers x = floor(64 c) + 1,000,000.
The fit list has each distinct x vector once, so copies, however many, weigh as one.
Sums are of whole numbers and exact; rows are centred as x - floor(S / n), which is
exact, less the fraction that is left, before anything is multiplied.

*Range finder.* ``components + OVERSAMPLING`` random directions go through the
covariance ``POWERS`` times at most: each power pass reads all centred rows, a task
sums its own part of X'(X Q) in blocks of rows, and tasks hand on one number for
each dimension and direction, which Spark sums. Directions are made orthonormal
after each pass. *Rayleigh-Ritz*: the eigenpairs of Q'VQ are candidates, and their
residuals V u - e u come with the next pass. If the residuals aren't below
``TOLERANCE`` of the gap to the next eigenvalue after the last pass, or what is
gained by a pass shows that they can't be by then, the range expands to all
dimensions, whose one pass gives the eigenvectors to double precision.

What the driver holds is matrices of dimensions times directions, never rows.

Defined cases: null vectors, and those with null or non-finite entries (or entries of
2^32 and more), are left out, and so are vectors without entries; if lengths differ, those of the most
frequent length stay (of two as frequent the larger). Rows with a null vec_id, or one
vec_id twice, are rows like others. Directions without variance (an eigenvalue of 0
up to rounding) can't be whitened and give no row, so fewer than 16 components come
of fewer dimensions or distinct vectors than that, and an empty table, or one
distinct vector, gives no row. Ties between eigenvalues give any basis of their
space, one for all rows. A deviation that 64 bits can't hold is null. Other columns
play no part, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import materialise, table

#: Fixed values of the whole-number form of an entry.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS, OVERSAMPLING, POWERS, TOLERANCE = 16, 8, 8, 1e-11
#: Entries from this size on count as not finite: their sums would leave 64 bits.
LARGEST = 2.0**32
#: Rows multiplied at once in a task.
BLOCK = 4096


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite numbers."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: (F.floor(SCALE * c) + SHIFT).cast("long"))


def prepared(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the usable rows of ``embeddings`` (vec_id, embedding) that have the most frequent length."""
    vector = F.col("embedding").cast("array<double>")
    rows = materialise(embeddings.select("vec_id", vector.alias("v")).where(usable(F.col("v"))).select("vec_id", whole(F.col("v")).alias("x")), "vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).head(1)
    return rows.where(F.size("x") == (lengths[0].d if lengths else 0))


@dataclass
class Shape:
    """Number of distinct vectors, and the exact sum of each dimension."""

    n: int
    sums: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n for rows of whole numbers, the whole part first."""
        low = np.array([s // self.n for s in self.sums], np.int64)
        return (x - low).astype(np.float64) - np.array([(s % self.n) / self.n for s in self.sums])


def shape_of(fit: DataFrame) -> Shape:
    dims = fit.select(F.posexplode("x").alias("dim", "value")).groupBy("dim").agg(F.count("*").alias("n"), F.sum("value").alias("s")).orderBy("dim").collect()  # one row a dimension
    return Shape(dims[0].n, [r.s for r in dims]) if dims else Shape(0, [])


def blocks(batches, place: int = 0, size: int = BLOCK):
    """(batch, its vectors as a matrix), at most ``size`` rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield part, np.asarray(part.column(place).flatten()).reshape(part.num_rows, -1)


def summed(fit: DataFrame, of_rows, size: int) -> np.ndarray:
    """The sum of ``of_rows`` (a flat array of ``size``) over blocks of all rows: inside each task first, then by Spark, place by place."""

    def run(batches):
        total = np.zeros(size)
        for _, x in blocks(batches):
            total += of_rows(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["place", "value"])

    out = np.zeros(size)
    for r in fit.select("x").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():  # dimensions times directions
        out[r.place] = r.value
    return out


def times_covariance(fit: DataFrame, shape: Shape, q: np.ndarray) -> np.ndarray:
    """V Q, from one pass over all centred rows."""

    def of_rows(x):
        c = shape.centred(x)
        return (c.T @ (c @ q)).ravel()

    return summed(fit, of_rows, q.size).reshape(q.shape) / shape.n


@dataclass
class Components:
    """Unit eigenvectors as columns, their eigenvalues, the trace, and how they were found."""

    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    expanded: bool


def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: (vectors, values, residuals) in falling order of value."""
    small = q.T @ vq
    values, rotation = np.linalg.eigh((small + small.T) / 2)
    values, rotation = values[::-1], rotation[:, ::-1]
    return q @ rotation, values, np.linalg.norm(vq @ rotation - (q @ rotation) * values, axis=0)


def components(fit: DataFrame, shape: Shape, k: int = COMPONENTS, oversampling: int = OVERSAMPLING, powers: int = POWERS, tolerance: float = TOLERANCE) -> Components:
    """The leading ``k`` eigenpairs of the covariance of ``fit`` (x), those with variance."""
    d = len(shape.sums)

    def spread(x):
        return (shape.centred(x) ** 2).sum(0)

    trace = float(summed(fit, spread, d).sum()) / shape.n
    wide = min(k + oversampling, d)
    q, passes, before = np.linalg.qr(np.random.default_rng(13).normal(size=(d, wide)))[0], 0, None
    while True:
        expanded = wide == d
        if expanded:
            q = np.eye(d)
        vq = times_covariance(fit, shape, q)
        passes += 1
        vectors, values, residuals = ritz(q, vq)
        if expanded:
            break
        lead = min(k, wide)
        gaps = np.minimum(np.abs(np.diff(values, prepend=np.inf)), np.abs(np.diff(values, append=-np.inf)))[:lead]
        worst = float((residuals[:lead] / np.maximum(gaps, 1e-300)).max())
        if worst <= tolerance:
            break
        # what is left to gain, at the rate of the last pass, in the passes that are left
        rate = worst / before if before else 0.0
        if passes >= powers or (before and worst * min(rate, 1.0) ** (powers - passes) > tolerance):
            wide = d
        before = worst
        q = np.linalg.qr(vq)[0]
    some = values[:k] > max(trace, 0.0) * 1e-13
    return Components(vectors[:, :k][:, some], values[:k][some], trace, passes, expanded)


def whiten(embeddings: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of ``embeddings`` (vec_id, embedding)."""
    rows = prepared(embeddings)
    fit = materialise(rows.select("x").distinct(), "fit")
    shape = shape_of(fit)
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = components(fit, shape, k) if shape.n > 1 else None
    if found is None or not len(found.values):
        return rows.sparkSession.createDataFrame([], out)
    axes, m = found.vectors / np.sqrt(found.values), len(found.values)

    def of_rows(x):
        w = shape.centred(x) @ axes
        return (w.T @ w).ravel()

    error = float(np.abs(summed(fit, of_rows, m * m).reshape(m, m) / shape.n - np.eye(m)).max())

    def run(batches):
        for part, x in blocks(batches, 1):
            w = shape.centred(x) @ axes
            ids = part.column(0).take(pa.array(np.repeat(np.arange(len(w)), m)))
            yield pa.RecordBatch.from_arrays([ids, part.column(2).take(pa.array(np.repeat(np.arange(len(w)), m))), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(w))), pa.array(w.ravel())], ["vec_id", "deviation", "component", "whitened"])

    # exact: n * x - S in whole numbers, added up as such
    sums = F.array(*(F.lit(s).cast("long") for s in shape.sums))
    apart = F.zip_with("x", sums, lambda x, s: F.try_subtract(F.try_multiply(x, F.lit(shape.n).cast("long")), s))
    deviation = F.aggregate(F.transform(apart, lambda a: F.try_multiply(a, a)), F.lit(0).cast("long"), lambda t, a: F.try_add(t, a))
    projected = rows.select(F.col("vec_id").cast("long"), "x", deviation.alias("deviation")).mapInArrow(run, "vec_id long, deviation long, component int, whitened double")
    explained = F.get(F.array(*(F.lit(float(v / found.trace)) for v in found.values)), F.col("component") - 1)
    return projected.select("vec_id", "component", F.lit(shape.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """The leading 16 whitened components of all embeddings."""
    return whiten(table(spark, sf_dir, "embeddings"))
