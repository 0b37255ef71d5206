"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered by overlapping chunks. Learned filters (weights
for each byte value at each place of a window) slide over a chunk; a rectifier
and the maximum over the chunk give one value a filter. A document's chunks are
combined into the mean, the maximum and the deviation of each filter, and a
logistic layer turns these into one probability. All bytes are read: the last
chunk ends where the text ends.

Fitting uses a bounded sample of labelled rows: ``sample`` rows of each class, by
the hash of their id, of texts of at most ``sample_bytes``. Everything else, such
as the share of each class that corrects the sample's balance, covers all
labelled rows. The model (a few hundred KB) goes to the workers with the task.
A very long text is pooled in slices of its chunks, so that beside the text itself
memory doesn't grow with its length.

Defined cases: a null or empty text has no chunk and scores by the layer's bias
alone; a very long text is read whole; an empty table gives no row; rows without a label or with a null label aren't learnt from; if no label
can be learnt from, every score is 1; if all labels are alike, every score is
their smoothed share; repeated rows repeat their score; a column that already has the name of the score
is replaced by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sedimark.llm.common import lean, learns, table

CHUNK, OVERLAP, WINDOW, STRIDE, FILTERS = 257, 64, 5, 2, 16  # the last window of a chunk ends on its last byte
#: Chunks that are laid out at a time.
SLICE = 2000


class ByteCnn:
    """Filters (WINDOW, 256, FILTERS), their bias, and the last layer over mean, maximum and deviation."""

    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.3, (WINDOW, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.last = np.zeros(3 * FILTERS, np.float32)
        self.last_bias = np.zeros(1, np.float32)
        self.shift = 0.0  # of the logit, for the classes' true shares
        self.constant: float | None = None

    @staticmethod
    def slices(data: bytes) -> Iterator[np.ndarray]:
        """Rows of CHUNK byte values that cover the text, overlapping, SLICE of them at a time; a short text is one row, filled with spaces."""
        a = np.frombuffer(data, np.uint8)
        if len(a) <= CHUNK:
            yield np.concatenate([a, np.full(CHUNK - len(a), 32, np.uint8)])[None][: min(len(a), 1)]
            return
        starts = np.append(np.arange(0, len(a) - CHUNK, CHUNK - OVERLAP), len(a) - CHUNK)
        for at in range(0, len(starts), SLICE):
            yield a[starts[at : at + SLICE, None] + np.arange(CHUNK)]

    @classmethod
    def chunks(cls, data: bytes) -> np.ndarray:
        """All rows of ``slices``."""
        return np.concatenate(list(cls.slices(data)))

    def convolve(self, rows: np.ndarray) -> np.ndarray:
        """(chunks, places, FILTERS) before the rectifier."""
        places = (CHUNK - WINDOW) // STRIDE + 1
        out = np.broadcast_to(self.bias, (len(rows), places, FILTERS)).copy()
        for o in range(WINDOW):
            out += self.filters[o][rows[:, o : o + (places - 1) * STRIDE + 1 : STRIDE]]
        return out

    def pooled(self, rows: np.ndarray, block: int = 64) -> np.ndarray:
        """Maximum of each filter over each chunk."""
        out = [np.maximum(self.convolve(rows[i : i + block]).max(1), 0) for i in range(0, len(rows), block)]
        return np.concatenate(out) if out else np.zeros((0, FILTERS), np.float32)

    @staticmethod
    def combine(p: np.ndarray) -> np.ndarray:
        return np.concatenate([p.mean(0), p.max(0), np.sqrt(p.var(0) + 1e-6)]) if len(p) else np.zeros(3 * FILTERS, np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """One probability for each text, in blocks of bounded size."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out, group, held = np.zeros(len(texts)), [], 0

        def flush():
            if group:
                p = self.pooled(np.concatenate([r for _, r in group]))
                at = 0
                for i, r in group:
                    out[i] = self.combine(p[at : at + len(r)]) @ self.last + self.last_bias[0]
                    at += len(r)
                group.clear()

        for i, text in enumerate(texts):
            data = (text or "").encode()
            if len(data) > SLICE * (CHUNK - OVERLAP):
                p = np.concatenate([self.pooled(rows) for rows in self.slices(data)])
                out[i] = self.combine(p) @ self.last + self.last_bias[0]
                continue
            rows = self.chunks(data)
            group.append((i, rows))
            held += len(rows)
            if held > SLICE:
                flush()
                held = 0
        flush()
        return 1 / (1 + np.exp(-np.clip(out + self.shift, -30, 30)))

    def fit(self, texts: list[str], labels: list[int], epochs: int = 12, batch: int = 16, rate: float = 0.01, seed: int = 1) -> ByteCnn:
        """Adam on the log loss. A gradient passes the maximum only to the place that gave it, so a step touches few weights."""
        rng = np.random.default_rng(seed)
        data = [self.chunks(t.encode()) for t in texts]
        y = np.asarray(labels, np.float32)
        params = [self.filters, self.bias, self.last, self.last_bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for epoch in range(epochs):
            for at in range(0, len(data), batch):
                if at == 0:
                    order = rng.permutation(len(data))
                grads = [np.zeros_like(p) for p in params]
                for i in order[at : at + batch]:
                    rows = data[i]
                    if not len(rows):
                        continue
                    conv = self.convolve(rows)
                    best = conv.argmax(1)  # (chunks, FILTERS)
                    top = np.take_along_axis(conv, best[:, None], 1)[:, 0]
                    p = np.maximum(top, 0)
                    mean, dev = p.mean(0), np.sqrt(p.var(0) + 1e-6)
                    x = np.concatenate([mean, p.max(0), dev])
                    error = 1 / (1 + np.exp(-np.clip(x @ self.last + self.last_bias[0], -30, 30))) - y[i]
                    grads[2] += error * x
                    grads[3] += error
                    g = error * self.last
                    gp = g[:FILTERS] / len(p) + g[2 * FILTERS :] * (p - mean) / dev / len(p)
                    gp[p.argmax(0), np.arange(FILTERS)] += g[FILTERS : 2 * FILTERS]
                    gp *= top > 0
                    grads[1] += gp.sum(0)
                    row, f = np.indices(best.shape)
                    for o in range(WINDOW):
                        np.add.at(grads[0], (o, rows[row, best * STRIDE + o], f), gp)
                step += 1
                pace = rate * (1 - epoch / epochs)
                for k, (p, g) in enumerate(zip(params, grads, strict=True)):
                    g /= batch
                    if k == 0:
                        g += 1e-4 * p
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    p -= (pace * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def fit(docs: DataFrame, labels: DataFrame, sample: int = 600, sample_bytes: int = 32_768, modulus: int = 4, held_out_rest: int = 2) -> ByteCnn:
    """A model from rows of ``labels`` (doc_id, quality) whose id isn't held out, over at most ``sample`` rows of each class."""
    usable = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where(learns("doc_id", modulus, held_out_rest))
    share = {r.quality: r["count"] for r in usable.groupBy("quality").count().collect()}  # two rows at most
    model, n = ByteCnn(), sum(share.values())
    if len(share) < 2:
        model.constant = 1.0 if not n else (share.get(1, 0) + 1) / (n + 2)
        return model
    spread = F.xxhash64("doc_id", F.lit(8))
    # twice as many ids as wanted, since long texts fall away
    ids = [usable.where(F.col("quality") == q).dropDuplicates(["doc_id"]).orderBy(spread, "doc_id").limit(2 * sample) for q in (0, 1)]
    chosen = F.broadcast(ids[0].unionByName(ids[1]))  # 4 * sample rows at most
    eligible = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.octet_length("text").between(1, sample_bytes)).join(chosen, "doc_id")
    both = [eligible.where(F.col("quality") == q).orderBy(spread, "doc_id", "text").limit(sample) for q in (0, 1)]
    rows = both[0].unionByName(both[1]).select("text", "quality").collect()
    found = {r.quality for r in rows}
    if len(found) < 2:
        model.constant = (share[1] + 1) / (n + 2)
        return model
    model.fit([r.text for r in rows], [r.quality for r in rows])
    of = [sum(r.quality == q for r in rows) for q in (0, 1)]
    model.shift = float(np.log(share[1] / share[0]) - np.log(of[1] / of[0]))
    return model


def score(docs: DataFrame, model: ByteCnn, column: str = "score") -> DataFrame:
    """``docs`` with a probability in ``column``; its other columns stay as they are."""
    names = [c for c in docs.columns if c.lower() != column.lower()]
    rows = docs.select(*(F.col(f"`{c}`") for c in names))
    at = names.index("text")

    def run(batches):
        for batch in batches:
            found = pa.array(model.scores(batch.column(at).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*names, column])

    return rows.mapInArrow(lean(run), StructType([*rows.schema.fields]).add(column, "double"))


def keep_good(docs: DataFrame, model: ByteCnn, threshold: float = 0.7) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns."""
    own = f"score {uuid.uuid4().hex}"
    return score(docs, model, own).where(F.col(f"`{own}`") >= threshold).drop(own)


def op8_byte_cnn(spark, sf_dir: str) -> DataFrame:
    """Quality of every document by the network that learns from the labels of rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
    return found.select("doc_id", (~learns("doc_id", 4, 2)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
