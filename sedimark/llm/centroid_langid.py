"""Language identification by nearest centroid.

A text is a vector of its byte trigrams (lower case, hashed to ``DIMENSIONS``
places), weighted by the logarithm of their count and the inverse document
frequency and brought to length 1. Each language has several centroids, from
spherical k-means over a sample of its documents, so that different kinds of text
in one language don't blur into one mean. A text gets the language of the
centroid with the largest cosine; it is rejected when even that one is farther
than the largest distance allowed.

That distance is learnt. A text's cosine grows with the number of different
trigrams in it, so texts are put in bands by the binary length of that number, and
a language's limit in a band is ``MARGIN`` of a low quantile (``LOW``) of the
cosines that its own rows have there, all rows that may be learnt from, each as a
whole and by its first words (``PIECES``), so that short texts are measured by short
texts even where all rows are long. Bands with fewer than ``FEW`` of its rows borrow the nearest ones'; below its shortest
rows the limit shrinks with the square root of the number of trigrams.

Document frequencies and the languages themselves come from all rows that may be
learnt from. The sample for the clusters is bounded: ``sample`` rows of each
language by the hash of their id, of texts of at most ``sample_bytes``.

Defined cases: a null text or one without a letter is ``und`` with score 0 and
rejected; a very long text is read whole, its trigrams counted in slices; an empty
table gives no row; columns of the input whose names clash with the result's stay
in ``keep_known``; with nothing to learn from every text is ``und``; rows with a null
language aren't learnt from; ties go to the language that sorts first; repeated
rows repeat their result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sedimark.llm.common import lean, learns, table

BITS, CLUSTERS = 12, 4
DIMENSIONS = 1 << BITS
#: Trigrams that are hashed at a time.
SLICE = 1 << 20
#: Bytes of UTF-8 that bear on a language: a-z and all beyond ASCII.
LETTERS = bytes(b if b >= 128 or chr(b).islower() else 32 for b in range(256))
#: Cosine below which a text is rejected whatever its limit: what shares next to no trigram with any language.
NEAREST = 0.02
LOW, MARGIN, FEW = 0.01, 0.6, 20
BANDS, BINS, PIECES = BITS + 2, 1000, (1, 2, 4, 8, 16, 32)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def trigram_counts(text: str) -> np.ndarray:
    """How often byte trigrams fall to each hashed place, with a space before and after the text and in place of what is neither letter nor beyond ASCII."""
    data, out = np.frombuffer(b" %b " % text.lower().encode().translate(LETTERS), np.uint8), np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(data) - 2, SLICE):
        a = data[at : at + SLICE + 2].astype(np.uint32)
        x = (a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]) * np.uint32(0x85EBCA6B)
        x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        out += np.bincount((x ^ (x >> np.uint32(16))) >> np.uint32(32 - BITS), minlength=DIMENSIONS)
    return out


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, text in enumerate(texts):
        out[i] = trigram_counts(text)
    np.log1p(out, out=out)
    out *= idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def clusters(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of spherical k-means, started from rows far from each other."""
    mean = rows.mean(0)
    centres = [mean / max(np.linalg.norm(mean), 1e-9)]
    while len(centres) < min(k, len(rows)):
        centres.append(rows[np.max(rows @ np.stack(centres).T, axis=1).argmin()])
    c = np.stack(centres)
    for _ in range(rounds):
        own = (rows @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                mean = rows[own == j].mean(0)
                c[j] = mean / max(np.linalg.norm(mean), 1e-9)
    return c


def pieces(text: str) -> list[str]:
    """The text and, where it is longer, its first words."""
    words = text.split(None, PIECES[-1])
    return [text, *(" ".join(words[:n]) for n in PIECES if n < len(words))]


def limits(seen: np.ndarray) -> np.ndarray:
    """The least cosine of each band, from a language's numbers of rows by band and bin of cosine."""
    rows = seen.sum(1)
    out = np.zeros(BANDS)
    filled = np.flatnonzero(rows)
    if not len(filled):
        return out
    for band in range(BANDS):
        base = min(max(band, filled[0]), filled[-1])
        near = sorted(filled, key=lambda x: (abs(x - base), x))
        n = 1
        while n < len(near) and rows[near[:n]].sum() < FEW:
            n += 1
        pooled = seen[near[:n]].sum(0).cumsum()
        out[band] = MARGIN * np.searchsorted(pooled, max(LOW * pooled[-1], 1)) / BINS * 0.5 ** (max(filled[0] - band, 0) / 2)
    return out


class Centroids:
    def __init__(self, idf: np.ndarray, centres: np.ndarray, languages: list[str]) -> None:
        self.idf, self.centres, self.languages = idf, centres, languages  # a language for each centre
        self.names = sorted(set(languages))
        self.limits = np.zeros((len(self.names), BANDS))

    def cosines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The largest cosine of each text with each language, and each text's band."""
        rows = vectors(texts, self.idf)
        own, cosine = np.array(self.languages), rows @ self.centres.T
        bands = [int(n).bit_length() for n in np.count_nonzero(rows, axis=1)]
        return np.stack([cosine[:, own == n].max(1) for n in self.names], axis=1), np.array(bands)

    def predict(self, texts: list[str | None], block: int = 128) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        out = [("und", 0.0, True)] * len(texts)
        places = [i for i, t in enumerate(texts) if self.names and has_letter(t)]
        for at in range(0, len(places), block):
            part = places[at : at + block]
            best, bands = self.cosines([texts[i] for i in part])
            share = np.exp(20 * (best - best.max(1, keepdims=True)))
            share /= share.sum(1, keepdims=True)
            for i, row, b, band in zip(part, share, best, bands, strict=True):
                j = int(b.argmax())
                out[i] = (self.names[j], float(row[j]), bool(b[j] < max(NEAREST, self.limits[j, band])))
        return out


def fit(docs: DataFrame, sample: int = 300, sample_bytes: int = 32_768, modulus: int = 5, held_out_rest: int = 0) -> Centroids:
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where(learns("doc_id", modulus, held_out_rest) & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def frequencies(batches):
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        by_language: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[trigram_counts(text) > 0] += 1
                by_language[lang] = by_language.get(lang, 0) + 1
                n += 1
        names = [None] * DIMENSIONS + list(by_language)
        yield pa.RecordBatch.from_arrays([pa.array([*range(DIMENSIONS), *[-1] * len(by_language)], pa.int32()), pa.array(names, pa.string()), pa.array([*seen.tolist(), *by_language.values()], pa.int64())], ["place", "lang", "n"])

    found = rows.select("text", "lang").mapInArrow(lean(frequencies), "place int, lang string, n long").groupBy("place", "lang").agg(F.sum("n").alias("n")).collect()  # DIMENSIONS rows and one a language
    counts = {r.lang: r.n for r in found if r.place < 0}
    df = np.zeros(DIMENSIONS)
    for r in found:
        if r.place >= 0:
            df[r.place] = r.n
    total = sum(counts.values())
    idf = (np.log((1 + total) / (1 + df)) + 0.1).astype(np.float32)
    if not counts:
        return Centroids(idf, np.zeros((0, DIMENSIONS), np.float32), [])
    # rows of each language that come into question are about four times the sample, found by their hash alone
    spread = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000))
    share = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 4 * sample / n) if n > 8 * sample else 1.0))))
    some = rows.where((spread < 1_000_000 * F.element_at(share, F.col("lang"))) & (F.octet_length("text") <= sample_bytes))
    first = some.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(spread, "doc_id", "text"))).where(F.col("nth") <= sample)
    texts: dict[str, list[str]] = {}
    for r in first.select("lang", "text").collect():
        texts.setdefault(r.lang, []).append(r.text)
    centres, names = [], []
    for lang in sorted(texts):
        c = clusters(vectors(texts[lang], idf), CLUSTERS)
        centres.append(c)
        names += [lang] * len(c)
    model = Centroids(idf, np.concatenate(centres) if centres else np.zeros((0, DIMENSIONS), np.float32), names)
    learn_limits(rows, model)
    return model


def learn_limits(rows: DataFrame, model: Centroids, block: int = 128) -> None:
    """Set the model's limits from all ``rows`` (text, lang) of its languages that have a letter."""
    if not model.names:
        return

    def spread(batches):
        seen = np.zeros((len(model.names), BANDS, BINS), np.int64)
        for batch in batches:
            part = [(x, model.names.index(n)) for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if n in model.names and t for x in pieces(t) if has_letter(x)]
            for at in range(0, len(part), block):
                cosine, bands = model.cosines([t for t, _ in part[at : at + block]])
                for (_, j), row, band in zip(part[at : at + block], cosine, bands, strict=True):
                    seen[j, band, min(max(int(row[j] * BINS), 0), BINS - 1)] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen.ravel()[at], pa.int64())], ["place", "n"])

    seen = np.zeros(len(model.names) * BANDS * BINS, np.int64)
    for r in rows.select("text", "lang").mapInArrow(lean(spread), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():  # bins alone
        seen[r.place] = r.n
    model.limits = np.stack([limits(x) for x in seen.reshape(len(model.names), BANDS, BINS)])


def predict(docs: DataFrame, model: Centroids, prefix: str = "lang_") -> DataFrame:
    """``docs`` with pred, score and rejected, named with ``prefix``; its other columns stay as they are, those of these names are replaced."""
    new = {f"{prefix}pred": "string", f"{prefix}score": "double", f"{prefix}rejected": "boolean"}
    names = [c for c in docs.columns if c.lower() not in new]
    rows = docs.select(*(F.col(f"`{c}`") for c in names))
    at, schema = names.index("text"), StructType([*rows.schema.fields])
    for c, kind in new.items():
        schema = schema.add(c, kind)

    def run(batches):
        for batch in batches:
            found = model.predict(batch.column(at).to_pylist())
            columns = [pa.array([r[i] for r in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *new])

    return rows.mapInArrow(lean(run), schema)


def keep_known(docs: DataFrame, model: Centroids) -> DataFrame:
    """The documents that aren't rejected, with their own columns."""
    own = f"{uuid.uuid4().hex}_"
    return predict(docs, model, own).where(~F.col(f"{own}rejected")).select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_centroid_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (~learns("doc_id", 5, 0)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
