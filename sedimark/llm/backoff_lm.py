"""Language-model scores by stupid backoff, computed relationally.

Words are cut at ASCII white space, A-Z lower-cased. The score of a document is
the sum over its words of log S(v | u), u the word before v:

    S = c(uv) / c(u)          where the pair occurs in other documents,
    S = 0.4 * c(v) / N        else (and for a document's first word without 0.4),

with counts over all *other* documents, so that no document is evidence for
itself, and c(v) taken as 1 for words that occur nowhere else.

The relations are held in blocks of documents and travel as sorted arrays, several
times smaller than rows of one n-gram each. Each block sends its distinct n-grams
with their counts, pre-aggregated, to the partitions of the count table by the
n-gram's hash; a partition adds up the counts and answers each block; a block's
answers join its exploded n-grams, whose scores are summed for each document. A
frequent n-gram is one entry a block, so it weighs no more than a rare one, and
what travels grows with the text.

A task holds one partition of the table at a time. There are as many as it takes
to ask each of them for at most ``PART_BYTES``, counting ``BYTES_ASKED`` for each
byte of text, so a partition doesn't grow with the corpus.

A block is named by its contents, and an answer carries the digest of the n-grams
that it was asked for. So answers find their block wherever and in whatever order
either was computed, a retried task included; should a second scan deal the rows
into other blocks, the join fails with an error instead of giving counts to other
n-grams.

Defined cases: a null text or one without words has no score (0 words, score 0);
repeated rows are documents of their own; a table of one document scores against
nothing, all its words unseen; an empty table gives no row; very long texts are
blocks of their own; rows without a doc_id are scored like others; other columns
are left out.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import materialise, shuffle_partitions, table
from sedimark.llm.ngram_join import ODD, _blocks, mix, word_hashes

BACKOFF = 0.4
#: Of one word of a letter and the blank after it: the keys and counts of the word and of a pair. What is asked for is less by what repeats in a block.
BYTES_ASKED = 12
PART_BYTES = 256 << 20
ANSWER = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("words", pa.int64()), ("digest", pa.int64()), ("totals", pa.binary())])
_M = np.uint64


class Grams:
    """Distinct n-grams of a block: sorted keys with counts, and each word's place among them."""

    def __init__(self, texts: list[bytes | None]) -> None:
        words, self.edges = word_hashes(texts)
        ones = mix(words ^ ODD)
        twos = mix((words[:-1] * ODD + words[1:]) * _M(0xD6E8FEB86659FD93) + _M(2)) if len(words) else words
        first = np.zeros(len(words), bool)
        first[self.edges[:-1][self.edges[:-1] < self.edges[1:]]] = True
        inner = ~first[1:]  # pairs within a document
        self.first = first
        self.keys, places = np.unique(np.concatenate([ones, twos[inner]]), return_inverse=True)
        self.counts = np.bincount(places, minlength=len(self.keys)).astype(np.uint32)
        self.one = places[: len(words)]
        self.two = np.full(len(words), -1)
        self.two[1:][inner] = places[len(words) :]

    def parts(self, parts: int) -> np.ndarray:
        """Edges of each table partition's keys."""
        return np.concatenate([[0], np.searchsorted(self.keys, np.array([(j << 64) // parts for j in range(1, parts)], np.uint64)), [len(self.keys)]])

    def scores(self, totals: np.ndarray, words_in_all: int):
        """(words, pairs seen elsewhere, score) of each document."""
        for a, b in zip(self.edges[:-1], self.edges[1:], strict=True):
            if a == b:
                yield 0, 0, 0.0
                continue
            own, at, n = np.unique(np.concatenate([self.one[a:b], self.two[a + 1 : b]]), return_inverse=True, return_counts=True)
            rest = (totals[own] - n).astype(np.float64)
            single, pair = rest[at[: b - a]], rest[at[b - a :]]
            base = np.log(np.maximum(single, 1)) - np.log(max(words_in_all - (b - a), 1))
            seen = pair > 0
            inner = np.where(seen, np.log(np.where(seen, pair, 1)) - np.log(np.maximum(single[:-1], 1)), np.log(BACKOFF) + base[1:])
            yield b - a, int(seen.sum()), float(base[0] + inner.sum())


def _named(batches):
    """(block, ids, texts): a block's name is the digest of what it holds."""
    for ids, texts in _blocks(batches):
        name = blake2b(digest_size=8)
        for i, t in zip(ids, texts, strict=True):
            name.update(f"{i} {-1 if t is None else len(t)} ".encode())
            name.update(t or b"")
        yield int.from_bytes(name.digest(), "little", signed=True), ids, texts


def _digest(keys: np.ndarray) -> int:
    """Of a sorted part of a block's n-grams, as a signed integer."""
    return int(mix(np.array([np.add.reduce(mix(keys), dtype=np.uint64) + _M(len(keys))], np.uint64)).view(np.int64)[0])


def table_parts(rows: DataFrame) -> int:
    """Partitions of the count table for ``rows`` (text as binary): the session's number, or more if these would be asked for too much."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first().n
    return max(shuffle_partitions(rows.sparkSession), -(-BYTES_ASKED * size // PART_BYTES))


def score(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_seen, score) of each row of ``docs``, with a count table of ``parts`` partitions (None: as many as its text needs)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    parts = parts or table_parts(rows)

    def ask(batches):
        for block, _, texts in _named(batches):
            g = Grams(texts)
            e = g.parts(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(parts, block), pa.int64()), pa.array(range(parts), pa.int32()), pa.array([len(g.one), *[0] * (parts - 1)], pa.int64()), pa.array([g.keys[x:y].tobytes() for x, y in zip(e[:-1], e[1:], strict=True)], pa.binary()), pa.array([g.counts[x:y].tobytes() for x, y in zip(e[:-1], e[1:], strict=True)], pa.binary())],
                ["block", "part", "words", "keys", "counts"],
            )

    def count(batches):
        """One part of the table after the other."""

        def answer(held):
            keys = np.concatenate([np.frombuffer(k, np.uint64) for _, _, _, k, _ in held])
            _, places = np.unique(keys, return_inverse=True)
            totals = np.bincount(places, np.concatenate([np.frombuffer(c, np.uint32) for *_, c in held]))[places] if len(keys) else np.zeros(0)
            at, out = 0, []
            for block, part, words, k, _ in held:
                out.append((block, part, words, _digest(np.frombuffer(k, np.uint64)), totals[at : at + len(k) // 8].astype(np.uint64).tobytes()))
                at += len(k) // 8
                if len(out) == 64 or at == len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ANSWER.types, strict=True)], ANSWER.names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ANSWER.types, strict=True)], ANSWER.names)

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][1] != row[1]:
                    yield from answer(held)
                    held = []
                held.append(row)
        if held:
            yield from answer(held)

    asked = rows.mapInArrow(ask, "block long, part int, words long, keys binary, counts binary")
    answers = asked.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(count, "block long, part int, words long, digest long, totals binary")
    answers = materialise(answers, "totals")
    words_in_all = answers.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first().n

    def blocks(batches):
        for block, ids, texts in _named(batches):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([parts], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary()))], ["block", "part", "digest", "totals", "ids", "texts"])

    def finish(batches):
        def close(block, ids, texts, answers):
            g = Grams(texts)
            edges = g.parts(parts)
            if sorted(answers) != list(range(parts)) or any(answers[j][0] != _digest(g.keys[x:y]) for j, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True))):
                raise ValueError(f"the answers for block {block} aren't those of its n-grams")
            found = np.frombuffer(b"".join(answers[j][1] for j in range(parts)), np.uint64).astype(np.int64)
            n, seen, s = zip(*g.scores(found, words_in_all), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(seen, pa.int64()), pa.array(s, pa.float64())], ["doc_id", "n_words", "n_seen", "score"])

        # a block's answers come first, then its texts, as often as there are blocks of these contents
        at, answers = None, {}
        for batch in batches:
            for block, part, digest, total, ids, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != at:
                    at, answers = block, {}
                if part < parts:
                    answers[part] = (digest, total)
                else:
                    yield close(block, ids, texts, answers)

    schema = "block long, part int, digest long, totals binary, ids array<long>, texts array<binary>"
    back = answers.selectExpr("block", "part", "digest", "totals", "cast(null as array<long>) as ids", "cast(null as array<binary>) as texts")
    both = rows.mapInArrow(blocks, schema).unionByName(back).repartition(parts, "block").sortWithinPartitions("block", "part")
    return both.mapInArrow(finish, "doc_id long, n_words long, n_seen long, score double")


def op7_backoff_lm(spark, sf_dir: str) -> DataFrame:
    """Every document against all others; scores to four decimals."""
    found = score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_seen", F.round("score", 4).alias("score"), F.round(F.col("score") / F.greatest("n_words", F.lit(1)), 4).alias("mean_score"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS v FROM d),
b AS (SELECT doc_id, i, v, lag(v) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM t),
c AS (
  SELECT *, count(*) OVER (PARTITION BY v) - count(*) OVER (PARTITION BY doc_id, v) AS cv,
    count(*) OVER (PARTITION BY u, v) - count(*) OVER (PARTITION BY doc_id, u, v) AS cuv,
    count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n FROM b
), u AS (SELECT v, count(*) AS c FROM t GROUP BY 1), own AS (SELECT doc_id, v, count(*) AS c FROM t GROUP BY 1, 2),
s AS (
  SELECT c.doc_id, CASE WHEN c.u IS NOT NULL AND cuv > 0 THEN 1 ELSE 0 END AS seen,
    CASE WHEN c.u IS NULL THEN ln(greatest(cv, 1)) - ln(greatest(n, 1))
         WHEN cuv > 0 THEN ln(cuv) - ln(greatest(u.c - own.c, 1))
         ELSE ln(0.4) + ln(greatest(cv, 1)) - ln(greatest(n, 1)) END AS x
  FROM c LEFT JOIN u ON c.u = u.v LEFT JOIN own ON own.doc_id = c.doc_id AND own.v = c.u
), r AS (SELECT doc_id, count(*) AS n_words, CAST(sum(seen) AS BIGINT) AS n_seen, sum(x) AS x FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_seen, 0) AS n_seen, round(coalesce(x, 0), 4) AS score, round(coalesce(x / n_words, 0), 4) AS mean_score
FROM d LEFT JOIN r USING (doc_id)
"""
