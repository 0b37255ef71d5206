"""Spelling variants of a corpus's words, found by rolling-hash deletions.

*Words.* Maximal runs of letters (``A-Z``, ``a-z``, U+00C0 to U+00FF) with A-Z
lower-cased, of all texts. A run of one row in about ``MISSPELT`` loses one code
point, chosen by a checksum of row and run. Runs are counted inside each task
first, so a word that all texts have crosses the shuffle once a task.

*Keys.* A word's polynomial hash splits at any place into a prefix's and a suffix's
hash, and with one multiplication the suffix moves up by a place: all deletions of
all words of a block are a few numpy operations on integers. Deletion rows
(key, place, word's key) and one row for each whole word are dealt out by the
leading bits of their key (its radix) and sorted by key. Rows whose key nobody
shares fall away there, as integers; only the rest meets strings.

*Verification.* Rows that are left get their words by a join and are grouped by key
again. Words of one class (the same string left, the same place deleted) differ by
one replaced code point; a whole word and a deletion that equals it by an inserted
one. Classes are built from strings, so hashes that collide change nothing. A class
has at most one word for each letter (a whole word's: one for each letter and
place). No pairs are made: a class gives each member its number of neighbours and
the best other member, and these are summed by word.

*Roots.* A form has at least twice its word's count, so chains are short; they are
followed by joining the table of forms with itself, which doubles the step each
time.

Defined cases: a null text has no words; a null doc_id counts as an empty one in
the checksum; rows that share a doc_id, or are alike in all columns, count as often
as they occur; very long texts and very long runs are read whole (a run of L code
points makes L rows of three integers); ties for a form go to the word first in
code-point order; an empty table gives no row; other columns of the input play no
part, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import materialise, table

#: A checksum that this divides marks a run that loses a code point; the least length and count of a word; how many times a word's count its form has at least.
MISSPELT, LEAST_LENGTH, LEAST_COUNT, TIMES = 97, 5, 3, 2
#: Bytes of distinct words that a task counts before it hands them on.
HELD_BYTES = 1 << 25
#: Code points whose deletions are made at once.
BLOCK = 1 << 18
#: Leading bits of a key by which rows are dealt out.
RADIX_BITS = 16

_M = np.uint64
BASE = _M(0xD6E8FEB86659FD93)
BASE_INVERSE = _M(pow(int(BASE), -1, 1 << 64))
VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * _M(2) + _M(1)


def misspelt(doc_id: int | None, counts: dict[bytes, int]) -> Iterator[tuple[bytes, int]]:
    """(word, count) of a document's runs (Latin-1, a byte for each code point), some with one code point less."""
    seed = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    seed = zlib.crc32(b":", seed)
    for run, n in counts.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
        if h % MISSPELT == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n, word_key) of ``docs`` (doc_id, text)."""
    # deletions only shorten, so shorter runs can't count
    runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least_length)

    def count(batches):
        held: Counter[bytes] = Counter()
        size = 0

        def out():
            words = [w.decode("latin-1") for w in held]
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # a byte for each code point; what Latin-1 lacks is no letter here
                letters = (text.as_py() or "").encode("latin-1", "replace").lower()
                own: Counter[bytes] = Counter(m.group() for m in runs.finditer(letters)) if len(letters) > HELD_BYTES else Counter(runs.findall(letters))
                for word, n in misspelt(doc_id, own):
                    if len(word) >= least_length:
                        if word not in held:
                            size += len(word) + 100
                        held[word] += n
                if size > HELD_BYTES:
                    size = 0
                    yield out()
        yield out()

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count).withColumn("word_key", F.xxhash64("word"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _M(32))) * _M(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _M(32))) * _M(0xD6E8FEB86659FD93)
    return x ^ (x >> _M(32))


def deletion_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, leads, index of the word) of each whole word (place -1) and of each of its deletions.

    ``leads`` is false where the code point before is the same one, so that the
    deletion repeats the one before it.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    own = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    place = np.arange(len(data)) - starts[own]
    powers = np.multiply.accumulate(np.full(int(sizes.max(initial=0)) + 1, BASE))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUES[data] * powers[place])])
    prefix = upto[:-1] - upto[starts][own]
    suffix = upto[ends][own] - upto[1:]
    whole = upto[ends] - upto[starts]
    leads = np.ones(len(data), bool)
    leads[1:] = (data[1:] != data[:-1]) | (place[1:] == 0)
    keys = np.concatenate([whole, prefix + suffix * BASE_INVERSE])
    return _mix(keys).view(np.int64), np.concatenate([np.full(len(words), -1), place]), np.concatenate([np.ones(len(words), bool), leads]), np.concatenate([np.arange(len(words)), own])


ROWS = "key long, place int, leads boolean, word_key long"
FIELDS = ["key", "place", "leads", "word_key"]


def all_keys(vocabulary: DataFrame) -> DataFrame:
    """A row of ROWS for each word and each of its deletions."""

    def run(batches):
        for batch in batches:
            texts, word_keys = [w.encode("latin-1") for w in batch.column(0).to_pylist()], np.asarray(batch.column(1))
            edges = np.concatenate([[0], np.cumsum([len(w) + 1 for w in texts])])
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(edges, edges[at] + BLOCK, "right")) - 1)
                key, place, leads, own = deletion_keys(texts[at:end])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(place.astype(np.int32)), pa.array(leads), pa.array(word_keys[at:end][own])], FIELDS)
                at = end

    return vocabulary.select("word", "word_key").mapInArrow(run, ROWS)


def dealt(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` dealt out by the radix of their key, in order of key inside a partition."""
    return rows.repartition(F.shiftright("key", 64 - RADIX_BITS)).sortWithinPartitions("key", *order)


def shared(rows: DataFrame) -> DataFrame:
    """Of the rows of ROWS those that may meet another word: with a whole word of their key, or with a deletion of the same place."""

    def survivors(key, place, leads):
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        has_whole = (place[first] == -1)[group]
        size = np.diff(np.append(first, len(key)))[group]
        twin = np.zeros(len(key), bool)
        same = ~new[1:] & (place[1:] == place[:-1])
        twin[1:] |= same
        twin[:-1] |= same
        return (twin & (place >= 0)) | (has_whole & (size > 1) & leads)

    def run(batches):
        left = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if left is None else [left, batch]).combine_chunks()
            key = np.asarray(rows["key"])
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if cut:
                yield from rows.slice(0, cut).filter(pa.array(survivors(*(np.asarray(rows[c])[:cut] for c in FIELDS[:3])))).to_batches()
            left = rows.slice(cut).combine_chunks().to_batches()[0]
        if left is not None:
            yield from pa.Table.from_batches([left]).filter(pa.array(survivors(*(np.asarray(left[c]) for c in FIELDS[:3])))).to_batches()

    return dealt(rows, "place").mapInArrow(run, ROWS)


NEAR = "word string, n_near long, form_n long, form string"


def class_rows(members: list[tuple[int, str]]) -> Iterator[tuple[str, int, int, str]]:
    """NEAR rows of words (n, word) that are all near each other."""
    ranked = sorted(members, key=lambda x: (-x[0], x[1]))
    for i, (_, word) in enumerate(ranked):
        yield (word, len(ranked) - 1, *ranked[1 if i == 0 else 0])


def group_rows(rows: list[tuple[int, int, bool, str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """NEAR rows from the rows (key, place, leads, word, n) of one key, by their strings."""
    replaced: dict[tuple[int, str], list] = {}
    inserted: dict[str, list] = {}
    whole = {}
    for _, place, leads, word, n in rows:
        if place < 0:
            whole[word] = n
            continue
        rest = word[:place] + word[place + 1 :]
        replaced.setdefault((place, rest), []).append((n, word))
        if leads:
            inserted.setdefault(rest, []).append((n, word))
    for members in replaced.values():
        if len(members) > 1:
            yield from class_rows(members)
    for word, n in whole.items():
        longer = inserted.get(word)
        if longer:
            yield (word, len(longer), *min(longer, key=lambda x: (-x[0], x[1])))
            yield from ((other, 1, n, word) for _, other in longer)


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best: negative count and word of the best neighbour) of the words that have any."""
    rows = shared(all_keys(vocabulary)).join(vocabulary.hint("merge"), "word_key").select("key", "place", "leads", "word", "n")

    def each(batches):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches):
        out: list[tuple] = []

        def close():
            columns = zip(*out, strict=True) if out else [()] * 4
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "form_n", "form"])
            out.clear()
            return batch

        for _, rows in groupby(each(batches), key=itemgetter(0)):
            for row in group_rows(list(rows)):
                out.append(row)
                if len(out) >= 20_000:
                    yield close()
        yield close()

    found = dealt(rows).mapInArrow(run, NEAR)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("minus"), "form")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last word of each chain of forms."""
    up = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not up.where("moved").isEmpty():
        above = up.select(F.col("word").alias("at"), F.col("root").alias("next"))
        up = materialise(up.join(above.hint("merge"), F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return up.drop("moved")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of ``docs`` (doc_id, text)."""
    vocabulary = materialise(words(docs, least_length, least_count), "words")
    own = vocabulary.select("word", "n").join(neighbours(vocabulary).hint("merge"), "word", "left")
    counted = -F.col("best.minus")
    known = materialise(own.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(counted >= times * F.col("n"), F.col("best.form")).alias("form"), F.when(counted >= times * F.col("n"), counted).alias("form_n")), "forms")
    ends = roots(known.where("form is not null"))
    return known.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """All words of all documents with their forms and roots."""
    return variants(table(spark, sf_dir, "documents"))


#: The checksum is built byte by byte from its polynomial (0xEDB88320, a fixed value).
ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY ALL),
bytes AS (SELECT doc_id, run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs WHERE length(run) >= 5),
sums AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda j: ('0x' || substr(x, j, 2))::BIGINT)),
      lambda acc, b: xor(acc // 256, t[xor(acc, b) % 256 + 1])), 4294967295) AS h
  FROM bytes, crc),
words AS (
  SELECT w AS word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS w, n FROM sums)
  WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)),
near AS (
  SELECT a.word, b.word AS form, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.top >= 2 * w.n THEN b.top END AS form_n,
    CASE WHEN b.top >= 2 * w.n THEN (SELECT min(x.form COLLATE "C") FROM near x WHERE x.word = w.word AND x.n = b.top) END AS form
  FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n::BIGINT AS form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
