"""Quality rules of documents and of the hosts that they come from, in DataFrame functions alone.

*Documents.* Each text is read once, inside its row: words are split off, and a
count is taken of their characters, of symbols, of lines that repeat an earlier
line, and of words in five-word windows that occur twice or more. For the last,
window hashes are put in order with their places; only texts that have a repeated
hash at all are sorted, and the places of repeated windows then give the number of
words that they cover. Windows are held as 64-bit hashes. No row leaves its task
before these counts are made, so nothing of a text is shuffled.

*Hosts.* Failures of each rule are summed by host, inside tasks first, so a host
that holds a third of all rows is one row a task. A host's rate of failure is shrunk:
the rates of all hosts give a beta prior by the method of moments (what they differ
beyond sampling), and a host's rate is its posterior mean. A host with
a shrunk rate over ``limit`` in any rule is rejected, with all its documents.

*Verdicts* are joined back to the documents by host: by broadcast where Spark finds
the written table of rejected hosts small enough, else by a sorted join, whose large
partitions Spark splits.

Defined cases: a null text counts as an empty one, fails the rule of length and has
no symbols or repeats; a document without a host is judged by its own rules alone
and tells nothing of any host; rows that share a doc_id are rows of their own, and
repeated rows count as often as they occur; of equal lines each but the first
counts; very long texts are read whole (memory of a few times the text in its own
row); an empty table gives no row, and so does a table of hosts without documents;
other columns of the input play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import materialise, table

#: Characters between words, symbols, words of a window, and the least number of words.
SPACE, SYMBOLS, WINDOW, LEAST_WORDS = " \t\n\x0b\x0c\r", "[#*$%&|<>]", 5, 10
#: Percent of words in repeated windows over which a document fails.
REPEATS = 20
#: Percent over which the rules that judge hosts alone count a document: symbols of all characters of words, repeated lines of all lines with a word.
HOST_SYMBOLS, HOST_LINES = 10, 30
#: Shrunk rate of failure over which a host is rejected.
LIMIT = 0.5
RULES = ["length", "repeats", "symbols", "lines"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))  # a function of one argument: transform gives others the place


def words(text: Column) -> Column:
    """The words of a text; none if it is empty."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def window_hashes(w: Column, size: int = WINDOW) -> Column:
    """A hash of each window of ``size`` words; none if there are fewer words."""
    last = F.size(w) - size
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))
    return F.when(last >= 0, hashes).otherwise(F.array().cast("array<long>"))


def covered(hashes: Column, size: int = WINDOW) -> Column:
    """How many places the windows of ``size`` cover whose hash occurs more than once."""

    def of_places(p: Column) -> Column:
        ends = F.transform(p, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - x, F.lit(size))))
        return F.aggregate(ends, F.lit(0).cast("long"), lambda s, x: s + x)

    def repeated(s: Column) -> Column:
        twin = F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"]))
        return let(F.sort_array(F.filter(twin, lambda x: x.isNotNull())), of_places)

    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(F.sort_array(pairs), repeated))


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def counts(docs: DataFrame) -> DataFrame:
    """(doc_id, host, n_lines and COUNTS) of ``docs`` (doc_id, host, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    filled = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    of_words = let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        let(window_hashes(w), covered).alias("n_repeat_words"),
    ))
    of_lines = let(filled, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), n_dup_lines(x).alias("n_dup_lines")))
    rows = docs.select("doc_id", "host", of_words.alias("w"), of_lines.alias("l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    return rows.select("doc_id", "host", "l.n_lines", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words")


def failures() -> dict[str, Column]:
    """Which of RULES a row of counts fails."""
    return {
        "length": F.col("n_words") < LEAST_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEATS * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > HOST_SYMBOLS * F.col("word_chars"),
        "lines": 100 * F.col("n_dup_lines") > HOST_LINES * F.col("n_lines"),
    }


def base_failed() -> Column:
    fails = failures()
    return fails["length"] | fails["repeats"]


def host_rates(counted: DataFrame) -> DataFrame:
    """(host, n_docs and, for each rule, failures and shrunk rate) of rows of ``counts``.

    The prior of a rule is beta(a, b) with mean m = a / (a + b), the rate of all rows,
    and r = 1 / (a + b + 1), the correlation of two rows of one host. With n rows and
    rate p in each of H hosts and N rows in all, the expected value of
    sum(n (p - m)^2) / m(1 - m) is r (N - sum(n^2) / N) + (1 - r)(H - 1), which gives
    r. Where nothing speaks for a difference between hosts (r not above 0, or all hosts
    of one row), all get m.
    """
    fails = failures()
    sums = counted.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n_docs"), *(F.count_if(c).alias(f"{r}_failed") for r, c in fails.items()))
    # shared by the two passes below: one row a host
    sums = materialise(sums, "hosts")
    n = F.col("n_docs")
    totals = sums.agg(F.count("*").alias("hosts"), F.sum("n_docs").alias("rows"), F.sum(n.cast("double") * n).alias("squares"), *(F.sum(f"{r}_failed").alias(f"{r}_all") for r in RULES))  # one row
    sums = sums.crossJoin(F.broadcast(totals))
    mean = {r: F.col(f"{r}_all") / F.col("rows") for r in RULES}
    apart = sums.agg(*(F.sum(n * (F.col(f"{r}_failed") / n - mean[r]) ** 2).alias(f"{r}_apart") for r in RULES))  # one row

    def shrunk(r: str) -> Column:
        m, less = mean[r], F.col("hosts") - 1
        alike = (F.try_divide(F.col(f"{r}_apart"), m * (1 - m)) - less) / F.nullif(F.col("rows") - F.col("squares") / F.col("rows") - less, F.lit(0.0))
        strength = 1 / F.least(alike, F.lit(1.0)) - 1
        return F.when(alike > 0, (m * strength + F.col(f"{r}_failed")) / (strength + n)).otherwise(m)

    return sums.crossJoin(F.broadcast(apart)).select("host", "n_docs", *(x for r in RULES for x in (F.col(f"{r}_failed"), shrunk(r).alias(f"{r}_rate"))))


def judged(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(doc_id, host, COUNTS, base_failed, host_rejected, kept) of ``docs`` (doc_id, host, text)."""
    counted = materialise(counts(docs), "counts")
    bad = F.lit(False)
    for r in RULES:
        bad = bad | (F.col(f"{r}_rate") > limit)
    rejected = materialise(host_rates(counted).where(bad).select("host", F.lit(True).alias("rejected")), "rejected")
    rows = counted.withColumn("base_failed", base_failed()).join(rejected, "host", "left")
    out = F.coalesce("rejected", F.lit(False))
    return rows.select("doc_id", "host", *COUNTS, "base_failed", out.alias("host_rejected"), (~F.col("base_failed") & ~out).alias("kept"))


def op12_host_rules(spark, sf_dir: str) -> DataFrame:
    """All documents with their counts and verdicts; the source of a document is its host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").cast("string").alias("host"), "text")
    return judged(docs).drop("host")


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
cut AS (SELECT r, doc_id, host, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs),
wins AS (SELECT r, i, w[i:i+4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM cut WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
spots AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) t(k) GROUP BY r),
counted AS (
  SELECT doc_id, host, len(l) AS n_lines, len(w)::BIGINT AS n_words, length(list_aggregate(list_append(w, ''), 'string_agg', ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(s.n, 0)::BIGINT AS n_repeat_words
  FROM cut LEFT JOIN spots s USING (r)),
fails AS (SELECT *, n_words < 10 AS f1, 100 * n_repeat_words > 20 * n_words AS f2, 100 * n_symbols > 10 * word_chars AS f3, 100 * n_dup_lines > 30 * n_lines AS f4 FROM counted),
hosts AS (SELECT host, rule, count(*) AS n, count(*) FILTER (failed) AS k
  FROM (SELECT host, unnest([1, 2, 3, 4]) AS rule, unnest([f1, f2, f3, f4]) AS failed FROM fails WHERE host IS NOT NULL) GROUP BY ALL),
total AS (SELECT rule, count(*) - 1 AS less, sum(n) AS rows, sum(n::DOUBLE * n) AS squares, sum(k) / sum(n) AS m FROM hosts GROUP BY rule),
prior AS (SELECT rule, any_value(m) AS m, (sum(n * (k / n - m) ** 2) / nullif(any_value(m * (1 - m)), 0) - any_value(less)) / nullif(any_value(rows - squares / rows - less), 0) AS alike
  FROM hosts JOIN total USING (rule) GROUP BY rule),
rates AS (SELECT host, CASE WHEN alike > 0 THEN (m * s + k) / (s + n) ELSE m END AS rate
  FROM (SELECT host, k, n, m, alike, 1 / least(nullif(alike, 0), 1) - 1 AS s FROM hosts JOIN prior USING (rule))),
rejected AS (SELECT host FROM rates GROUP BY host HAVING max(rate) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, x.host IS NOT NULL AS host_rejected, NOT (f1 OR f2) AND x.host IS NULL AS kept
FROM fails LEFT JOIN rejected x ON x.host = fails.host
"""
