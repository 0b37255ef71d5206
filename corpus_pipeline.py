"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before it kept, as ``docs``, and its decisions take
effect: documents in a language that isn't known go, documents of low quality go,
lines that an earlier document has go, one document of each group of near copies
stays, and the rest is packed. Stages are written as Parquet in the shared folder
and read again, so a lost executor costs a task, and a failed stage starts from
its predecessor's files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.llm import byte_cnn, centroid_langid, line_dedup, ngram_join, packing
from sedimark.llm.common import materialise, small_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: a null text, one without a letter, and one far from every language go; rows alike stay as often as they occur; very long texts are read whole; an empty table stays empty."""
    return centroid_langid.keep_known(docs, centroid_langid.fit(docs)).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, empty ones judged like others; rows alike stay as often as they occur; very long texts are read whole; an empty table stays empty."""
    return byte_cnn.keep_good(docs, byte_cnn.fit(docs, table(spark, sf_dir, "labels"))).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those of which nothing is left go, while those that lost nothing stay, blank or null. Rows without a doc_id keep all lines; of rows with one doc_id none is earlier."""
    with small_batches(spark):
        left = line_dedup.dedup_lines(docs)
    return left.where(F.col("places").isNull() | (F.length(F.trim("text")) > 0)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest doc_id: five words a shingle, a similarity of 0.8 or more.

    Rows are told apart by all their columns, not by doc_id: those without a
    doc_id take part and come last in their group; of rows that share a doc_id,
    those with unlike texts are judged each by its own text, and a tie for the
    smallest doc_id leaves one; rows alike in all columns count as one. Rows
    without words are near to none.
    """
    rows = docs.withColumn("row", F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS)))
    with small_batches(spark):
        near = ngram_join.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), 5, 80, 100)
    groups = near.groupBy(F.col("doc_id").alias("row")).agg(F.min("component_id").alias("component_id"))
    ids = rows.groupBy("row").agg(F.min("doc_id").alias("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    kept = groups.join(ids.hint("merge"), "row").groupBy("component_id").agg(first.alias("first")).select("first.row")
    return rows.join(kept.hint("merge"), "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens: a null or empty text is its closing id alone, repeated rows are packed as often as they occur, very long texts fill sequences of their own, an empty table gives no row."""
    import public_tokenizers

    with small_batches(spark):
        return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("quality", quality), ("lines", lines), ("near_copies", near_copies), ("packing", sequences)]

#: The classifiers learn their weights, which SQL can't express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
