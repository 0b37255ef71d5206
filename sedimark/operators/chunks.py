"""Paragraphs, elements and section chunks, and the chunk table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions import text as T

#: Roles of page furniture, and those that open a section.
NOISE = ["pageHeader", "pageFooter", "pageNumber", "footnote"]
HEADINGS = ["title", "sectionHeading"]


def without_noise(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs without page furniture; those without a role stay."""
    return paragraphs.where(F.col("role").isNull() | ~F.col("role").isin(NOISE))


def element_type(role):
    return F.when(role.isin(HEADINGS), "heading").otherwise("paragraph")


def section_chunks(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, idx, role, content) into one row a section: text before the first heading is left out, headings without text stay.

    One shuffle by document serves the running count, the title and the grouping.
    """
    rows = without_noise(paragraphs).withColumn("content", T.collapse_spaces(F.col("content"))).where("content <> ''")
    in_order = Window.partitionBy("doc_id").orderBy("idx")
    opens = F.coalesce(F.col("role").isin(HEADINGS), F.lit(False))
    rows = rows.withColumn("section", F.sum(opens.cast("int")).over(in_order)).withColumn("title", F.first(F.when(F.col("role") == "title", F.col("content")), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    body = F.sort_array(F.collect_list(F.when(~opens, F.struct("idx", "content"))))
    sections = rows.where("section > 0").groupBy("doc_id", "section", F.coalesce("title", F.lit("")).alias("title")).agg(F.max(F.when(opens, F.col("content"))).alias("section_heading"), F.array_join(F.transform(body, lambda x: x["content"]), " ").alias("chunk"))
    return sections.select("doc_id", F.format_string("doc-%d-%03d", "doc_id", "section").alias("chunk_id"), "title", "section_heading", "chunk")


Chunker = Callable[[DataFrame], DataFrame]
_CHUNKERS: dict[str, Chunker] = {}


def register_chunker(name: str, chunk: Chunker) -> None:
    """A way to cut paragraphs (doc_id, idx, role, content) into chunks (doc_id, chunk_id, title, section_heading, chunk)."""
    _CHUNKERS[name] = chunk


def chunker(name: str) -> Chunker:
    if name not in _CHUNKERS:
        raise KeyError(f"no chunker is called {name!r}; there are {strategies()}")
    return _CHUNKERS[name]


def strategies() -> list[str]:
    return sorted(_CHUNKERS)


register_chunker("section", section_chunks)


def drifted(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(entry_id) of entries (entry_id, chunk_hashes map) whose chunks are gone or changed (chunks: chunk_id, chunk)."""
    wanted = entries.select("entry_id", F.explode("chunk_hashes").alias("chunk_id", "hash"))
    there = chunks.select("chunk_id", T.content_hash(F.col("chunk")).alias("now"))
    return wanted.join(there, "chunk_id", "left").where(F.col("now").isNull() | (F.col("now") != F.col("hash"))).select("entry_id").distinct()


def replace_by_source(table: DataFrame, batch: DataFrame, key: str = "source") -> DataFrame:
    """``table`` with all rows of the batch's sources replaced by the batch."""
    return table.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch.select(*table.columns))


def upsert(table: DataFrame, batch: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``table`` with the batch's rows in place of those of the same key; of rows of the batch with one key the last by ``order`` (or by its columns) counts."""
    last = [F.desc(order)] if order else [F.desc(c) for c in table.columns if c != key]
    new = batch.withColumn("nth from last", F.row_number().over(Window.partitionBy(key).orderBy(*last))).where("`nth from last` = 1")
    return table.join(new.select(key), key, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


#: Fixed value: the least number of rows that a sample of a ranked list is drawn from.
CANDIDATES = 100


def seeded_sample(rows: DataFrame, n: int, seed: int, key: str, rank: list[Column] | None = None) -> DataFrame:
    """n rows in an order that the seed alone decides; with ``rank`` they are drawn from the first max(n, CANDIDATES) rows in that order."""
    if n <= 0:
        raise ValueError("a sample needs a positive size")
    if rank:
        rows = rows.orderBy(*rank, key).limit(max(n, CANDIDATES))
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)
