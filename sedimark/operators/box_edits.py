"""Changes of page boxes, and what the pages of a document are. Each change gives the new table; whoever holds it writes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions import geometry as G
from sedimark.functions import text as T

CORNERS = ["x0", "y0", "x1", "y1"]


def _changed(rows: DataFrame, columns: list[str], changes: dict[str, Column]) -> DataFrame:
    return rows.select(*(changes.get(c, F.col(c)).alias(c) for c in columns))


def next_order(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, next): the place of a new box on each page."""
    last = boxes.groupBy("page").agg(F.max("reading_order").alias("last"))
    return pages.join(last, "page", "left").select("page", (F.coalesce("last", F.lit(-1)) + 1).alias("next"))


def create(boxes: DataFrame, new: DataFrame) -> DataFrame:
    """``boxes`` and new ones (page, kind, x0..y1), behind all others of their page, sure, with ids that their contents give."""
    key = F.substring(F.sha2(F.concat_ws("|", "page", "kind", *CORNERS), 256), 1, 6)
    nth = F.row_number().over(Window.partitionBy("page").orderBy(*CORNERS, "kind")) - 1
    rows = new.join(next_order(boxes, new.select("page").distinct()), "page").withColumn("reading_order", (F.col("next") + nth).cast(boxes.schema["reading_order"].dataType))
    made = rows.withColumn("box_id", F.concat(F.lit("p"), "page", F.lit("-u"), key)).withColumn("confidence", F.lit(1.0)).withColumn("manually_activated", F.lit(False))
    return boxes.unionByName(made.drop("next"), allowMissingColumns=True)


def update(boxes: DataFrame, patches: DataFrame) -> DataFrame:
    """``boxes`` with the columns of ``patches`` (box_id, ...) that aren't null in their places."""
    named = [c for c in patches.columns if c != "box_id"]
    joined = boxes.join(patches.select("box_id", F.struct(*named).alias("patch")), "box_id", "left")
    return _changed(joined, boxes.columns, {c: F.coalesce(f"patch.{c}", c) for c in named})


def delete(boxes: DataFrame, asked: DataFrame) -> DataFrame:
    """Deleted boxes stay, as discarded ones."""
    return update(boxes, asked.select("box_id").distinct().withColumn("kind", F.lit("discard")))


def split_at(boxes: DataFrame, cuts: DataFrame) -> DataFrame:
    """``boxes`` with each box of ``cuts`` (box_id, y) in two, above and below y; it is an error if y isn't strictly inside."""
    joined = boxes.join(cuts.select("box_id", F.col("y").cast("double").alias("cut")), "box_id", "left")
    good = F.col("cut").isNull() | ((F.col("y0") < F.col("cut")) & (F.col("cut") < F.col("y1")))
    joined = joined.withColumn("cut", F.when(good, F.col("cut")).otherwise(F.raise_error(F.lit("a cut has to be strictly inside its box")).cast("double")))
    halves = F.when(F.col("cut").isNull(), F.array(F.lit(""))).otherwise(F.array(F.lit("-top"), F.lit("-bottom")))
    named = joined.select("*", F.explode(halves).alias("half"))
    changes = {"box_id": F.concat("box_id", "half"), "y0": F.when(F.col("half") == "-bottom", F.col("cut")).otherwise(F.col("y0")), "y1": F.when(F.col("half") == "-top", F.col("cut")).otherwise(F.col("y1"))}
    return _changed(named, boxes.columns, changes)


def unlink(boxes: DataFrame, asked: DataFrame, down: bool = True) -> DataFrame:
    """``boxes`` (with continues_to, continues_from) without the links of the boxes in ``asked`` (box_id), at both ends; a target that is gone is no error."""
    own, other = ("continues_to", "continues_from") if down else ("continues_from", "continues_to")
    ids = asked.select("box_id").distinct()
    ends = boxes.join(ids, "box_id", "left_semi").select(F.col(own).alias("box_id")).where("box_id is not null").distinct()
    marked = boxes.join(ids.withColumn("asked", F.lit(True)), "box_id", "left").join(ends.withColumn("end", F.lit(True)), "box_id", "left")
    return _changed(marked, boxes.columns, {own: F.when(F.col("asked").isNull(), F.col(own)), other: F.when(F.col("end").isNull(), F.col(other))})


def reset_pages(boxes: DataFrame, detected: DataFrame, pages: DataFrame) -> DataFrame:
    """``boxes`` with all boxes of some pages as they were detected."""
    return boxes.join(pages, "page", "left_anti").select(*boxes.columns).unionByName(detected.join(pages, "page", "left_semi").select(*boxes.columns))


def reset_boxes(boxes: DataFrame, detected: DataFrame, asked: DataFrame) -> DataFrame:
    """``boxes`` with corners, kind and confidence of the asked ones (box_id) as they were detected, not activated and without links. Boxes that weren't detected stay."""
    restored = [*CORNERS, "kind", "confidence"]
    old = detected.join(asked.select("box_id").distinct(), "box_id", "left_semi").select("box_id", F.struct(*restored).alias("old"))
    joined = boxes.join(old, "box_id", "left")
    hit = F.col("old").isNotNull()
    changes = {c: F.when(hit, F.col(f"old.{c}")).otherwise(F.col(c)) for c in restored}
    changes |= {"manually_activated": F.col("manually_activated") & ~hit} | {c: F.when(~hit, F.col(c)) for c in ("continues_to", "continues_from")}
    return _changed(joined, boxes.columns, changes)


def padded(boxes: DataFrame, pages: DataFrame, padding: float = 8.0) -> DataFrame:
    """Crops around boxes in a page's own space, whose y axis points up: (page, box_id, left, bottom, right, top), inside the page (width, height)."""
    j = boxes.join(pages.select("page", "width", "height"), "page")
    left, bottom = F.greatest(F.col("x0") - padding, F.lit(0.0)), F.greatest(F.col("height") - F.col("y1") - padding, F.lit(0.0))
    right, top = F.least(F.col("x1") + padding, F.col("width")), F.least(F.col("height") - F.col("y0") + padding, F.col("height"))
    return j.select("page", "box_id", left.alias("left"), bottom.alias("bottom"), right.alias("right"), top.alias("top"))


def in_points(boxes: DataFrame, dpi: int = 288) -> DataFrame:
    return _changed(boxes, boxes.columns, {c: G.points(F.col(c), dpi) for c in CORNERS})


def reading_order(boxes: DataFrame) -> DataFrame:
    """``boxes`` with ``place``, counted on each page from top to bottom and left to right."""
    return boxes.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0", "box_id")) - 1)


def title_heading(boxes: DataFrame) -> DataFrame:
    """(page, box_id) of the heading that is alone on the first page that has boxes: the document's title. No row if there are several or none."""
    first = boxes.agg(F.min("page").alias("page"))
    found = boxes.where("kind = 'heading'").join(first, "page", "left_semi").groupBy("page").agg(F.min("box_id").alias("box_id"), F.count("*").alias("n"))
    return found.where("n = 1").drop("n")


def title_headings(boxes: DataFrame, key: str = "slug") -> DataFrame:
    """(key, page, box_id): :func:`title_heading` of each document."""
    heading = F.col("kind") == "heading"
    pages = boxes.groupBy(key, "page").agg(F.count_if(heading).alias("n"), F.min(F.when(heading, F.col("box_id"))).alias("box_id"))
    first = pages.groupBy(key).agg(F.min_by(F.struct("page", "n", "box_id"), F.col("page")).alias("f"))
    return first.where("f.n = 1").select(key, "f.page", "f.box_id")


def extracted_pages(boxes: DataFrame) -> DataFrame:
    """(page) of all boxes, by their ids."""
    return boxes.select(T.page_of_box(F.col("box_id")).alias("page")).where("page is not null").distinct()


def page_states(pages: DataFrame, boxes: DataFrame, approved: DataFrame) -> DataFrame:
    """(page, state): approved, else extracted (it has boxes), else no-extraction."""
    seen = extracted_pages(boxes).withColumn("extracted", F.lit(True))
    ok = approved.select("page").distinct().withColumn("approved", F.lit(True))
    state = F.when(F.col("approved"), "approved").when(F.col("extracted"), "extracted").otherwise("no-extraction")
    return pages.join(seen, "page", "left").join(ok, "page", "left").select("page", state.alias("state"))


def page_count(stated: Column, last_with_box: Column) -> Column:
    """A document's pages: as stated, else the last one with a box, else 1."""
    return F.coalesce(F.nullif(stated, F.lit(0)), last_with_box, F.lit(1))
