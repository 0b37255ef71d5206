"""Pages as HTML and back: snippets of boxes assembled by page, and boxes with the text that the HTML holds for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.functions import markup as M
from sedimark.functions import text as T

#: Fixed value: where what has no place of its own begins, below any page.
BELOW = 10_000_000


def _line(items: Column, zone: Column) -> Column:
    """Snippets of one row from the left; several, or what is in a zone, in an element of their own."""
    html = F.array_join(F.transform(F.sort_array(items), lambda x: x["html"]), "")
    in_tag = lambda tag: F.concat(F.lit(f'<div class="{tag}">'), html, F.lit("</div>"))
    return F.when(zone != "", in_tag("aux-row")).when(F.size(items) > 1, in_tag("body-row")).otherwise(html)


def in_rows(items: Column, zone: Column) -> Column:
    """The lines of a zone's ``items`` (y0, x0, ord, h, html, in order), from the top.

    One starts a new row when its top is farther from the row's first than half the
    smaller of the two heights (two at least), and always when it has no place. Which
    one is first depends on all before it, so a zone, which is a page's, is folded as
    an array; its snippets go with it, so that nothing has to be joined to them again.
    """
    start = F.struct(F.lit(0).alias("y"), F.lit(0).alias("h"), F.array().cast("array<struct<x0:int,ord:bigint,html:string>>").alias("row"), F.array().cast("array<string>").alias("lines"))

    def step(s, x):
        own = F.struct(x["x0"].alias("x0"), x["ord"].alias("ord"), x["html"].alias("html"))
        near = F.greatest(F.lit(2), F.floor(F.least(x["h"], s["h"]) / 2).cast("int"))
        first = F.struct(x["y0"].alias("y"), x["h"].alias("h"), F.array(own).alias("row"), F.when(F.size(s["row"]) > 0, F.array_append(s["lines"], _line(s["row"], zone))).otherwise(s["lines"]).alias("lines"))
        more = F.struct(s["y"].alias("y"), s["h"].alias("h"), F.array_append(s["row"], own).alias("row"), s["lines"].alias("lines"))
        return F.when((F.size(s["row"]) == 0) | (x["y0"] >= BELOW) | (F.abs(x["y0"] - s["y"]) > near), first).otherwise(more)

    return F.aggregate(items, start, step, lambda s: F.array_append(s["lines"], _line(s["row"], zone)))


def sections(snippets: DataFrame) -> DataFrame:
    """(slug, page, ord, html): a <section> for each page of ``snippets`` (slug, ord, box_id, html), ``ord`` being its first snippet's.

    What a snippet says of itself counts: data-aux-zone puts it into the stack above
    or below the body, data-x, data-y and data-y1 into rows. Snippets without a place
    follow the body's others in their order; those without a page are left out. A
    page's snippets are dealt out once; the steps after that stay with it.
    """
    number = lambda name: F.regexp_extract("html", rf'data-{name}="(\d+)"', 1).try_cast("int").alias(name)
    zone = F.regexp_extract("html", 'data-aux-zone="(header|footer)"', 1).alias("zone")
    # made by a generator, so that no filter below it reads the attributes again
    read = F.struct(T.page_of_box(F.col("box_id")).alias("page"), zone, number("x"), number("y"), number("y1"))
    rows = snippets.select("slug", F.col("ord").cast("long").alias("ord"), "html", F.inline(F.array(read))).where("page is not null")
    y0 = F.coalesce("y", F.when(F.col("zone") != "", F.lit(0)).otherwise(F.lit(BELOW)))
    rows = rows.select("slug", "page", "zone", F.least(y0, F.lit(BELOW)).alias("y0"), F.when(y0 >= BELOW, 0).otherwise(F.coalesce("x", F.lit(0))).alias("x0"), "ord", F.when(y0 >= BELOW, 0).otherwise(F.coalesce("y1", y0) - y0).alias("h"), "html")
    items = F.sort_array(F.collect_list(F.struct("y0", "x0", "ord", "h", "html")))
    zones = rows.repartition("slug", "page").groupBy("slug", "page", "zone").agg(items.alias("items"), F.min("ord").alias("ord"))
    zones = zones.withColumn("html", F.array_join(in_rows(F.col("items"), F.col("zone")), ""))
    stack = F.when(F.col("zone") == "header", "top").when(F.col("zone") == "footer", "bottom")
    zones = zones.withColumn("html", F.when(stack.isNull(), M.list_groups(F.col("html"))).otherwise(F.concat(F.lit('<div class="aux-stack aux-stack--'), stack, F.lit('">'), "html", F.lit("</div>"))))
    place = F.when(F.col("zone") == "header", 0).when(F.col("zone") == "", 1).otherwise(2)
    parts = F.sort_array(F.collect_list(F.struct("place", "html")))
    pages = zones.withColumn("place", place).groupBy("slug", "page").agg(F.min("ord").alias("ord"), F.array_join(F.transform(parts, lambda x: x["html"]), "").alias("html"))
    return pages.select("slug", "page", "ord", F.concat(F.lit('<section data-page="'), "page", F.lit('">\n'), "html", F.lit("\n</section>")).alias("html"))


def documents(pages: DataFrame, style: str = "") -> DataFrame:
    """(slug, html): each document's sections in the order in which its pages first came."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "html"))), lambda p: p["html"]), "\n")
    whole = F.concat(F.lit(f"<!DOCTYPE html>\n<html><head>{style}</head><body>\n"), body, F.lit("\n</body></html>\n"))
    return pages.groupBy("slug").agg(whole.alias("html"))


def tagged(pages: DataFrame) -> DataFrame:
    """(slug, box_id, tag, text) of the boxes in each document's HTML (slug, html)."""
    return pages.select("slug", F.explode(M.html_boxes("html")).alias("b")).select("slug", "b.*")


def export(boxes: DataFrame, html: DataFrame) -> DataFrame:
    """Each box (slug, box_id, page, kind, x0..y1) that isn't discarded with the text and tag that its document's HTML has for it; empty, and p, where it has none. ``level`` is for headings."""
    found = tagged(html)
    j = boxes.where("kind <> 'discard'").join(found, ["slug", "box_id"], "left")
    level = F.when(F.col("kind") == "heading", T.heading_level(F.coalesce("tag", F.lit("p"))))
    return j.select("slug", "page", "reading_order", "box_id", "kind", F.array("x0", "y0", "x1", "y1").alias("bbox"), F.coalesce("text", F.lit("")).alias("text"), level.alias("level"))


def export_json(exported: DataFrame, pipeline: str) -> DataFrame:
    """(slug, payload): a document's exported boxes in reading order as one JSON object."""
    element = F.struct("kind", "page", "bbox", "text", "box_id", "level")
    rows = F.transform(F.sort_array(F.collect_list(F.struct("page", "reading_order", "box_id", element.alias("e")))), lambda x: x["e"])
    return exported.groupBy("slug").agg(rows.alias("elements")).select("slug", F.to_json(F.struct(F.col("slug").alias("doc_slug"), F.lit(pipeline).alias("source_pipeline"), "elements")).alias("payload"))
