"""Page boxes: geometric joins with extracted elements, links across pages, edits and counts. All joins are by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions import geometry as G
from sedimark.functions import markup as M
from sedimark.functions import text as T

KINDS = ["heading", "paragraph", "table", "figure", "caption", "formula", "list_item", "auxiliary", "discard"]
TEXT_KINDS = ["heading", "paragraph", "caption", "list_item", "auxiliary", "formula"]


def _pairs(boxes: DataFrame, elements: DataFrame, meeting: bool = False, *more: str) -> DataFrame:
    """Boxes and elements of one page with overlap; ``meeting``: those alone that share area or the element's centre. ``more`` are further columns of boxes."""
    b = boxes.select("page", "box_id", "kind", *more, *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    e = elements.select("page", "element_id", "block_type", *(F.col(c).alias(f"e_{c}") for c in ("x0", "y0", "x1", "y1")))
    both = b.join(e, "page")
    inside = G.centre_in(G.box("e_"), G.box("b_"))
    if meeting:  # plain comparisons, before any arithmetic
        area = (F.least("b_x1", "e_x1") > F.greatest("b_x0", "e_x0")) & (F.least("b_y1", "e_y1") > F.greatest("b_y0", "e_y0"))
        both = both.where(area | inside)
    return both.withColumn("iou", G.iou(G.box("b_"), G.box("e_"))).withColumn("inside", inside)


def matches(boxes: DataFrame, elements: DataFrame, least: float = 0.3) -> DataFrame:
    """All (box, element) that overlap by more than ``least`` or with the element's centre in the box."""
    return _pairs(boxes, elements, True).where((F.col("iou") > least) | F.col("inside")).select("page", "box_id", "element_id", F.round("iou", 6).alias("iou"))


def assign(boxes: DataFrame, elements: DataFrame, least: float = 0.3) -> DataFrame:
    """Each element's best box by overlap times fit of kind and type; ties go to the box first in reading order."""
    score = F.when(F.col("inside"), F.greatest("iou", F.lit(0.31))).otherwise(F.col("iou")) * G.compatibility(F.col("kind"), F.col("block_type"))
    scored = _pairs(boxes, elements, True, "reading_order").withColumn("score", score).where(F.col("score") >= least)
    best = F.max(F.struct("score", (-F.col("reading_order")).alias("earlier"), "box_id"))
    return scored.groupBy("page", "element_id").agg(best.alias("best")).select("page", "element_id", "best.box_id", F.round("best.score", 6).alias("score"))


def split_candidates(boxes: DataFrame, elements: DataFrame, least: float = 0.05) -> DataFrame:
    """Text elements that reach into several text boxes, and are to be replaced by their lines."""
    hit = _pairs(boxes.where(F.col("kind").isin(TEXT_KINDS)), elements.where(F.col("block_type").isin("text", "list", "title")), True).where((F.col("iou") > least) | F.col("inside"))
    return hit.groupBy("page", "element_id").agg(F.count("*").alias("n_boxes")).where("n_boxes > 1")


def line_boxes(element: Column, lines: Column) -> Column:
    """array<struct(x0, y0, x1, y1, text)>: an element's height dealt out evenly to its lines; null for fewer than two lines or no height."""
    step = (element["y1"] - element["y0"]) / F.size(lines)
    parts = F.transform(lines, lambda t, i: F.struct(element["x0"].alias("x0"), (element["y0"] + i * step).alias("y0"), element["x1"].alias("x1"), (element["y0"] + (i + 1) * step).alias("y1"), t.alias("text")))
    return F.when((F.size(lines) >= 2) & (element["y1"] > element["y0"]), parts)


def text_lines(text: Column) -> Column:
    """Lines of a block's text; where there is one, its items by their bullets."""
    clean = lambda pieces: F.filter(F.transform(pieces, T.strip), lambda x: x != "")
    lines = clean(F.split(text, r"\n+"))
    items = clean(F.split(text, r"(?:(?<=[.!?])\s+)?(?=[-·•]\s)"))
    return F.when(F.size(lines) >= 2, lines).otherwise(items)


def lines_of(elements: DataFrame) -> DataFrame:
    """Elements (page, element_id, block_type, x0..y1, text, lines, blocks) as one row a line: by their own lines, else their parts, else their text.

    ``lines`` and ``blocks`` are array<struct(x0, y0, x1, y1, text)>; entries
    without a corner or a text don't count, and fewer than two are none.
    """

    def usable(c):
        good = F.filter(c, lambda x: x["x0"].isNotNull() & x["y0"].isNotNull() & x["x1"].isNotNull() & x["y1"].isNotNull() & (T.strip(x["text"]) != ""))
        return F.when(F.size(good) >= 2, F.transform(good, lambda x: F.struct(x["x0"].alias("x0"), x["y0"].alias("y0"), x["x1"].alias("x1"), x["y1"].alias("y1"), T.strip(x["text"]).alias("text"))))

    parts = F.coalesce(usable(F.col("lines")), usable(F.col("blocks")), line_boxes(F.struct("x0", "y0", "x1", "y1"), text_lines(F.col("text"))))
    return elements.select("page", "element_id", "block_type", F.posexplode(parts).alias("line", "p")).select("page", "element_id", "block_type", "line", "p.*")


def split_elements(boxes: DataFrame, elements: DataFrame) -> DataFrame:
    """``elements`` with each one that reaches into several text boxes replaced by its lines, where it has any; ``line`` is null for whole elements."""
    found = split_candidates(boxes, elements).select("page", "element_id")
    lines = lines_of(elements.join(found, ["page", "element_id"], "left_semi"))
    whole = elements.join(lines.select("page", "element_id").distinct(), ["page", "element_id"], "left_anti").select("page", "element_id", "block_type", F.lit(None).cast("int").alias("line"), "x0", "y0", "x1", "y1", "text")
    return whole.unionByName(lines.select(*whole.columns))


def captions(boxes: DataFrame, filled: DataFrame, kinds: tuple[str, ...] = ("heading", "caption", "paragraph")) -> DataFrame:
    """Each empty text box's adjacent visual box: the best score, then the larger id. ``filled`` has the (page, box_id) of boxes to which elements fell."""
    marked = boxes.join(filled.select("page", "box_id").distinct().withColumn("filled", F.lit(True)), ["page", "box_id"], "left")
    t = marked.where(F.col("filled").isNull() & F.col("kind").isin(*kinds)).select("page", F.col("box_id").alias("caption_id"), *(F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")))
    v = marked.where(F.col("filled") & F.col("kind").isin("table", "figure")).select("page", F.col("box_id").alias("visual_id"), *(F.col(c).alias(f"v_{c}") for c in ("x0", "y0", "x1", "y1")))
    scored = t.join(v, "page").withColumn("score", G.adjacency(G.box("t_"), G.box("v_"))).where("score > 0")
    best = F.row_number().over(Window.partitionBy("page", "caption_id").orderBy(F.desc("score"), F.desc("visual_id")))
    return scored.withColumn("nth", best).where("nth = 1").select("page", "caption_id", "visual_id", F.round("score", 6).alias("score"))


def rescue_captions(adjacent: DataFrame, order: DataFrame, parts: DataFrame) -> DataFrame:
    """(page, caption_id, visual_id, part, caption, rest): captions moved out of the HTML of visual boxes.

    Empty boxes come in reading order (``order``: page, box_id, reading_order), and
    each takes what the ones before it have left of its visual box: the first of the
    box's parts (``parts``: page, box_id, nth, html) that still holds a caption.
    ``rest`` is that part's HTML without it; part is -1 where there was none. The
    turns of one visual box are few: they are folded as an array.
    """
    turns = adjacent.join(order.select("page", F.col("box_id").alias("caption_id"), "reading_order"), ["page", "caption_id"])
    turns = turns.groupBy("page", "visual_id").agg(F.sort_array(F.collect_list(F.struct("reading_order", "caption_id"))).alias("turns"))
    html = parts.groupBy("page", F.col("box_id").alias("visual_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "html"))), lambda p: p["html"]).alias("html"))
    start = F.struct(F.col("html"), F.array().cast("array<struct<caption_id:string,part:int,caption:string,rest:string>>").alias("out"))

    def turn(state, t):
        # arrays of one bind the captions and the first of them, so that each part is read once a turn
        read = F.filter(F.transform(state["html"], lambda h, i: F.struct(i.alias("part"), M.caption(h).alias("found"))), lambda x: x["found"].isNotNull())
        first = F.transform(F.array(F.struct(read.alias("read"))), lambda x: F.coalesce(F.get(x["read"], F.lit(0)), F.struct(F.lit(-1).alias("part"), F.lit(None).cast("struct<caption:string,rest:string>").alias("found"))))

        def taken(x):
            row = F.struct(t["caption_id"].alias("caption_id"), x["part"].alias("part"), x["found"]["caption"].alias("caption"), x["found"]["rest"].alias("rest"))
            left = F.transform(state["html"], lambda h, i: F.when(i == x["part"], x["found"]["rest"]).otherwise(h))
            return F.struct(left.alias("html"), F.array_append(state["out"], row).alias("out"))

        return F.get(F.transform(first, taken), F.lit(0))

    folded = turns.join(html, ["page", "visual_id"]).withColumn("out", F.aggregate("turns", start, turn)["out"])
    # not explode: its filter on an empty array would run the fold again
    return folded.select("page", "visual_id", F.explode_outer("out").alias("o")).select("page", "o.caption_id", "visual_id", "o.part", "o.caption", "o.rest")


def diagnose(boxes: DataFrame, elements: DataFrame, most: int = 5) -> DataFrame:
    """Each element's boxes that overlap it most."""
    best = F.row_number().over(Window.partitionBy("page", "element_id").orderBy(F.desc("iou"), "box_id"))
    return _pairs(boxes, elements).withColumn("rank", best).where(F.col("rank") <= most).select("page", "element_id", "rank", "box_id", F.round("iou", 4).alias("iou"))


def links_down(boxes: DataFrame) -> DataFrame:
    """Each box's continuation: the top-most box of the next page that isn't discarded."""
    top = F.row_number().over(Window.partitionBy("page").orderBy("y0", "reading_order"))
    heads = boxes.where("kind <> 'discard'").withColumn("nth", top).where("nth = 1").select((F.col("page") - 1).alias("page"), F.col("box_id").alias("continues_to"))
    return boxes.where("kind <> 'discard'").select("page", "box_id").join(heads, "page")


def links_up(boxes: DataFrame) -> DataFrame:
    """Each box's beginning: the box of the page before that reaches farthest down."""
    low = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("y1"), "reading_order"))
    tails = boxes.where("kind <> 'discard'").withColumn("nth", low).where("nth = 1").select((F.col("page") + 1).alias("page"), F.col("box_id").alias("continues_from"))
    return boxes.where("kind <> 'discard'").select("page", "box_id").join(tails, "page")


def merged(boxes: DataFrame, by: list[str]) -> DataFrame:
    """One box around each group: its hull, the least confidence and reading order, the kind of the first."""
    return boxes.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("confidence").alias("confidence"), F.min_by("kind", "reading_order").alias("kind"), F.min("reading_order").alias("first_order"))


def replace_pages(boxes: DataFrame, new: DataFrame, first: int, last: int) -> DataFrame:
    """``boxes`` with the pages of a range taken from ``new``."""
    inside = F.col("page").between(first, last)
    return boxes.where(~inside).unionByName(new.where(inside).select(*boxes.columns))


def merge_by_key(old: DataFrame, new: DataFrame, key: str = "box_id", order: str = "ord") -> DataFrame:
    """Rows of ``new`` in the places of rows with the same key, the others behind all; of equal keys in ``new`` the last counts. ``order`` is a place, and comes out as struct(new, at)."""
    by_place = Window.partitionBy(key)
    last = new.withColumn("nth", F.row_number().over(by_place.orderBy(F.desc(order)))).withColumn("first", F.min(order).over(by_place)).where("nth = 1")
    there = old.groupBy(key).agg(F.min(order).alias("there"))
    values = [c for c in old.columns if c not in (key, order)]
    place = lambda is_new, at: F.struct(F.lit(is_new).alias("new"), F.col(at).alias("at"))
    came = last.join(there, key, "left").select(key, F.when(F.col("there").isNotNull(), place(0, "there")).otherwise(place(1, "first")).alias(order), *values)
    stayed = old.join(new.select(key).distinct(), key, "left_anti").select(key, place(0, order).alias(order), *values)
    return stayed.unionByName(came)


def visible(boxes: DataFrame, overrides: DataFrame, default: float = 0.7) -> DataFrame:
    """Boxes that aren't discarded and are sure enough: a page's own threshold (page, threshold) goes before the default."""
    joined = boxes.join(overrides, "page", "left")
    return joined.where((F.col("kind") != "discard") & (F.coalesce("manually_activated", F.lit(False)) | (F.col("confidence") >= F.coalesce("threshold", F.lit(default))))).drop("threshold")


def counts(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("page").agg(F.count_if(F.col("kind") != "discard").alias("n_boxes"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS))


def zones(boxes: DataFrame, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """Header or footer zone and alignment of each box on its page."""
    middle = (F.col("x0") + F.col("x1")) / 2 / width
    return boxes.select("page", "box_id", F.when(F.col("y1") <= 0.08 * height, "header").when(F.col("y0") >= 0.92 * height, "footer").otherwise("body").alias("zone"), F.when(middle < 0.4, "left").when(middle > 0.6, "right").otherwise("center").alias("alignment"))


def visual_rows(boxes: DataFrame) -> DataFrame:
    """Boxes of a page into rows: sorted by (y0, x0), a new row starts when a box's top is too far below the row's first."""
    items = F.sort_array(F.collect_list(F.struct("y0", "x0", "box_id", (F.col("y1") - F.col("y0")).alias("h"))))
    start = F.struct(F.lit(-1).alias("row"), F.lit(0.0).alias("y"), F.lit(0.0).alias("h"), F.array().cast("array<struct<row:int,x0:double,box_id:string>>").alias("out"))

    def step(s, x):
        new = (s["row"] < 0) | (F.abs(x["y0"] - s["y"]) > F.greatest(F.lit(2.0), F.floor(F.least(x["h"], s["h"]) / 2).cast("double")))
        row = F.when(new, s["row"] + 1).otherwise(s["row"])
        return F.struct(row.alias("row"), F.when(new, x["y0"]).otherwise(s["y"]).alias("y"), F.when(new, x["h"]).otherwise(s["h"]).alias("h"), F.array_append(s["out"], F.struct(row.alias("row"), x["x0"].alias("x0"), x["box_id"].alias("box_id"))).alias("out"))

    found = boxes.groupBy("page").agg(F.aggregate(items, start, step)["out"].alias("items"))
    at = F.row_number().over(Window.partitionBy("page", "row").orderBy("x0", "box_id")) - 1
    return found.select("page", F.explode("items").alias("i")).select("page", "i.row", "i.box_id", "i.x0").withColumn("place", at).drop("x0")
