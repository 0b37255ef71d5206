"""Queries of page boxes and, beside each, the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimark.functions import geometry as G
from sedimark.functions import markup as M
from sedimark.operators import box_edits as D
from sedimark.operators import boxes as B
from sedimark.operators import pages as P
from sedimark.operators.scratch import written
from sedimark.plans import inputs as I
from sedimark.plans.registry import query

GEOMETRY = f"WITH {I.BOXES}, {I.ELEMENTS}"
KIND_FACTOR = """CASE WHEN kind = 'table' THEN CASE WHEN block_type = 'table' THEN 1.5 ELSE 0 END WHEN kind = 'figure' THEN CASE WHEN block_type = 'image' THEN 1.5 ELSE 0 END
  WHEN kind = 'discard' THEN 1 WHEN block_type IN ('table', 'image') THEN 0 WHEN kind = 'heading' AND block_type = 'title' THEN 1.5 WHEN kind = 'list_item' AND block_type = 'list' THEN 1.5 ELSE 1 END"""
BEST = f"""sc AS (SELECT *, (CASE WHEN inside THEN greatest(iou, 0.31) ELSE iou END)::DOUBLE * ({KIND_FACTOR})::DOUBLE AS score FROM j),
best AS (SELECT page, element_id, box_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page, element_id ORDER BY score DESC, reading_order) AS nth FROM sc WHERE score >= 0.3) WHERE nth = 1)"""
SPLIT = "split AS (SELECT page, element_id, count(*) AS n_boxes FROM j WHERE kind IN ('heading', 'paragraph', 'caption', 'list_item') AND block_type IN ('text', 'list', 'title') AND (iou > 0.05 OR inside) GROUP BY 1, 2 HAVING count(*) > 1)"


@query(f"{GEOMETRY} SELECT page, box_id, element_id, round(iou, 6) AS iou FROM j WHERE iou > 0.3 OR inside")
def box_iou_join(spark, sf_dir):
    return B.matches(I.boxes(spark, sf_dir), I.elements(spark, sf_dir))


@query(f"{GEOMETRY}, {BEST} SELECT page, element_id, box_id, score FROM best")
def box_assign_best(spark, sf_dir):
    return B.assign(I.boxes(spark, sf_dir), I.elements(spark, sf_dir))


@query(f"{GEOMETRY}, {SPLIT} SELECT * FROM split")
def box_split_prepass(spark, sf_dir):
    return B.split_candidates(I.boxes(spark, sf_dir), I.elements(spark, sf_dir))


@query(f"""{GEOMETRY}, {SPLIT}, l AS (SELECT *, element_id % 4 + 1 AS n FROM elements)
SELECT l.page, l.element_id, CASE WHEN s.element_id IS NOT NULL AND n > 1 THEN i END AS line, CASE WHEN s.element_id IS NOT NULL AND n > 1 THEN y0 + i * (y1 - y0) / n ELSE y0 END AS y0,
  CASE WHEN s.element_id IS NOT NULL AND n > 1 THEN y0 + (i + 1) * (y1 - y0) / n ELSE y1 END AS y1 FROM l LEFT JOIN split s USING (page, element_id), LATERAL (SELECT unnest(range(CASE WHEN s.element_id IS NOT NULL THEN n ELSE 1 END)) AS i)""")
def box_split_lines(spark, sf_dir):
    """All elements, those that reach into several text boxes line by line."""
    e = B.split_elements(I.boxes(spark, sf_dir), I.elements(spark, sf_dir))
    return e.select("page", "element_id", F.col("line").cast("long").alias("line"), "y0", "y1")


@query(f"""{GEOMETRY}, {BEST}, filled AS (SELECT DISTINCT page, box_id FROM best), b AS (SELECT boxes.*, filled.box_id IS NOT NULL AS filled FROM boxes LEFT JOIN filled USING (page, box_id)),
p AS (SELECT t.page, t.box_id AS caption_id, v.box_id AS visual_id, greatest(least(t.x1, v.x1) - greatest(t.x0, v.x0), 0) / greatest(t.x1 - t.x0, 1) AS share, greatest(v.y0 - t.y1, t.y0 - v.y1, 0) AS gap
  FROM b t JOIN b v ON t.page = v.page AND NOT t.filled AND t.kind IN ('heading', 'caption', 'paragraph') AND v.filled AND v.kind IN ('table', 'figure'))
SELECT page, caption_id, visual_id, round(1 / (1 + gap), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page, caption_id ORDER BY gap, visual_id DESC) AS nth FROM p WHERE share >= 0.3 AND gap <= 50) WHERE nth = 1""")
def caption_adjacency(spark, sf_dir):
    """Empty text boxes with the visual box beside them to which elements fell."""
    b = I.boxes(spark, sf_dir)
    return B.captions(b, B.assign(b, I.elements(spark, sf_dir)))


@query()
def caption_rescue(spark, sf_dir):
    """Captions moved out of the HTML of visual boxes into the empty boxes beside them."""
    b = written(I.boxes(spark, sf_dir), "boxes")
    fell = written(B.assign(b, I.elements(spark, sf_dir)), "fell")
    adjacent = B.captions(b, fell)
    html = F.concat(F.lit("<table><caption>Caption "), "element_id", F.lit("</caption></table>"))
    parts = fell.select("page", "box_id", F.col("element_id").alias("nth"), F.when(F.col("element_id") % 3 == 0, "<table></table>").otherwise(html).alias("html"))
    return B.rescue_captions(adjacent, b.select("page", "box_id", "reading_order"), parts)


@query(f"{GEOMETRY} SELECT page, element_id, rank, box_id, round(iou, 4) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY page, element_id ORDER BY iou DESC, box_id) AS rank FROM j) WHERE rank <= 5")
def box_diagnose(spark, sf_dir):
    """The five boxes that overlap each element most."""
    d = B.diagnose(I.boxes(spark, sf_dir), I.elements(spark, sf_dir))
    return d.withColumn("rank", F.col("rank").cast("long"))


@query()
def box_rows(spark, sf_dir):
    """Visual rows of all boxes that aren't discarded."""
    return B.visual_rows(I.boxes(spark, sf_dir).where("kind <> 'discard'"))


LINKS = """v AS (SELECT * FROM boxes WHERE kind <> 'discard'), top AS (SELECT page, arg_min(box_id, y0 * 100000 + reading_order) AS b FROM v GROUP BY 1), low AS (SELECT page, arg_max(box_id, y1 * 100000 - reading_order) AS b FROM v GROUP BY 1),
links AS (SELECT v.page, v.box_id, top.b AS continues_to, low.b AS continues_from FROM v LEFT JOIN top ON top.page = v.page + 1 LEFT JOIN low ON low.page = v.page - 1)"""


def _linked(spark, sf_dir):
    b = I.boxes(spark, sf_dir)
    return b.where("kind <> 'discard'").select("page", "box_id").join(B.links_down(b), ["page", "box_id"], "left").join(B.links_up(b), ["page", "box_id"], "left")


@query(f"WITH {I.BOXES}, {LINKS} SELECT * FROM links")
def box_links(spark, sf_dir):
    return _linked(spark, sf_dir)


@query(f"""WITH {I.BOXES}, {LINKS}, a AS (SELECT box_id, continues_to FROM links WHERE box_id LIKE '%-b1'), e AS (SELECT DISTINCT continues_to AS b FROM a)
SELECT page, box_id, CASE WHEN box_id NOT LIKE '%-b1' THEN continues_to END AS continues_to, CASE WHEN box_id NOT IN (SELECT b FROM e WHERE b IS NOT NULL) THEN continues_from END AS continues_from FROM links""")
def box_unlink(spark, sf_dir):
    """The links of each page's second box undone, at both ends."""
    links = _linked(spark, sf_dir)
    return D.unlink(links, links.where("box_id like '%-b1'"))


@query(f"WITH {I.BOXES} SELECT page, reading_order // 3 AS part, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min(confidence) AS confidence, arg_min(kind, reading_order) AS kind, min(reading_order) AS first_order FROM boxes GROUP BY 1, 2")
def box_merge_union(spark, sf_dir):
    rows = I.boxes(spark, sf_dir).withColumn("part", F.floor(F.col("reading_order") / 3))
    return B.merged(rows, ["page", "part"]).withColumn("first_order", F.col("first_order").cast("long"))


@query(f"WITH {I.BOXES} SELECT page, box_id, CASE WHEN page BETWEEN 10 AND 20 THEN 'paragraph' ELSE kind END AS kind FROM boxes WHERE page NOT BETWEEN 10 AND 20 OR confidence >= 0.8")
def box_page_merge(spark, sf_dir):
    b = I.boxes(spark, sf_dir).select("page", "box_id", "kind", "confidence")
    return B.replace_pages(b, b.where("confidence >= 0.8").withColumn("kind", F.lit("paragraph")), 10, 20).select("page", "box_id", "kind")


@query(f"""WITH {I.BOXES} SELECT box_id, 0::BIGINT AS is_new, reading_order AS place, CASE WHEN reading_order % 4 = 0 THEN 'second' ELSE kind END AS kind FROM boxes
UNION ALL SELECT 'n' || page, 1, min(reading_order), 'new' FROM boxes WHERE reading_order % 4 = 0 GROUP BY page""")
def box_merge_by_key(spark, sf_dir):
    """Rows replaced by their ids, the later of two counting, and new ones behind."""
    old = I.boxes(spark, sf_dir).select("box_id", F.col("reading_order").cast("long").alias("ord"), "kind", "page")
    some = old.where("ord % 4 = 0")
    new = some.withColumn("kind", F.lit("first")).unionByName(some.withColumn("kind", F.lit("second")).withColumn("ord", F.col("ord") + 100_000))
    new = new.unionByName(some.where("ord = 0").withColumn("box_id", F.concat(F.lit("n"), "page")).withColumn("kind", F.lit("new")))
    return B.merge_by_key(old, new).select("box_id", F.col("ord.new").cast("long").alias("is_new"), F.col("ord.at").alias("place"), "kind")


@query(f"WITH {I.BOXES} SELECT page, box_id FROM boxes WHERE kind <> 'discard' AND (manually_activated OR confidence >= CASE WHEN page % 10 = 0 THEN 0.9 ELSE 0.7 END)")
def visible_boxes(spark, sf_dir):
    b = I.boxes(spark, sf_dir)
    own = b.select("page").distinct().where("page % 10 = 0").withColumn("threshold", F.lit(0.9))
    return B.visible(b, own).select("page", "box_id")


@query(f"WITH {I.BOXES} SELECT page, count(*) FILTER (WHERE kind <> 'discard') AS n_boxes, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in B.KINDS) + " FROM boxes GROUP BY 1")
def box_status_counts(spark, sf_dir):
    return B.counts(I.boxes(spark, sf_dir))


@query(f"""WITH {I.BOXES} SELECT page, box_id, CASE WHEN y1 <= 0.08 * 792 THEN 'header' WHEN y0 >= 0.92 * 792 THEN 'footer' ELSE 'body' END AS zone,
  CASE WHEN (x0 + x1) / 2 / 612 < 0.4 THEN 'left' WHEN (x0 + x1) / 2 / 612 > 0.6 THEN 'right' ELSE 'center' END AS alignment FROM boxes""")
def aux_zones(spark, sf_dir):
    return B.zones(I.boxes(spark, sf_dir))


# --- edits

@query(f"""WITH {I.BOXES}, c AS (SELECT *, reading_order = 0 AS cut FROM boxes)
SELECT page, CASE WHEN cut THEN box_id || '-' || h ELSE box_id END AS box_id, CASE WHEN cut AND h = 'bottom' THEN y0 + 5 ELSE y0 END AS y0, CASE WHEN cut AND h = 'top' THEN y0 + 5 ELSE y1 END AS y1 FROM c, LATERAL (SELECT unnest(CASE WHEN cut THEN ['top', 'bottom'] ELSE [''] END) AS h)""")
def box_split_at(spark, sf_dir):
    """Each page's first box in two."""
    b = I.boxes(spark, sf_dir)
    return D.split_at(b, b.where("reading_order = 0").select("box_id", (F.col("y0") + 5).alias("y"))).select("page", "box_id", "y0", "y1")


def _edited(b):
    moved = b.withColumn("x0", F.col("x0") + 1).withColumn("kind", F.lit("formula")).withColumn("manually_activated", F.lit(True))
    return moved.withColumn("continues_to", F.lit("x")).withColumn("continues_from", F.lit("y"))


@query(f"""WITH {I.BOXES} SELECT page, box_id, CASE WHEN reading_order % 2 = 0 THEN x0 ELSE x0 + 1 END AS x0, CASE WHEN reading_order % 2 = 0 THEN kind ELSE 'formula' END AS kind, reading_order % 2 = 1 AS manually_activated,
  CASE WHEN reading_order % 2 = 1 THEN 'x' END AS continues_to FROM boxes""")
def box_reset(spark, sf_dir):
    """Every other of the edited boxes as it was detected."""
    b = I.boxes(spark, sf_dir)
    r = D.reset_boxes(_edited(b), b, b.where("reading_order % 2 = 0"))
    return r.select("page", "box_id", "x0", "kind", "manually_activated", "continues_to")


@query(f"WITH {I.BOXES} SELECT page, box_id, CASE WHEN page % 3 = 0 THEN kind ELSE 'formula' END AS kind FROM boxes")
def box_reset_pages(spark, sf_dir):
    b = I.boxes(spark, sf_dir)
    return D.reset_pages(_edited(b).select(*b.columns), b, b.where("page % 3 = 0").select("page").distinct()).select("page", "box_id", "kind")


@query(f"""WITH {I.BOXES}, n AS (SELECT page, max(reading_order) AS last FROM boxes GROUP BY 1) SELECT page, CASE WHEN reading_order = 1 THEN 'discard' WHEN reading_order = 2 THEN 'formula' ELSE kind END AS kind, reading_order, confidence FROM boxes
UNION ALL SELECT page, k, last + i, 1.0 FROM n, (VALUES ('table', 1), ('figure', 2)) v(k, i)""")
def box_changes(spark, sf_dir):
    """On every page: a box deleted, one of another kind, and two new ones."""
    b = I.boxes(spark, sf_dir)
    pages = b.select("page").distinct()
    new = [pages.select("page", F.lit(k).alias("kind"), *(F.lit(v).alias(c) for c, v in zip(D.CORNERS, (x, 0.0, x + 9, 9.0), strict=True))) for k, x in (("table", 10.0), ("figure", 20.0))]
    changed = D.update(D.delete(b, b.where("reading_order = 1")), b.where("reading_order = 2").select("box_id", F.lit("formula").alias("kind")))
    return D.create(changed, new[0].unionByName(new[1])).select("page", "kind", F.col("reading_order").cast("long").alias("reading_order"), "confidence")


@query(f"WITH {I.BOXES} SELECT page, box_id, greatest(x0 * 0.25 - 8, 0) AS \"left\", greatest(792 - y1 * 0.25 - 8, 0) AS bottom, least(x1 * 0.25 + 8, 612) AS \"right\", least(792 - y0 * 0.25 + 8, 792) AS top FROM boxes")
def box_crops(spark, sf_dir):
    """Crops of all boxes in points, the y axis pointing up."""
    b = D.in_points(I.boxes(spark, sf_dir), 288)
    return D.padded(b, b.select("page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height")).distinct())


BOOK = 50


def _books(boxes: DataFrame) -> DataFrame:
    """Boxes with the book of so many pages that they are in."""
    return boxes.withColumn("slug", F.concat(F.lit("book-"), F.floor((F.col("page") - 1) / BOOK)))


@query(f"WITH {I.BOXES}, p AS (SELECT unnest(range(1, (SELECT max(page) + 3 FROM boxes))) AS page), s AS (SELECT DISTINCT page FROM boxes) SELECT p.page, CASE WHEN p.page % 5 = 0 THEN 'approved' WHEN s.page IS NOT NULL THEN 'extracted' ELSE 'no-extraction' END AS state FROM p LEFT JOIN s USING (page)")
def page_states(spark, sf_dir):
    b = I.boxes(spark, sf_dir)
    last = b.agg(D.page_count(F.lit(0).cast("long"), F.max("page")).alias("last")).first().last
    pages = spark.range(1, last + 3).select(F.col("id").alias("page"))
    return D.page_states(pages, b, pages.where("page % 5 = 0"))


@query(f"WITH {I.BOXES}, f AS (SELECT page, box_id, count(*) OVER () AS n FROM boxes WHERE kind = 'heading' AND page = (SELECT min(page) FROM boxes)) SELECT page, box_id FROM f WHERE n = 1")
def title_heading(spark, sf_dir):
    return D.title_heading(I.boxes(spark, sf_dir))


@query(f"""WITH {I.BOXES}, n AS (SELECT 'book-' || ((page - 1) // {BOOK}) AS slug, page, count(*) FILTER (WHERE kind = 'heading') AS n, min(CASE WHEN kind = 'heading' THEN box_id END) AS box_id FROM boxes WHERE confidence >= 0.95 GROUP BY 1, 2),
f AS (SELECT *, min(page) OVER (PARTITION BY slug) AS first FROM n) SELECT slug, page, box_id FROM f WHERE page = first AND n = 1""")
def book_titles(spark, sf_dir):
    """The titles of books of fifty pages, where a first page has just one heading among its surest boxes."""
    return D.title_headings(_books(I.boxes(spark, sf_dir).where("confidence >= 0.95")))


@query(f"WITH {I.BOXES} SELECT page, box_id, row_number() OVER (PARTITION BY page ORDER BY y0, x0, box_id) - 1 AS place FROM boxes")
def box_reading_order(spark, sf_dir):
    return D.reading_order(I.boxes(spark, sf_dir)).select("page", "box_id", F.col("place").cast("long").alias("place"))


# --- pages as HTML


def _snippets(b):
    """A snippet for each of ``b``, boxes in books of so many pages; furniture says its zone, list items none of their place."""
    words = F.concat(F.lit("text of "), "box_id")
    parts = F.array(F.struct(F.concat(F.lit("<p>"), words, F.lit("</p>")).alias("html"), words.alias("text"), F.lit("text").alias("type")))
    html = M.box_html(F.col("kind"), F.col("box_id"), F.col("parts"), G.points(F.col("y0"), 288) / 792, F.col("page") % BOOK == 1)
    # each step uses the one before several times: a generator's column is made once, where the optimiser would put all into one expression
    once = lambda rows, c, name: rows.select("*", F.inline(F.array(F.struct(c.alias(name)))))
    rows = once(once(b, parts, "parts"), html, "bare").where("bare <> ''")
    place = {"data-x": F.col("x0").cast("int"), "data-y": F.col("y0").cast("int"), "data-y1": F.col("y1").cast("int")}
    rows = once(rows, F.when(F.col("kind") == "list_item", F.col("bare")).otherwise(M.with_attributes(F.col("bare"), place)), "placed")
    zone = F.when(F.col("y0") < 340, "header").otherwise("footer")
    rows = once(rows, F.when(F.col("kind") == "caption", M.with_attributes(F.col("placed"), {"data-aux-zone": zone})).otherwise(F.col("placed")), "html")
    return rows.select("slug", (F.col("page") * 100_000 + F.col("reading_order")).alias("ord"), "box_id", "html")


@query()
def page_html(spark, sf_dir):
    """Each page's boxes as one section, in rows."""
    s = P.sections(_snippets(_books(I.boxes(spark, sf_dir))))
    return s.select("slug", "page", F.length("html").alias("chars"), F.sha2("html", 256).alias("html_sha256"))


@query(f"""WITH {I.BOXES} SELECT 'book-' || ((page - 1) // {BOOK}) AS slug, page, box_id, kind, 'text of ' || box_id AS text, CASE WHEN kind = 'heading' THEN CASE WHEN page % {BOOK} = 1 THEN 1 ELSE 2 END END AS level FROM boxes WHERE kind <> 'discard'""")
def export_elements(spark, sf_dir):
    """Boxes with the text that their documents' assembled HTML holds for them."""
    b = written(_books(I.boxes(spark, sf_dir)), "boxes")
    html = P.documents(P.sections(_snippets(b)))
    return P.export(b, html).select("slug", "page", "box_id", "kind", "text", "level")


@query(f"""WITH {I.BOXES} SELECT 'book-' || ((page - 1) // {BOOK}) AS slug, count(*) AS n_elements, count(*) FILTER (WHERE kind = 'heading') AS n_levels FROM boxes WHERE kind <> 'discard' GROUP BY 1""")
def export_payload(spark, sf_dir):
    """Exports as JSON, counted again from it."""
    b = written(_books(I.boxes(spark, sf_dir)), "boxes")
    html = P.documents(P.sections(_snippets(b)))
    payload = P.export_json(P.export(b, html), "local")
    read = F.from_json("payload", "elements array<struct<kind:string,level:int>>")["elements"]
    return payload.select("slug", F.size(read).cast("long").alias("n_elements"), F.size(F.filter(read, lambda e: e["level"].isNotNull())).cast("long").alias("n_levels"))
