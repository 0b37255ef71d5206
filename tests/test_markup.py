"""Text and markup functions, pages and boxes, by literals."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from sedimark.functions import markup as M
from sedimark.functions.mathml import mathml
from sedimark.functions import text as T
from sedimark.operators import box_edits as D
from sedimark.operators import boxes as B
from sedimark.operators import pages as P


def values(spark, function, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", function(F.col("t")).alias("x")).orderBy("i").collect()]


def test_html_to_text_decodes_all_references(spark):
    assert values(spark, T.html_to_text, ["<p>a&nbsp;b&eacute;&#x27;&lt;</p>", "plain", "&amp;lt;", None]) == ["a\xa0bé'<", "plain", "&lt;", None]


def test_html_to_text_leaves_references_without_an_end(spark):
    assert values(spark, lambda c: T.html_to_text(c, closed=True), ["cut &amp", "cut &amp{x}; &#x27;&nbsp;&nope;&notit;", "&amp;lt;&#39;&copy;", "&quo", None]) == ["cut &amp", "cut &amp{x}; '\xa0&nope;&notit;", "&lt;'©", "&quo", None]


def test_exponents_and_footnotes(spark):
    assert values(spark, M.unit_exponents, ["W/m2", "kg/m3, mm-1)", "H2O x12y m2.5 Foo3.0", "(s-1)"]) == ["W/m²", "kg/m³, mm⁻¹)", "H2O x12y m2.5 Foo3.0", "(s⁻¹)"]
    assert values(spark, M.footnote_markup, ["(GGG)2)", "0.44)", "0,44) x", "Moderatorzone8)", "(0.44) 1.5) m2) Q8)", "W/(m·K)1);"]) == ["(GGG)<sup>2)</sup>", "0.4<sup>4)</sup>", "0,4<sup>4)</sup> x", "Moderatorzone<sup>8)</sup>", "(0.44) 1.5) m2) Q8)", "W/(m·K)<sup>1)</sup>;"]


def fake(latex):
    if "bad" in latex:
        raise ValueError
    return f'<math display="inline">{latex}</math>'


def test_math(spark):
    texts = ["$^{®}$ $_{2}$ $^x$", r"$5$ $\alpha$ $a \times b$", "$$x^2$$", r"$\frac{1}{2}$", r"\dot{q}_{max,X}&#x27;&#x27; end", r"$$bad<$$ $\bad{<}$", "no maths", None]
    assert values(spark, M.math_markup, texts) == ["<sup>®</sup> <sub>2</sub> <sup>x</sup>", r"5 \alpha a \times b", "$$x^2$$", r"\frac{1}{2}", texts[4], r"$$bad<$$ \bad{&lt;}", "no maths", None]
    got = values(spark, lambda c: M.math_markup(c, fake), texts)
    assert got[2] == '<div class="math-display"><math display="block">x^2</math></div>'
    assert got[4] == r"""<math display="inline">\dot{q}''_{\mathrm{max,X}}</math> end"""
    assert got[5] == r'<code class="math-error">bad&lt;</code> \bad{&lt;}'
    assert M.math_text("$\\dot{x}$''", lambda s: "<math>x</math>") == '<math>x</math><sup class="prime">″</sup>'
    assert values(spark, M.upright_subscripts, [r"a_{max}^{x}_{\alpha bc}"]) == [r"a_{\mathrm{max}}^{x}_{\alpha bc}"]


@pytest.mark.parametrize("latex, inner", [
    ("x", "<mi>x</mi>"), ("x_1^{2}", "<msubsup><mi>x</mi><mn>1</mn><mn>2</mn></msubsup>"), (r"\\frac{1}{2a}", "<mfrac><mn>1</mn><mrow><mn>2</mn><mi>a</mi></mrow></mfrac>"),
    (r"\\dot{q}_{\\mathrm{max, BE}}", "<msub><mover><mi>q</mi><mo>˙</mo></mover><mtext>max, BE</mtext></msub>"), (r"\\alpha \\le 3.5", "<mrow><mi>α</mi><mo>≤</mo><mn>3.5</mn></mrow>"),
    ("q''_a", "<msubsup><mi>q</mi><mi>a</mi><mrow><mo>′</mo><mo>′</mo></mrow></msubsup>"), (r"\\sqrt{a<b}", "<msqrt><mrow><mi>a</mi><mo>&lt;</mo><mi>b</mi></mrow></msqrt>"), ("^2", "<msup><mrow></mrow><mn>2</mn></msup>"),
])
def test_small_formulas_become_mathml(latex, inner):
    latex = latex.replace("\\\\", "\\")
    assert mathml(latex) == f'<math display="inline">{inner}</math>'


@pytest.mark.parametrize("latex", [r"\nosuch{x}", "{a", "a}", "a_", r"\frac{1}", r"\mathrm x", "a_1_2"])
def test_what_isnt_understood_is_an_error(latex):
    with pytest.raises(ValueError):
        mathml(latex)


def test_formulas_in_texts():
    assert M.math_text(r"a $$ \frac{1}{2} $$ b $\dot{x}$' c $$\odd{1}$$", mathml) == (
        'a <div class="math-display"><math display="block"><mfrac><mn>1</mn><mn>2</mn></mfrac></math></div> b '
        '<math display="inline"><mover><mi>x</mi><mo>˙</mo></mover></math><sup class="prime">′</sup> c <code class="math-error">\\odd{1}</code>')  # fmt: skip
    assert M.math_text("costs 5$ or $$", None) == "costs 5$ or $$" and M.math_text(r"C:\Users\x", mathml) == r"C:\Users\x"
    assert M.math_text("$$  $$x", mathml) == "x" and M.math_text(r"$^\circ$ $_{\mu}$", None) == "<sup>°</sup> <sub>µ</sub>"


def test_captions(spark):
    got = values(spark, M.caption, ["<table><caption id=1> C </caption><tr>", "Lead <b>x</b><table>..</table>", "<table>..</table>after\ntext", "<p>no", "ab<table></table>c", "<caption> </caption>Leading<figure>"])
    assert [c and tuple(c) for c in got] == [("C", "<table><tr>"), ("Lead x", "<table>..</table>"), ("after\ntext", "<table>..</table>"), None, None, ("Leading", "<figure>")]
    tag = values(spark, lambda c: M.caption_source(c, F.lit("p1-b2")), ['<table><caption data-source-box="old" x="1">C</caption>', "Lead<table>", "<table>", "  <table>"])
    assert tag == ['<table><caption data-source-box="p1-b2" x="1">C</caption>', '<span data-source-box="p1-b2">Lead</span><table>', "<table>", "  <table>"]


def test_html_boxes(spark):
    page = '<h1 data-source-box="a">T <b data-source-box="in">x<br></b>&amp;</h1><p data-source-box="b">one</p><p data-source-box="b"> two </p><p data-source-box="c">open'
    (got,) = values(spark, lambda c: M.html_boxes(c), [page])
    assert [(b.box_id, b.tag, b.text) for b in got] == [("a", "h1", "T x&"), ("b", "p", "two"), ("c", "p", None)]


def test_boxes_of_plain_tags_are_those_of_html():
    rng = random.Random(1)
    plain = ['<p data-source-box="a">', '<p data-source-box="b" x="1">', "</p>", "<br>", "<b>", "</b>", "x ", "&amp;", "&am", "p;", " \n", '<h1 data-source-box="c">', "</h1>", "<!DOCTYPE html>", "<div>", "</div>", '<p data-source-box="">', ">", '<p data-source-box="a" data-source-box="d">', "</br>", "&lt;b&gt;"]
    odd = [*plain, "<", "<P>", "<br/>", "<!-- c -->", "<script>", "</script>", "<title>", '<p title=" data-source-box=" y="z">', "<p data-source-box='e'>", '<p data-source-box="&amp;">', "</ p>"]
    for n in range(4000):
        page = "".join(rng.choice(odd if n % 2 else plain) for _ in range(rng.randrange(1, 14)))
        found = M.plain_boxes(page)
        assert (found is None and n % 2) or list(found.items()) == list(M._parsed(page).items())


def test_attributes_lists_and_sections(spark):
    assert values(spark, lambda c: M.with_attributes(c, {"data-x": F.lit(3), "class": F.lit("y")}), ['<p class="x">hi</p>', "<p>hi</p>", "hi", "<p"]) == ['<p data-x="3" class="x">hi</p>', '<p data-x="3" class="y">hi</p>', "hi", "<p"]
    assert values(spark, M.list_groups, ["<li>a</li> <li>b</li><p>x</p><li>c</li>"]) == ["<ul><li>a</li> <li>b</li></ul><p>x</p><ul><li>c</li></ul>"]
    assert values(spark, lambda c: M.page_section(c, F.lit(2)), ['<section data-page="1">A</section><section id=x data-page="2">B</section>', "none"]) == ["B", None]
    assert values(spark, lambda c: M.zone_line(c, F.lit(True)), [" 12 ", "123456", "Head"]) == ['<span class="page-number">12</span>', '<header class="page-header">123456</header>', '<header class="page-header">Head</header>']


def test_box_html(spark):
    part = "array<struct<html:string,text:string,type:string>>"
    two = [("<p>a</p>", " a ", "text"), ("<p>b</p>", "b", "text")]
    rows = [(0, "paragraph", two), (1, "heading", two), (2, "table", [("<table></table>", "", "table")]), (3, "figure", []), (4, "caption", [("<p>c</p>", "c", "caption_rescue")]), (5, "formula", two[:1]), (6, "auxiliary", two[:1]), (7, "discard", two), (8, "list_item", two)]
    df = spark.createDataFrame(rows, f"i int, k string, p {part}")
    got = [r.h for r in df.select("i", M.box_html(F.col("k"), F.lit("b1"), F.col("p"), F.lit(0.05), F.lit(True)).alias("h")).orderBy("i").collect()]
    assert got == [
        '<p data-source-box="b1">a</p><p data-source-box="b1">b</p>', '<h1 data-source-box="b1">a b</h1>', '<div data-source-box="b1"><div class="extracted-table"><table></table></div></div>', "",
        '<figcaption data-source-box="b1" class="caption-ref">c</figcaption>', '<pre data-source-box="b1"><code>a</code></pre>', '<header class="page-header" data-source-box="b1">a</header>', "", '<li data-source-box="b1">a</li><li data-source-box="b1">b</li>',
    ]


def test_pages_assemble_in_rows(spark):
    at = lambda x, y, y1, zone="": f'data-x="{x}" data-y="{y}" data-y1="{y1}"' + (f' data-aux-zone="{zone}"' if zone else "")
    rows = [("d", 0, "p2-b0", f"<p {at(50, 10, 30)}>right</p>"), ("d", 1, "p2-b1", f"<p {at(5, 14, 30)}>left</p>"), ("d", 2, "p2-b2", f"<p {at(5, 40, 60)}>low</p>"), ("d", 3, "p1-b0", "<li>loose</li>"), ("d", 4, "p1-b1", f"<p {at(0, 1, 9)}>first</p>"), ("d", 5, "p2-b3", f"<i {at(0, 0, 5, 'header')}>h</i>"), ("d", 6, "p2-b4", f"<i {at(0, 90, 95, 'footer')}>f</i>"), ("d", 7, "x", "lost")]
    df = spark.createDataFrame(rows, "slug string, ord long, box_id string, html string").repartition(3)
    (doc,) = P.documents(P.sections(df)).collect()
    body = doc.html.split("<body>\n")[1].split("\n</body>")[0]
    bare = re.sub(r' data-(x|y|y1|aux-zone)="\w+"', "", body)
    assert bare == '<section data-page="2">\n<div class="aux-stack aux-stack--top"><div class="aux-row"><i>h</i></div></div><div class="body-row"><p>left</p><p>right</p></div><p>low</p><div class="aux-stack aux-stack--bottom"><div class="aux-row"><i>f</i></div></div>\n</section>\n<section data-page="1">\n<p>first</p><ul><li>loose</li></ul>\n</section>'


def test_sections_read_each_attribute_once_and_deal_snippets_out_once(spark):
    df = spark.createDataFrame([("d", 0, "p2-b0", "<p>x</p>")], "slug string, ord long, box_id string, html string")
    made = df.withColumn("html", M.with_attributes(F.col("html"), {"data-x": F.col("ord"), "data-y": F.col("ord")}))
    plan = P.sections(made)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count('data-y="(') == plan.count('data-x="(') == plan.count("aux-zone=") == 1
    assert "Join" not in plan and "Window" not in plan


BOXES = "page long, box_id string, kind string, x0 double, y0 double, x1 double, y1 double, confidence double, reading_order int, manually_activated boolean, continues_to string, continues_from string"


def box(page, n, kind="paragraph", x0=0.0, y0=0.0, x1=10.0, y1=10.0, to=None, back=None):
    return (page, f"p{page}-b{n}", kind, x0, y0, x1, y1, 0.5, n, False, to, back)


def test_box_edits(spark):
    rows = [box(1, 0, "heading", to="p2-b0"), box(1, 1), box(2, 0, back="p1-b0"), box(2, 1, to="p9-b9")]
    b = spark.createDataFrame(rows, BOXES)
    asked = spark.createDataFrame([("p1-b0",), ("p2-b1",)], "box_id string")
    assert {r.box_id: (r.continues_to, r.continues_from) for r in D.unlink(b, asked).collect()} == dict.fromkeys(["p1-b0", "p1-b1", "p2-b0", "p2-b1"], (None, None))
    up = D.unlink(b, spark.createDataFrame([("p2-b0",)], "box_id string"), down=False)
    assert {r.box_id for r in up.where("continues_to is not null").collect()} == {"p2-b1"}
    halves = D.split_at(b, spark.createDataFrame([("p1-b1", 4)], "box_id string, y int"))
    assert {(r.box_id, r.y0, r.y1) for r in halves.where("box_id like 'p1-b1%'").collect()} == {("p1-b1-top", 0.0, 4.0), ("p1-b1-bottom", 4.0, 10.0)} and halves.count() == 5
    with pytest.raises(Exception, match="strictly inside"):
        D.split_at(b, spark.createDataFrame([("p1-b1", 10)], "box_id string, y int")).collect()
    new = spark.createDataFrame([(1, "table", 0.0, 0.0, 1.0, 1.0), (3, "figure", 0.0, 0.0, 1.0, 1.0)], "page long, kind string, x0 double, y0 double, x1 double, y1 double")
    assert {(r.page, r.reading_order) for r in D.create(b, new).where("confidence = 1").collect()} == {(1, 2), (3, 0)}
    assert {r.box_id: r.kind for r in D.delete(b, asked).collect()} == {"p1-b0": "discard", "p1-b1": "paragraph", "p2-b0": "paragraph", "p2-b1": "discard"}
    old = b.withColumn("kind", F.lit("table"))
    assert {r.box_id: (r.kind, r.continues_to) for r in D.reset_boxes(b, old, asked).where("page = 1").collect()} == {"p1-b0": ("table", None), "p1-b1": ("paragraph", None)}
    assert [tuple(r) for r in D.title_heading(b).collect()] == [(1, "p1-b0")]
    assert D.title_heading(b.unionByName(spark.createDataFrame([box(1, 5, "heading")], BOXES))).count() == 0


def test_lines_of_blocks(spark):
    inner = "array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>"
    own, one = [(0.0, 0.0, 9.0, 5.0, " a "), (0.0, 5.0, 9.0, 9.0, "b"), (None, 0.0, 0.0, 0.0, "no")], [(0.0, 0.0, 9.0, 5.0, "a")]
    rows = [(1, 1, "text", 0.0, 0.0, 9.0, 9.0, "x\ny", own, None), (1, 2, "text", 0.0, 0.0, 9.0, 9.0, "x", one, own), (1, 3, "text", 0.0, 0.0, 9.0, 9.0, "x\n\ny\n z", one, None), (1, 4, "list", 0.0, 0.0, 9.0, 8.0, "Intro. - one • two", None, None), (1, 5, "text", 0.0, 0.0, 9.0, 9.0, "single", None, None), (1, 6, "text", 0.0, 5.0, 9.0, 5.0, "a\nb", None, None)]
    df = spark.createDataFrame(rows, f"page long, element_id long, block_type string, x0 double, y0 double, x1 double, y1 double, text string, lines {inner}, blocks {inner}")
    got = {}
    for r in B.lines_of(df).orderBy("element_id", "line").collect():
        got.setdefault(r.element_id, []).append((r.text, r.y0, r.y1))
    assert got == {1: [("a", 0.0, 5.0), ("b", 5.0, 9.0)], 2: [("a", 0.0, 5.0), ("b", 5.0, 9.0)], 3: [("x", 0.0, 3.0), ("y", 3.0, 6.0), ("z", 6.0, 9.0)], 4: [("Intro.", 0.0, 8 / 3), ("- one", 8 / 3, 16 / 3), ("• two", 16 / 3, 8.0)]}


def test_captions_are_rescued_in_turn(spark):
    adjacent = spark.createDataFrame([(1, "c1", "v", 1.0), (1, "c0", "v", 0.5), (1, "c2", "v", 0.5)], "page long, caption_id string, visual_id string, score double")
    order = spark.createDataFrame([(1, "c0", 0), (1, "c1", 1), (1, "c2", 2)], "page long, box_id string, reading_order int")
    parts = spark.createDataFrame([(1, "v", 0, "<table></table>"), (1, "v", 1, "Leading words<table><caption>Cap</caption></table>")], "page long, box_id string, nth int, html string")
    got = {r.caption_id: (r.part, r.caption, r.rest) for r in B.rescue_captions(adjacent, order, parts).collect()}
    assert got == {"c0": (1, "Cap", "Leading words<table></table>"), "c1": (1, "Leading words", "<table></table>"), "c2": (-1, None, None)}


def test_captions_are_read_once_a_turn(spark):
    adjacent = spark.createDataFrame([(1, "c1", "v", 1.0)], "page long, caption_id string, visual_id string, score double")
    order = spark.createDataFrame([(1, "c1", 0)], "page long, box_id string, reading_order int")
    parts = spark.createDataFrame([(1, "v", 0, "<table></table>")], "page long, box_id string, nth int, html string")
    plan = B.rescue_captions(adjacent, order, parts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("</caption>") == 3  # the caption, what is before it and what is after it


def test_titles_of_documents(spark):
    rows = [("a", 3, "b1", "heading"), ("a", 3, "b2", "paragraph"), ("a", 4, "b3", "heading"), ("b", 1, "b4", "heading"), ("b", 1, "b5", "heading"), ("c", 1, "b6", "figure"), ("c", 2, "b7", "heading")]
    found = D.title_headings(spark.createDataFrame(rows, "slug string, page int, box_id string, kind string"))
    assert [tuple(r) for r in found.collect()] == [("a", 3, "b1")]


def test_merge_by_key(spark):
    old = spark.createDataFrame([("a", 0, 1), ("b", 1, 2)], "box_id string, ord long, v int")
    new = spark.createDataFrame([("z", 0, 9), ("b", 1, 3), ("b", 2, 4), ("z", 3, 8)], "box_id string, ord long, v int")
    assert [(r.box_id, r.v) for r in B.merge_by_key(old, new).orderBy("ord").collect()] == [("a", 1), ("b", 4), ("z", 8)]


def test_export_json(spark):
    boxes = spark.createDataFrame([("d", 1, "p1-b0", "heading", 0.0, 0.0, 1.0, 1.0, 0), ("d", 1, "p1-b1", "paragraph", 0.0, 0.0, 1.0, 1.0, 1), ("d", 1, "p1-b2", "discard", 0.0, 0.0, 1.0, 1.0, 2)], "slug string, page long, box_id string, kind string, x0 double, y0 double, x1 double, y1 double, reading_order int")
    html = spark.createDataFrame([("d", '<h3 data-source-box="p1-b0">T</h3>')], "slug string, html string")
    (r,) = P.export_json(P.export(boxes, html), "local").collect()
    assert json.loads(r.payload) == {"doc_slug": "d", "source_pipeline": "local", "elements": [{"kind": "heading", "page": 1, "bbox": [0.0, 0.0, 1.0, 1.0], "text": "T", "box_id": "p1-b0", "level": 3}, {"kind": "paragraph", "page": 1, "bbox": [0.0, 0.0, 1.0, 1.0], "text": "", "box_id": "p1-b1"}]}


def test_small_text_functions(spark):
    at = spark.sql("select timestamp'2026-01-02 03:04:05Z' as t")
    assert tuple(at.select(T.compact_time(F.col("t")), T.iso_seconds(F.col("t")), T.iso_time(F.lit("2026-01-02T03:04:05Z")) == F.col("t"), T.iso_time(F.lit("no")).isNull()).first()) == ("20260102T030405", "2026-01-02T03:04:05Z", True, True)
    assert values(spark, T.strip_bullet, ["- a ", "* b", "12. c", "d - e", "-x"]) == ["a", "b", "c", "d - e", "-x"]
    assert values(spark, T.strip_marks, [" - · a", "•*b "]) == ["a", "b"]
    assert values(spark, T.quoted, ["O'Neil"]) == ["O''Neil"] and values(spark, lambda c: T.preview(c, 2), ["abc"]) == ["ab"]
    assert values(spark, lambda c: T.score_line(F.lit(0.12345), c), ["x"]) == ["0.123 x"]
    assert values(spark, lambda c: T.table_block(F.lit(2), F.lit("e"), c, F.lit(None).cast("string"), F.lit(3), F.lit(None).cast("int")), ["body"]) == ["[Tabelle (voll), Seite 2, 3×0, id=e]\nbody"]
    assert values(spark, lambda c: T.overlaps(c, F.lit("Some  LONG source text"), 8), ["a long Source", "short", "nothing in common"]) == [True, False, False] and values(spark, lambda c: T.overlaps(c, c, 0), ["x"]) == [True]
