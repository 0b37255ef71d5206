"""Every query with SQL against DuckDB at the smallest scale; the others by their properties."""

import hashlib
import html
import json
import math
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest

from sedimark.operators import retrieval as R
from sedimark.operators.synthesis import split_sentences
from sedimark.plans import queries as Q
from sedimark.plans.text_queries import first_words

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return round(float(value), 5)
    return str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(([plain(r[i]) for i in order] for r in found), key=repr)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_sql(spark, tables, name):
    df, want = Q.QUERIES[name](spark, SF), tables.sql(Q.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@needs_data
def test_queries_without_sql(spark):
    assert Q.QUERIES["seeded_sample"](spark, SF).count() == 100
    kept = {r.id for r in Q.near_dup_greedy(spark, SF).collect()}
    assert kept and all(r.a not in kept or r.b not in kept for r in Q.near_dup_pairs(spark, SF).collect())
    places = [(r.page, r.row, r.place) for r in Q.QUERIES["box_rows"](spark, SF).collect()]
    assert len(set(places)) == len(places)
    text = {r.doc_id: r.text for r in Q.I.table(spark, SF, "documents").collect()}
    marked = {r.doc_id: (r.marked_sha256, r.parts) for r in Q.QUERIES["footnote_markup"](spark, SF).collect()}
    for i, t in text.items():
        want = re.sub(r"(?<![A-Za-z\d])([A-Za-z]{4,})(\d{1,2})\)(?=[\s<,;]|$)", r"\1<sup>\2)</sup>", t.replace(",", "8),"))
        assert marked[i] == (hashlib.sha256(want.encode()).hexdigest(), want.count("<sup>") + 1)
    assert Q.QUERIES["slug_ascii"](spark, SF).where("slug rlike '[^a-z0-9-]' or slug = ''").count() == 0


@needs_data
def test_sentences_and_boxes_lose_nothing_of_whole_tables(spark):
    read = lambda name: Q.I.table(spark, SF, name).collect()
    got = {}
    for r in Q.QUERIES["sentence_units"](spark, SF).collect():
        got.setdefault(r.doc_id, {})[r.pos] = (r.chars, r.sentence_sha256)
    for r in read("documents"):
        want = split_sentences(r.text or "")
        assert "".join("".join(want).split()) == "".join((r.text or "").split())
        assert got.get(r.doc_id, {}) == {i: (len(s), hashlib.sha256(s.encode()).hexdigest()) for i, s in enumerate(want)}
    boxes = {(r.page_id, r.box_id): (r.tag, r.text) for r in Q.QUERIES["html_boxes"](spark, SF).collect()}
    want = {}
    for r in read("pages"):
        for box, tag in (("head", "h1"), ("item", "li")):
            found = re.findall(rf"<{tag}>(.*?)</{tag}>", r.html or "", re.S)
            if found:
                want[r.page_id, box] = (tag, " ".join(html.unescape(re.sub("<[^>]+>", "", found[-1])).split()))
    assert want and {k: (t, " ".join((x or "").split())) for k, (t, x) in boxes.items()} == want


@needs_data
def test_formulas_of_whole_texts(spark):
    outside = {r.doc_id: r.text for r in Q.I.table(spark, SF, "documents").collect() if r.text is not None}
    prefix, mark = "<sup>®</sup> <sub>2</sub> 5 \\times 3 \\alpha W/m² ", " x mm⁻¹ 0.4<sup>4)</sup> "
    got = {r.doc_id: r.marked_sha256 for r in Q.QUERIES["math_markup"](spark, SF).collect()}
    plain = {i: t for i, t in outside.items() if not re.search(r"[$\\&]|\d\)|[A-Za-z]\d", t)}
    assert plain and all(got[i] == hashlib.sha256((prefix + t.replace(". ", mark)).encode()).hexdigest() for i, t in plain.items())


@needs_data
def test_kept_questions_match_brute_force(spark):
    got = {}
    for r in Q.QUERIES["synth_kept"](spark, SF).collect():
        got.setdefault((r.slug, r.element_id), []).append((r.place, r.question))
    letters = lambda q: np.array([q.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"], float)
    want = {}
    for r in Q.I.table(spark, SF, "documents").collect():
        lines = [x for x in (r.text or "").split("\n") if x.strip()]
        kind = ["table", "list_item", "heading", "list_item"][r.doc_id % 4]
        if r.text is None or r.doc_id % 10 == 0 or kind == "heading":
            continue
        units = [f"{lines[0]}\n{x}" for x in lines[1:]] if kind == "table" else [u for x in lines if (u := re.sub(r"^\s*(?:[-*•]|\d+\.)\s+", "", x).strip())]
        asked = [units] if len("Ask about:\n" + "\n".join(f"{i}. {u}" for i, u in enumerate(units))) <= 4 * 8000 else [[u] for u in units]
        prompts = ["Ask about:\n" + "\n".join(f"{i}. {u}" for i, u in enumerate(some)) for some in asked]
        questions = [q["question"] for answer in first_words(prompts) if answer != "no" for q in json.loads(answer)["questions"]]
        kept = []
        for place, q in enumerate(questions):
            v = letters(q)
            if all(round(float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), 6) < 0.95 for _, _, w in kept):
                kept.append((place, q, v))
        if kept:
            want[f"src{r.doc_id % 10}", f"p1-{r.doc_id}"] = [(place, q) for place, q, _ in kept[:20]]
    assert {k: sorted(x) for k, x in got.items()} == want


def test_metric_values(spark):
    cases = [(["a", "b"], ["a", "x", "b"], 5 / 6, 1.0), (["a"], ["b", "c", "a"], 1 / 3, 1 / 3), (["a", "b"], ["c", "a", "b"], (1 / 2 + 2 / 3) / 2, 1 / 2), ([], ["a"], 0.0, 0.0)]
    df = spark.createDataFrame([(e, r) for e, r, *_ in cases], "e array<string>, r array<string>")
    got = df.select(R.average_precision(R.F.col("e"), R.F.col("r")), R.reciprocal_rank(R.F.col("e"), R.F.col("r")), R.recall(R.F.col("e"), R.F.col("r"), 2)).collect()
    for row, (_, _, ap, rr) in zip(got, cases):
        assert row[0] == pytest.approx(ap) and row[1] == pytest.approx(rr)
    assert got[2][2] == 0.5


def brute_rows(items):
    """(row, box_id) in reading order of one page's (y0, x0, box_id, height)."""
    out, row, y, h = [], -1, 0.0, 0.0
    for y0, x0, box_id, height in sorted(items):
        if row < 0 or abs(y0 - y) > max(2.0, min(height, h) // 2):
            row, y, h = row + 1, y0, height
        out.append((row, x0, box_id))
    return sorted(out)


def test_box_rows_cover_all_line_items(spark, tmp_path):
    keys = [1, 2, 9, 10, 999, 1000, 1001, 1005, 4001, 150_000]
    items = [(k, 3 * k + n, k + 5 * n, n, 0.01 * (n % 10)) for k in keys for n in range(1, 8)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    pages, want = {}, set()
    for k, part, supp, n, _ in sorted(items):
        pages.setdefault(k // 10 + 1, []).append((part, supp, n))
    for page, found in pages.items():
        boxes = []
        for order, (part, supp, n) in enumerate(found):
            if n < 7:
                boxes.append((float((supp * 53 + n * 97) % 680), float((part * 37) % 400), f"p{page}-b{order}", 30.0 + 10 * n))
        rows_of = brute_rows(boxes)
        for i, (row, _, box_id) in enumerate(rows_of):
            want.add((page, row, box_id, i - next(j for j, x in enumerate(rows_of) if x[0] == row)))
    got = [(r.page, r.row, r.box_id, r.place) for r in Q.QUERIES["box_rows"](spark, str(tmp_path)).collect()]
    assert len(got) == len(keys) * 6 and set(got) == want


def test_slug_ascii_reads_whole_texts(spark, tmp_path):
    texts = ["Ä " * 30 + "end of the text", "漢字" * 40 + " Last_Word", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.slug for r in Q.QUERIES["slug_ascii"](spark, str(tmp_path)).collect()}
    assert got == {0: "a-" * 30 + "end-of-the-text", 1: "last-word", 2: "untitled"}


def brute_greedy(rows, threshold, baseline=()):
    kept = []
    for i, label, v in sorted(rows):
        near = lambda w: round(float(np.dot(v, w) / max(np.linalg.norm(v) * np.linalg.norm(w), 1e-300)), 6) >= threshold  # noqa: E731, B023
        if not any(near(w) for _, own, w in [*kept, *baseline] if own == label):
            kept.append((i, label, v))
    return {i for i, _, _ in kept}


def test_greedy_and_pairs_in_blocks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 5)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(9, 6))
    rows = [(i, int(rng.integers(2)), (base[rng.integers(9)] + rng.normal(size=6) * 0.3).tolist()) for i in range(120)] + [(200, 0, [0.0] * 6), (201, 0, [0.0] * 6)]
    schema = "id long, label int, vector array<double>"
    df = spark.createDataFrame(rows, schema).repartition(3)
    pairs = {(r.a, r.b) for r in R.near_pairs(df, 0.9).collect()}
    cos = lambda v, w: round(float(np.dot(v, w) / max(np.linalg.norm(v) * np.linalg.norm(w), 1e-300)), 6)
    assert pairs == {(i, j) for i, a, v in rows for j, b, w in rows if i < j and a == b and cos(v, w) >= 0.9}
    assert {r.id for r in R.greedy_unlike(df, 0.9).collect()} == brute_greedy(rows, 0.9)
    old = [(1000 + i, i % 2, base[i].tolist()) for i in range(5)]
    got = {r.id for r in R.greedy_unlike(df, 0.9, spark.createDataFrame(old, schema)).collect()}
    assert got == brute_greedy(rows, 0.9, old) and len(got) < 100
    assert R.greedy_unlike(df.limit(0), 0.9).count() == 0


def test_knn_in_blocks_matches_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(70)]
    df = spark.createDataFrame(rows, "doc long, vector array<double>").repartition(3)
    got = {}
    for r in R.knn(df.where("doc % 10 = 0").withColumnRenamed("doc", "query"), df, 6).collect():
        got.setdefault(r.query, []).append((r.rank, r.doc))
    cos = lambda v, w: round(float(np.dot(v, w) / max(np.linalg.norm(v) * np.linalg.norm(w), 1e-300)), 6)
    for i, v in rows[::10]:
        want = sorted((-cos(v, w), j) for j, w in rows if j != i)[:6]
        assert [d for _, d in sorted(got[i])] == [j for _, j in want]


def test_p95_is_the_floor_of_the_place(spark):
    rows = [("a", float(i % 7)) for i in range(100)] + [("b", 1.0), ("c", None)]
    got = {r.k: r.p95 for r in R.p95(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert got == {"a": sorted(float(i % 7) for i in range(100))[94], "b": 1.0}


def test_run_differences_and_drift(spark):
    a, b = (spark.createDataFrame([(1, x)], "model int, index string") for x in ("i", "j"))
    assert [tuple(r) for r in R.run_differences(a, b, ["model", "index"]).collect()] == [("index", "i", "j")]
    n = spark.createDataFrame([(1, 5), (2, 5), (3, 30), (4, 30)], "d int, n int")
    assert [r[0] for r in n.select(R.drift_warning(R.F.col("d"), R.F.col("n"))).collect()] == [False, True, False, True]
