"""Files written by hand, read through the sources; sinks read back; streams against their batch form."""

import json

import pytest
from pyspark.sql import functions as F

from sedimark.functions import markup as M
from sedimark.functions import validation as V
from sedimark.operators import chunks
from sedimark.operators import curation as Cu
from sedimark.operators.events import fold
from sedimark.sources import files, sinks
from sedimark.streaming import events as S


def event(i, **other):
    return {"event_id": f"e{i}", "timestamp_utc": "2026-04-29T10:00:00Z", "event_type": "created", "entry_id": f"r{i}", "schema_version": 1, "payload": {"n": i}} | other


def log(tmp_path, rows, slug="a"):
    p = tmp_path / slug / "datasets" / "events.jsonl"
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(p)


def test_event_log(spark, tmp_path):
    bad = ["{broken", json.dumps([1]), event(3, schema_version=0), event(4, event_type="x"), event(5, timestamp_utc="2026-02-30T10:00:00Z"), event(6, entry_id=""), event(7, payload=[1])]
    path = log(tmp_path, [event(1), "", "   ", *bad, event(2)])
    log(tmp_path, [event(9)], "b")
    got = files.event_log(spark, path).orderBy("ordinal").collect()
    assert [r.event_id for r in got] == ["e1", "e2"] and got[0].slug == "a" and json.loads(got[0].payload) == {"n": 1}
    assert files.quarantine(spark, path).count() == len(bad)
    assert files.event_log(spark, str(tmp_path / "none")).count() == 0
    assert {(r.slug, r.event_id) for r in files.event_log(spark, f"{tmp_path}/*/datasets/*.jsonl").collect()} == {("a", "e1"), ("a", "e2"), ("b", "e9")}
    assert {r.event_id for r in files.event_ids(spark, path).collect()} == {"e1", "e2", "e3", "e4", "e5", "e6", "e7"}


@pytest.mark.parametrize("text, good", [("2026-04-29", True), ("2026-04-29T10:00:00Z", True), ("2026-04-29T10:00:00.123+02:00", True), ("2026-13-01T00:00:00Z", False), ("2026-04-29T25:00:00Z", False), ("today", False), ("", False), (None, False)])
def test_timestamps(spark, text, good):
    assert spark.range(1).select(V.iso_timestamp(F.lit(text).cast("string"))).first()[0] is good


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(i, *(json.dumps(v) if k == "payload" else v for k, v in event(e, entry_id=who).items())) for i, (e, who) in enumerate([(1, "x"), (1, "y"), (2, "z")])]
    batch = spark.createDataFrame(rows, "ordinal int, event_id string, timestamp_utc string, event_type string, entry_id string, schema_version int, payload string")
    for _ in range(2):
        sinks.append_events(spark, path, batch)
        got = files.event_log(spark, path).collect()
        assert sorted((r.event_id, r.entry_id, r.payload) for r in got) == [("e1", "x", '{"n":1}'), ("e2", "z", '{"n":2}')]


def region(page, y):
    return [{"pageNumber": page, "polygon": [1.0, y, 2.0, y]}]


def test_layout_elements(spark, tmp_path):
    cells = [{"rowIndex": i, "columnIndex": j, "content": f" {i}{j} "} for i in range(4) for j in range(6)] + [{"rowIndex": 0, "columnIndex": 0, "content": "new"}]
    body = {
        "paragraphs": [
            {"role": "title", "content": " T ", "boundingRegions": region(2, 0.5)}, {"content": "low", "boundingRegions": region(1, 9)}, {"content": "high", "boundingRegions": region(1, 1)},
            {"role": "pageHeader", "content": "x", "boundingRegions": region(1, 0)}, {"content": "nowhere"}, {"content": "short", "boundingRegions": [{"pageNumber": 1, "polygon": [1.0]}]}, {"content": " ", "boundingRegions": region(1, 3)},
        ],
        "tables": [{"rowCount": 4, "columnCount": 6, "cells": cells, "boundingRegions": region(1, 1)}],
        "figures": [{"caption": {"content": "cap"}, "boundingRegions": region(1, 2)}, {"boundingRegions": region(1, 2)}],
    }
    for slug, name, doc in (("a", "1.json", {"paragraphs": []}), ("a", "2.json", body), ("b", "1.json", {"analyzeResult": body}), ("c", "1.json", {})):
        p = tmp_path / slug / "analyze" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(json.dumps(doc, indent=1))
    layouts = files.latest_layouts(spark, str(tmp_path))
    got = files.elements(layouts).orderBy("slug", "page_number", "top_y", "kind_rank", "pos").collect()
    for slug in "ab":
        own = [r for r in got if r.slug == slug]
        assert [r.content or r.caption for r in own if r.element_type != "table"] == ["high", "cap", "low", "T"]
        table = own[1]
        assert table.content.split("\n") == ["new | 01 | 02 | 03 | 04 | ...", "10 | 11 | 12 | 13 | 14 | ...", "20 | 21 | 22 | 23 | 24 | ...", "..."]
        assert table.table_full_content.split("\n")[3] == "30 | 31 | 32 | 33 | 34 | 35" and tuple(table.table_dims) == (4, 6)
        assert own[-1].element_type == "heading" and own[-1].element_id.startswith("p2-")
    assert {tuple(r) for r in files.element_counts(layouts).collect()} == {("a", 5), ("b", 5), ("c", 0)}


def test_middle_blocks(spark, tmp_path):
    page = {"para_blocks": [{"type": "text", "bbox": [1, 2, 3, 4]}, {"type": "text", "bbox": [1, 2, 3]}, {"type": "text", "bbox": ["a", 2, 3, 4]}], "discarded_blocks": [{"type": "discarded", "bbox": [0, 0, 1, 1]}]}
    (tmp_path / "m.json").write_text(json.dumps({"pdf_info": [page, {"page_size": [10, 20], "para_blocks": page["para_blocks"]}]}))
    got = files.middle_blocks(spark, str(tmp_path), [7, 3]).orderBy("page", "pos").collect()
    assert [(r.page, r.block_type, r.x0, r.width, r.height) for r in got] == [(3, "text", 1.0, 612.0, 792.0), (3, "discarded", 0.0, 612.0, 792.0), (7, "text", 1.0, 10.0, 20.0)]


def test_small_scans(spark, tmp_path):
    found = spark.createDataFrame([(1, 0, "title"), (2, 1, "odd"), (3, 2, "abandon")], "page int, idx int, class string")
    assert [(r.kind, r.reading_order) for r in files.detector_boxes(found, {"title": "heading"}, 1, 2).orderBy("page").collect()] == [("heading", 0), ("paragraph", 1)]
    assert files.migrated(found.withColumnRenamed("class", "kind")).where("kind = 'auxiliary'").count() == 1
    (tmp_path / "A b.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "c.pdf").write_bytes(b"no")
    (tmp_path / "d.txt").write_bytes(b"%PDF")
    assert [r.slug for r in files.pdfs(spark, str(tmp_path)).collect()] == ["a-b"]
    assert [tuple(r) for r in files.text_folder(spark, str(tmp_path / "d.txt")).collect()] == [("d", "%PDF")]
    keys = files.output_keys(F.lit("/x/doc/chunk/2026-section.jsonl")) + files.output_keys(F.lit("/x/doc/chunk/plain.jsonl"))
    assert list(spark.range(1).select(*keys).first()) == ["doc", "section", "doc", "unknown"]


def test_sidecars_and_sequence(spark, tmp_path):
    assert files.sidecars(spark, str(tmp_path), "s.json", "n int").count() == 0
    for slug, said in (("a", '{"n": 1}'), ("b", None), ("c", "not json")):
        (tmp_path / slug).mkdir()
        if said:
            (tmp_path / slug / "s.json").write_text(said)
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "slug string")
    found = files.with_sidecar(docs, files.sidecars(spark, str(tmp_path), "s.json", "n int"), "s")
    assert {r.slug: r.s and r.s.n for r in found.collect()} == {"a": 1, "b": None, "c": None}
    assert Cu.maybe(docs, "slug", "a").slug == "a" and Cu.maybe(docs, "slug", "z") is None
    rows = spark.createDataFrame([("a", 2, 0.0, 0, 0), ("a", 1, 5.0, 1, 0), ("a", 1, 5.0, 0, 3), ("b", 9, 0.0, 0, 0)], "slug string, page_number int, top_y double, kind_rank int, pos int")
    got = files.in_sequence(rows).orderBy("slug", "place").collect()
    assert [(r.slug, r.place, r.page_number, r.kind_rank) for r in got] == [("a", 0, 1, 0), ("a", 1, 1, 1), ("a", 2, 2, 0), ("b", 0, 9, 0)]


def test_images_blocks_and_contracts(spark, tmp_path):
    for name in ("b.png", "a.jpg", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    assert [r.name for r in files.images(spark, str(tmp_path)).collect()] == ["a.jpg", "b.png"] and bytes(files.images(spark, str(tmp_path), "b.png").first().content) == b"b.png"
    for bad in ("../x", "", ".x", "a/b"):
        with pytest.raises(ValueError):
            files.images(spark, str(tmp_path), bad)
    (tmp_path / "m.json").write_text(json.dumps({"pdf_info": [{"para_blocks": [{"type": "text"}, {"type": "text"}], "discarded_blocks": [{"type": "x"}]}, {"para_blocks": []}]}))
    assert files.total_blocks(spark, str(tmp_path / "m.json")) == 3
    good = spark.createDataFrame([], "slug string, page_number int, element_id string, element_type string, content string, more int")
    assert files.checked_elements(good) is good
    with pytest.raises(ValueError, match="content is None"):
        files.checked_elements(good.drop("content"))
    assert chunks.strategies() == ["section"] and chunks.chunker("section") is chunks.section_chunks
    with pytest.raises(KeyError, match="nothing"):
        chunks.chunker("nothing")
    ids = spark.createDataFrame([(["a", "b"],), (["a"],), (["a", "a"],), (None,)], "ids array<string>")
    assert [r[0] for r in ids.select(V.merge(F.col("ids"))).collect()] == [True, False, False, False]


def test_text_of_blocks():
    assert M.merged_text({"lines": [{"spans": [{"content": "a"}, {"content": "b "}]}, {"spans": []}, {"spans": [{"content": "c"}]}]}) == "ab c"
    assert M.merged_text({"text": "x", "blocks": [{"content": "y", "lines": [{"spans": [{"content": "z"}, {"html": "no"}]}]}, 3]}) == "x y z"
    assert M.merged_text({"lines": [{"text": "only"}]}) == "only" and M.merged_text([]) == M.merged_text({}) == ""


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "id string, chunk string, source_file string")
    sinks.replace_sources(rows(("1", "x", "a"), ("2", "y", "a"), ("3", "z", "b")), path)
    sinks.replace_sources(rows(("4", "new", "a")), path)
    assert {tuple(r) for r in spark.read.parquet(path).select("id", "source_file").collect()} == {("4", "a"), ("3", "b")}
    sinks.write_lines(spark.createDataFrame([("c", None)], "chunk_id string, title string"), str(tmp_path / "lines"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ['{"chunk_id":"c","title":null}']
    assert [r.chunk_id for r in files.chunk_lines(spark, str(tmp_path / "lines")).collect()] == ["c"]
    for slug in ("../x", "", ".hidden"):
        with pytest.raises(ValueError):
            sinks.without_document(spark.createDataFrame([("a",)], "slug string"), slug)


def test_stream_ingest_and_refold(spark, tmp_path):
    schema = "entry_id long, event_id long, event_type string, ts timestamp, valid_created boolean, level string"
    given = [(1, 1, "created", "2026-01-01 00:00:00", True, None), (1, 2, "reviewed", "2026-01-01 00:00:02", True, "phd"), (2, 3, "created", "2026-01-01 00:00:00", True, None)]
    late = [(1, 2, "deprecated", "2026-01-01 00:00:09", True, None), (1, 4, "reviewed", "2026-01-01 00:00:01", True, "expert")]
    src, out = str(tmp_path / "in"), str(tmp_path / "log")
    names = [c.split()[0] for c in schema.split(", ")]
    for n, part in enumerate((given, late)):
        p = tmp_path / "in" / f"{n}.json"
        p.parent.mkdir(exist_ok=True)
        p.write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in part))
        q = S.ingest(S.read_lines(spark, src, schema), out, str(tmp_path / "cp"))
        assert q.awaitTermination(120) and q.exception() is None
    kept = spark.read.parquet(out)
    assert sorted(r.event_id for r in kept.collect()) == [1, 2, 3, 4]
    got = {r.entry_id: r for r in S.refold(kept, spark.createDataFrame([(1,)], "entry_id long")).collect()}
    assert list(got) == [1] and got[1] == next(r for r in fold(kept).collect() if r.entry_id == 1)
    assert got[1].level == "expert" and [x.level for x in got[1].review_chain] == ["expert", "phd"]


def test_job_states(spark, tmp_path):
    rows = [("model-loading", 0, None), ("model-loaded", 1, None), ("work-progress", 2, 10), ("work-progress", 4, 20), ("odd", 5, None), ("work-progress", 5, 30)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"job": "j", "ts": f"2026-01-01 00:00:0{s}", "type": t, "current": c, "total": 70}) for t, s, c in rows))
    q = S.job_states(S.read_lines(spark, str(tmp_path / "in"), S.STAGE)).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    (r,) = spark.table("states").collect()
    assert (r.stage, r.n_events, r.n_errors, r.current) == ("running", 5, 0, 30)
    assert r.rate == pytest.approx(0.3 * 10 + 0.7 * 5) and r.eta == pytest.approx(40 / 6.5)
