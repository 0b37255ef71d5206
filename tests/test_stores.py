"""Tables and documents that are changed in place."""

import json
import os
import pickle
import threading

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sedimark.functions import text as T
from sedimark.operators import chunks
from sedimark.sources import files, sinks, stores

EVENTS = "ordinal int, event_id string, timestamp_utc string, event_type string, entry_id string, schema_version int, payload string"


def events(spark, ids, who="x", payload='{"n": 1}'):
    return spark.createDataFrame([(n, f"e{i}", "2026-01-01T00:00:00Z", "created", who, 1, payload) for n, i in enumerate(ids)], EVENTS)


def test_eight_writers_append_at_once_and_lose_and_repeat_nothing(spark, tmp_path):
    path, errors = str(tmp_path / "datasets" / "log"), []

    def write(n):
        try:
            sinks.append_events(spark, path, events(spark, range(3 * n, 3 * n + 6), f"w{n}"))
        except Exception as e:  # noqa: BLE001  told below
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert errors == []
    got = files.event_log(spark, path).collect()
    assert sorted(int(r.event_id[1:]) for r in got) == list(range(27))
    made = len(files.commits(spark, path))  # a writer whose ids the others have brought makes none
    assert 5 <= made <= 8
    # nothing new makes no commit, and what no marker names isn't read
    sinks.append_events(spark, path, events(spark, [1, 2]))
    spark.createDataFrame([("x",)], "value string").write.text(f"{path}/append-lost")
    assert len(files.commits(spark, path)) == made and files.event_log(spark, path).count() == 27


def test_a_claim_has_one_winner(spark, tmp_path):
    (tmp_path / "c").mkdir()
    marker, won = str(tmp_path / "c" / "000000000000"), []
    threads = [threading.Thread(target=lambda n=n: won.append((stores.claim(spark, marker, f"f{n}"), f"f{n}"))) for n in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    (winner,) = [name for ok, name in won if ok]
    assert (tmp_path / "c" / "000000000000").read_text() == winner


def test_payloads_that_arent_json_are_told_and_fail_nobody(spark, tmp_path):
    path = str(tmp_path / "log")
    bad = sinks.append_events(spark, path, events(spark, [1]).unionByName(events(spark, [2], payload="{broken")))
    assert [r.event_id for r in bad.collect()] == ["e2"] and [r.event_id for r in files.event_log(spark, path).collect()] == ["e1"]


def test_upsert_writes_the_buckets_of_the_batch_alone(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id long, v string, at int"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    assert stores.stored(spark, path, schema).count() == 0
    stores.upsert_stored(rows(*[(i, "old", 0) for i in range(200)]), path, "id", "at", 16)
    before = {str(p) for p in (tmp_path / "t").rglob("*.parquet")}
    n = stores.upsert_stored(rows((3, "first", 1), (3, "last", 2), (500, "new", 1), (None, "null", 1)), path, "id", "at", 16)
    after = {str(p) for p in (tmp_path / "t").rglob("*.parquet")}
    assert n == len({p.rsplit("/", 1)[0] for p in after - before}) <= 3 and len(before & after) == len(before) - len(before - after) >= 13
    stores.upsert_stored(rows((None, "null again", 1)), path, "id", "at", 16)
    got = {r.id: r.v for r in stores.stored(spark, path, schema).collect()}
    assert got == {**{i: "old" for i in range(200)}, 3: "last", 500: "new", None: "null again"} and stores.stored(spark, path, schema).count() == 202


def test_deleting_rows_and_documents(spark, tmp_path):
    path, schema = str(tmp_path / "stored"), "id long, v string, bucket int"
    stores.upsert_stored(spark.createDataFrame([(i, f"v{i}") for i in range(40)] + [(None, "none")], "id long, v string"), path, "id", buckets=8)
    before = {p: p.name for p in (tmp_path / "stored").rglob("*.parquet")}
    bucket = {r.id: r.bucket for r in stores.stored(spark, path, schema).collect()}
    whole = [i for i in bucket if bucket[i] == bucket[7]]  # all of a bucket
    gone = {*whole, 8, None, 999}
    keys = spark.createDataFrame([(i,) for i in gone] + [(8,)], "id long")
    assert stores.delete_stored(keys, path, schema, "id", buckets=8) == len(gone) - 1
    assert {r.id for r in stores.stored(spark, path, schema).collect()} == set(bucket) - gone
    untouched = {p for p in before if p.parent.name not in {f"bucket={bucket[i]}" for i in gone if i in bucket}}
    assert all(p.exists() for p in untouched)
    assert stores.delete_stored(keys, path, schema, "id", buckets=8) == 0
    docs, table = tmp_path / "docs", tmp_path / "table"
    for slug in ("a", "b"):
        (docs / slug).mkdir(parents=True)
        (docs / slug / "html.html").write_text(slug)
    spark.createDataFrame([("a", 1), ("b", 2)], "slug string, n int").write.partitionBy("slug").parquet(str(table))
    assert stores.delete_document(spark, "a", [str(docs)], [str(table)]) == 2 and stores.delete_document(spark, "a", [str(docs)], [str(table)]) == 0
    assert [p.name for p in docs.iterdir()] == ["b"] and [r.slug for r in spark.read.parquet(str(table)).collect()] == ["b"]
    for bad in ("", "..", "a/b", "*", ".x"):
        with pytest.raises(ValueError, match="slug"):
            stores.delete_document(spark, bad, [str(docs)])
    assert [p.name for p in docs.iterdir()] == ["b"]


def test_upsert_of_repeated_ids_keeps_the_last(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    batch = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "id int, v string")
    assert sorted(map(tuple, chunks.upsert(table, batch, "id").collect())) == [(1, "a"), (2, "d"), (3, "e")]


def test_documents_are_written_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "docs")
    doc = lambda *r: spark.createDataFrame(list(r), "slug string, content string")
    assert stores.documents(spark, path).count() == 0
    stores.write_documents(doc(("a", "<p>ä\n1</p>"), ("b", None), ("c", "old")), path)
    assert {tuple(r) for r in stores.documents(spark, path).collect()} == {("a", "<p>ä\n1</p>"), ("c", "old")}
    assert (tmp_path / "docs/b/html.html").read_bytes() == b""
    with pytest.raises(Exception, match="not a slug"):  # a task fails after others have written
        stores.write_documents(doc(*[(f"d{i}", "new") for i in range(20)], ("c", "new"), ("../x", "new")).repartition(5), path)
    assert {r.slug for r in stores.documents(spark, path).collect()} == {"a", "c"} and not list((tmp_path / "docs").glob(".job*"))
    assert {r.content for r in stores.documents(spark, path).where("slug = 'c'").collect()} == {"old"}


def test_the_driver_holds_no_list_of_documents(spark, tmp_path):
    path = str(tmp_path / "many")
    want = {f"d{i}": f"text {i}" for i in range(2500)} | {"ä b%20": "odd", "_x": "low", "n.gz": "not packed"} | {f"big{i}": f"{i}" * 3_000_000 for i in range(3)}
    writer = stores._DocumentWriter(path, "html.html", "j")
    told = writer.write(Row(slug=s, content=c) for s, c in want.items())
    assert len(pickle.dumps(told)) < 2_000 and not [p for p in (tmp_path / "many").iterdir() if p.name != ".job-j"]
    writer.commit([told, None])
    assert sorted(p.name for p in (tmp_path / "many").iterdir()) == sorted(want)
    # neither of these is a document
    (tmp_path / "many" / "html.html").write_text("beside")
    (tmp_path / "many" / "none").mkdir()
    os.mkdir(os.fsencode(path) + b"/\xff")
    got = stores.documents(spark, path)
    assert len(got.inputFiles()) < 10 and {tuple(r) for r in got.collect()} == set(want.items())
    # a path that Arrow can't open is left to Spark
    (tmp_path / "a b" / "d").mkdir(parents=True)
    (tmp_path / "a b" / "d" / "html.html").write_text("ä")
    assert [tuple(r) for p in (tmp_path, f"file://{tmp_path}") for r in stores.documents(spark, f"{p}/a b").collect()] == [("d", "ä")] * 2


def test_edited_html_touches_the_metadata(spark, tmp_path):
    path = str(tmp_path / "docs")
    for slug in ("a", "b"):
        (tmp_path / "docs" / slug).mkdir(parents=True)
        (tmp_path / "docs" / slug / "meta.json").write_text(json.dumps({"filename": f"{slug}.pdf", "pages": 3, "last_touched_utc": "2025"}))
    missing = stores.overwrite_html(spark.createDataFrame([("a", "<h1>new</h1>"), ("zz", "x")], "slug string, content string"), path, "2026-01-01T00:00:00Z")
    assert [r.slug for r in missing.collect()] == ["zz"]
    assert {tuple(r) for r in stores.documents(spark, path).collect()} == {("a", "<h1>new</h1>")}
    assert json.loads((tmp_path / "docs/a/meta.json").read_text()) == {"filename": "a.pdf", "pages": 3, "last_touched_utc": "2026-01-01T00:00:00Z"}
    assert json.loads((tmp_path / "docs/b/meta.json").read_text())["last_touched_utc"] == "2025"


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_are_utc_in_any_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        at = F.timestamp_seconds(F.lit(1767225600))
        assert tuple(spark.range(1).select(T.iso_seconds(at), T.compact_time(at)).head()) == ("2026-01-01T00:00:00Z", "20260101T000000")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
