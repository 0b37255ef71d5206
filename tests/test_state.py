"""Streams with keyed state: several batches, restarts, replays and random orders of arrival."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from sedimark.operators.events import fold
from sedimark.streaming import events as S
from sedimark.streaming import state

EVENT = "entry_id long, event_id long, event_type string, ts timestamp, valid_created boolean, level string, nth long"


class Feed:
    """A folder that gets files, and a stream over it that is started anew for each."""

    def __init__(self, spark, tmp_path, schema, make):
        self.spark, self.path, self.schema, self.make = spark, tmp_path, schema, make
        (tmp_path / "in").mkdir()
        self.n = 0

    def send(self, rows):
        self.n += 1
        (self.path / "in" / f"{self.n:05}.json").write_text("\n".join(json.dumps(r) for r in rows))
        state.run_to_end(self.make(S.read_lines(self.spark, str(self.path / "in"), self.schema)), str(self.path / "out"), str(self.path / "checkpoint"))

    def out(self, schema):
        return state.batches(self.spark, str(self.path / "out"), schema)


def event(entry, i, kind, second, valid=True, level=None, nth=None):
    return {"entry_id": entry, "event_id": i, "event_type": kind, "ts": f"2026-01-01T00:{second // 60:02}:{second % 60:02}Z", "valid_created": valid, "level": level, "nth": i if nth is None else nth}


def test_first_arrivals_let_each_id_in_once(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVENT, state.first_arrivals)
    feed.send([event(1, 5, "b", 2, nth=7), event(1, 5, "first", 2, nth=3), event(1, 5, "c", 2, nth=9), {**event(2, 6, "x", 1), "level": None}])
    feed.send([event(1, 5, "late", 0, nth=0), event(3, 7, "new", 4), {**event(3, 8, "no id", 4), "event_id": None}])
    feed.send([event(1, i, "again", 0) for i in (5, 6, 7)])
    got = feed.out(EVENT).collect()
    assert sorted((r.event_id, r.event_type, r.batch) for r in got) == [(5, "first", 0), (6, "x", 0), (7, "new", 1)]
    assert {r.ts.isoformat() for r in got} == {"2026-01-01T00:00:02", "2026-01-01T00:00:01", "2026-01-01T00:00:04"}


def test_fold_is_kept_up_to_date_in_any_order_of_arrival(spark, tmp_path):
    rng = random.Random(3)
    kinds = ["created", "reviewed", "reviewed", "deprecated", "created"]
    events = [event(rng.randrange(8), i, rng.choice(kinds), rng.randrange(600), rng.random() < 0.7, rng.choice([None, "phd", "expert", "other"])) for i in range(120)]
    order = rng.sample(events, len(events))
    feed = Feed(spark, tmp_path, EVENT, state.folded)
    for a, b in ((0, 40), (40, 41), (20, 80), (80, 120)):  # some twice
        feed.send(order[a:b])
    rows = feed.out(state.FOLDED)
    last = rows.groupBy("entry_id").agg(F.max_by(F.struct("created_event", "n_reviews", "deprecated", "level"), "batch").alias("s")).select("entry_id", "s.*")
    every = spark.read.schema(EVENT).json(str(tmp_path / "in")).dropDuplicates(["event_id"])
    want = fold(every).select("entry_id", "created_event", F.size("review_chain").cast("long").alias("n_reviews"), "deprecated", "level")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
    # one event touches one entry
    assert rows.where("batch = 1").count() <= 1


def test_fold_and_job_states_pass_no_event_through_python(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for made in (state.folded(S.read_lines(spark, str(tmp_path / "in"), EVENT)), S.job_states(S.read_lines(spark, str(tmp_path / "in"), S.STAGE))):
        plan = made._jdf.queryExecution().analyzed().toString()
        assert "Pandas" not in plan and "Python" not in plan


def test_job_states_go_on_from_batch_to_batch(spark, tmp_path):
    feed = Feed(spark, tmp_path, S.STAGE, S.job_states)
    feed.send([{"job": "a", "ts": f"2026-01-01T00:00:{s:02}Z", "type": "work-progress", "current": c, "total": 70} for s, c in ((14, 20), (12, 10))])
    feed.send([{"job": "a", "ts": "2026-01-01T00:00:15Z", "type": "work-progress", "current": 30, "total": 70}, {"job": "b", "ts": "2026-01-01T00:00:01Z", "type": "odd", "current": 1, "total": 1}])
    feed.send([{"job": "a", "ts": "2026-01-01T00:00:01Z", "type": "work-failed", "current": None, "total": None}])  # late, but its batch comes last
    rows = {(r.job, r.batch): r for r in feed.out("job string, stage string, n_events long, n_errors long, current long, total long, rate double, eta double").collect()}
    assert set(rows) == {("a", 0), ("a", 1), ("b", 1), ("a", 2)}
    assert rows["a", 0][1:8] == ("running", 2, 0, 20, 70, None, None) and rows["b", 1][1:8] == ("idle", 0, 0, None, None, None, None)
    assert rows["a", 1].rate == pytest.approx(0.3 * 10 + 0.7 * 5) and rows["a", 1].eta == pytest.approx(40 / 6.5)
    assert rows["a", 2][1:6] == ("failed", 4, 1, 30, 70) and rows["a", 2].rate == rows["a", 1].rate


LINE = "job string, ts timestamp, type string, current long, total long, nth long"


def line(job, second, kind, current=None, total=None):
    return {"job": job, "ts": f"2026-01-01T00:{second // 60:02}:{second % 60:02}Z", "type": kind, "current": current, "total": total, "nth": second}


def test_timelines_keep_all_events_over_restarts_and_tell_silence(spark, tmp_path):
    feed = Feed(spark, tmp_path, LINE, lambda rows: state.timelines(rows, "1 minute", "10 seconds"))
    feed.send([line("a", 2, "work-progress", 10, 70), line("a", 0, "model-loading"), line("a", 1, "model-loaded"), line("b", 3, "model-loading"), line("b", 4, "nonsense")])
    feed.send([line("a", 4, "work-progress", 20, 70), line("a", 5, "work-progress", 30, 70), line("c", 6, "model-loading")])
    feed.send([line("a", 9, "work-failed"), line("c", 500, "model-loaded")])
    feed.send([line("d", 501, "model-loading")])
    rows = sorted(feed.out("job string, seq long, at timestamp, type string, stage string, n_errors long, current long, total long, rate double, eta double, timeline array<string>").collect(), key=lambda r: (r.job, r.seq))
    a = [r for r in rows if r.job == "a"]
    assert [(r.seq, r.type, r.stage) for r in a] == [(1, "model-loading", "loading"), (2, "model-loaded", "ready"), (3, "work-progress", "running"), (4, "work-progress", "running"), (5, "work-progress", "running"), (6, "work-failed", "failed")]
    assert a[4].rate == pytest.approx(0.3 * 10 + 0.7 * 5) and a[4].eta == pytest.approx(40 / 6.5) and a[3].rate is None
    assert a[5].timeline == [r.type for r in a] and a[5].n_errors == 1 and a[2].at.second == 2
    # b went silent after it began to load, and nobody else did
    assert [(r.type, r.stage) for r in rows if r.job == "b"] == [("model-loading", "loading"), ("stalled", "stalled")]
    assert {r.job for r in rows if r.type == "stalled"} == {"b"}


def test_a_batch_costs_the_same_late_in_a_stream(spark, tmp_path):
    """State rows read and written a batch follow the batch and not what came before it."""
    feed = Feed(spark, tmp_path, EVENT, state.first_arrivals)
    sizes = []
    for n in range(6):
        feed.send([event(i, 1000 * n + i, "x", 1) for i in range(20)])
        sizes.append(feed.out(EVENT).where(F.col("batch") == n).count())
    assert sizes == [20] * 6


def test_ids_are_let_in_without_a_call_for_each_and_a_batch_may_run_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(event(i % 7, i, "x", 1)) for i in range(20_000)))

    def run():
        began = time.perf_counter()
        q = S.ingest(S.read_lines(spark, str(tmp_path / "in"), EVENT), str(tmp_path / "log"), str(tmp_path / "cp"))
        assert q.awaitTermination(300) and q.exception() is None
        return spark.read.parquet(str(tmp_path / "log")).agg(F.count("*"), F.count_distinct("event_id")).first(), time.perf_counter() - began

    kept, took = run()
    assert tuple(kept) == (20_000, 20_000) and took < 30
    # a stop between the batch's rows and its mark: it runs again and its own rows don't count as known
    for mark in (tmp_path / "cp" / "commits").glob("*0*"):
        mark.unlink()
    assert tuple(run()[0]) == (20_000, 20_000)
    # another stream over the same log begins with its ids
    q = S.ingest(S.read_lines(spark, str(tmp_path / "in"), EVENT), str(tmp_path / "log"), str(tmp_path / "cp2"))
    assert q.awaitTermination(300) and q.exception() is None
    assert spark.read.parquet(str(tmp_path / "log")).count() == 20_000
