"""Streams with keyed state: events let in once, the fold kept up to date out of order, and timelines of jobs.

State lives in RocksDB and is kept by key, so what a batch costs depends on the
keys that it touches and not on what has gone before; checkpoints are in the
query's own folder, which all machines share. Each function returns a streaming
DataFrame; :func:`run_to_end` appends what it gives to a table, a folder a batch, so
that a batch that runs again after a failure replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from sedimark.operators.events import LEVELS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The stage that each type of worker event leads to.
STAGES = {"model-loading": "loading", "model-loaded": "ready", "work-progress": "running", "work-complete": "completed", "model-unloading": "unloading", "model-unloaded": "idle", "work-failed": "failed"}


def start(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Run the stream ``rows`` over all that is there now, in update mode, into ``out``/batch=n."""
    spark = rows.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # a query keeps the settings with which it starts

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    try:
        return rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)


def run_to_end(rows: DataFrame, out: str, checkpoint: str) -> None:
    """:func:`start`, waited for; an error of the stream is raised."""
    q = start(rows, out, checkpoint)
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def batches(spark: SparkSession, out: str, schema: StructType | str) -> DataFrame:
    """What :func:`run_to_end` has written so far, with the number of each row's ``batch``."""
    from sedimark.sources.files import or_empty

    return or_empty(spark, lambda: spark.read.schema(schema).option("basePath", out).parquet(out).withColumn("batch", F.col("batch").cast("long")), schema, "batch long")


def first_arrivals(events: DataFrame, key: str = "event_id", order: tuple[str, ...] = ("nth",), known: DataFrame | None = None) -> DataFrame:
    """``events`` without the rows whose ``key`` an earlier batch had, and of those of one batch with one key the first by ``order``.

    ``known`` (key), a stream too, are keys that count as seen from the batch on with
    which they come. The state is a key's first row and the times of its batches, kept
    by Spark's own aggregates, so no row crosses to Python. Rows without a key are left out.
    """
    batch = F.current_timestamp()  # in a stream, the time with which its batch was planned; a batch that runs again has it again
    rows = events.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.struct(*events.columns).alias("e"), F.struct(*(x for c in order for x in (F.col(c).isNull(), F.col(c)))).alias("o"), batch.alias("at"))
    if known is not None:
        nothing = (F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("e", "o"))
        rows = rows.unionByName(known.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *nothing, batch.alias("at")))
    seen = rows.groupBy("key").agg(F.min_by("e", "o").alias("e"), F.count_if(F.col("e").isNull()).alias("known"), F.min("at").alias("first"), F.max("at").alias("last"))
    return seen.where((F.col("known") == 0) & (F.col("first") == batch) & (F.col("last") == batch)).select("e.*")


FOLDED = "entry_id long, created_event long, n_reviews long, deprecated boolean, level string, n_events long"


def folded(events: DataFrame) -> DataFrame:
    """FOLDED rows of the entries to which a batch of ``events`` (entry_id, event_id, event_type, ts, valid_created, level) brings new ones.

    An event finds its place by (ts, event_id) however late it comes, an id that is
    there already changes nothing, and no entry is folded but those that a batch
    touches. The last row of an entry is its state; it has the rows that the fold of
    all events together has. The state is an entry's ids, its last valid 'created' and
    its changes, kept by Spark's own aggregates, so no event crosses to Python.
    """
    at = F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    made = (F.col("event_type") == "created") & F.coalesce("valid_created", F.lit(False))
    known = F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")), F.lit(0).cast("long"))
    change = F.struct(at.alias("at"), (F.col("event_type") == "deprecated").alias("ends"), known.alias("level"))
    new = events.where("entry_id is not null and event_id is not null and ts is not null").dropDuplicates(["entry_id", "event_id"])
    changes = F.collect_list(F.when(F.col("event_type").isin("reviewed", "deprecated"), change))
    entries = new.groupBy("entry_id").agg(F.max(F.when(made, at)).alias("born"), changes.alias("changes"), F.count("*").alias("n_events")).where("born is not null")
    chain = entries.select("entry_id", "born", "n_events", F.filter("changes", lambda c: c["at"] > F.col("born")).alias("chain"))
    level = F.get(F.array(*map(F.lit, LEVELS)), (F.array_min(F.transform("chain", lambda c: c["level"])) - 1).cast("int"))
    return chain.select("entry_id", F.col("born.event_id").alias("created_event"), F.size("chain").cast("long").alias("n_reviews"), F.exists("chain", lambda c: c["ends"]).alias("deprecated"), F.coalesce(level, F.lit("synthetic")).alias("level"), "n_events")


TIMELINE = "job string, seq long, at_us long, type string, stage string, n_errors long, current long, total long, rate double, eta double, timeline array<string>"
#: Types after which a job's whole timeline is told.
CLOSING = {"work-complete", "work-failed", "model-unloaded", "stalled"}


class _Timeline(StatefulProcessor):
    """A job's stage and progress, the list of its events, and a timer for its silence."""

    def __init__(self, stall_ms: int) -> None:
        self.stall_ms = stall_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "seq long, stage string, errors long, reports long, at_ms long, current long, total long, rate double")
        self.line = handle.getListState("timeline", "type string")

    @staticmethod
    def row(key, kind: str, at_us: int, s: list, line: list[str]) -> dict:
        seq, stage, errors, reports, _, current, total, rate = s
        told = reports >= 3 and rate is not None and total is not None
        whole = [*line] if kind in CLOSING else None
        return {"job": key[0], "seq": seq, "at_us": at_us, "type": kind, "stage": stage, "n_errors": errors, "current": current, "total": total, "rate": rate if told else None, "eta": max(0, total - current) / rate if told else None, "timeline": whole}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = list(self.state.get()) if self.state.exists() else [0, "idle", 0, 0, None, None, None, None]
        out, line = [], [x[0] for x in self.line.get()]
        old = len(line)
        for r in pd.concat(list(rows)).sort_values(["at", "nth"], kind="stable").itertuples(index=False):
            if r.type not in STAGES:
                continue
            s[0], s[1], s[2] = s[0] + 1, STAGES[r.type], s[2] + (r.type == "work-failed")
            if r.type == "work-progress" and not pd.isna(r.current):
                now, done = int(r.at) // 1000, int(r.current)
                if s[3] and now > s[4] and done > s[5]:
                    fresh = 1000 * (done - s[5]) / (now - s[4])
                    s[7] = fresh if s[7] is None else 0.3 * fresh + 0.7 * s[7]
                s[3:7] = s[3] + 1, now, done, None if pd.isna(r.total) else int(r.total)
            line.append(r.type)
            out.append(self.row(key, r.type, int(r.at), s, line))
        if not out:
            return
        self.line.appendList([(x,) for x in line[old:]])
        self.state.update(tuple(s))
        for t in list(self.handle.listTimers()) if self.stall_ms else []:
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        if self.stall_ms and STAGES[out[-1]["type"]] in ("loading", "running"):
            self.handle.registerTimer(out[-1]["at_us"] // 1000 + self.stall_ms)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = list(self.state.get())
        s[0], s[1] = s[0] + 1, "stalled"
        self.line.appendValue(("stalled",))
        self.state.update(tuple(s))
        yield _frame([self.row(key, "stalled", expiredTimerInfo.getExpiryTimeInMs() * 1000, s, [x[0] for x in self.line.get()])])

    def close(self) -> None:
        pass


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    for c in ("current", "total"):
        out[c] = out[c].astype("Int64")
    return out


def timelines(events: DataFrame, stall: str | None = None, late: str = "1 minute") -> DataFrame:
    """(job, seq, at, type, stage, n_errors, current, total, rate, eta, timeline): each event of ``events`` (job, ts, type, current, total, nth) of a known type, and the job's state after it.

    Events of a batch apply in the order of (ts, nth), batches as they come; events of
    unknown types change nothing. The state keeps the list of a job's events, which
    its closing rows tell whole. A job that loads or runs and says nothing for
    ``stall`` of event time (by the watermark, which waits ``late``; what is later still is left out) gets a row of
    type 'stalled'. rate and eta are those of ``job_states``.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    rows = events.select("job", F.col("ts").cast("timestamp").alias("ts"), at, "type", "current", "total", "nth")
    stall_ms = 0 if stall is None else int(pd.Timedelta(stall).total_seconds() * 1000)
    if stall_ms:
        rows = rows.withWatermark("ts", late)
    told = rows.groupBy("job").transformWithStateInPandas(_Timeline(stall_ms), TIMELINE, "Update", "EventTime" if stall_ms else "None")
    return told.withColumn("at_us", F.timestamp_micros("at_us")).withColumnRenamed("at_us", "at")
