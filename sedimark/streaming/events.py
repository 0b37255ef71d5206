"""Streams of events: idempotent ingestion into a log, the fold kept up to date, job states and time left."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sedimark.operators.events import fold
from sedimark.sources.files import or_empty
from sedimark.streaming import state
from sedimark.streaming.state import STAGES

STAGE = "job string, ts timestamp, type string, current long, total long"


def read_lines(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1000, numbered: bool = False) -> DataFrame:
    """A folder of NDJSON files as a stream; ``numbered``: with ``file``, ``start`` and ``nth``, by which lines are in order."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)
    if not numbered:
        return rows

    def count(batches):
        n = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(n, n + batch.num_rows), pa.int64())], [*batch.schema.names, "nth"])
            n += batch.num_rows

    placed = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return placed.mapInArrow(count, StructType([*placed.schema.fields]).add("nth", "long"))


def ingest(events: DataFrame, log: str, checkpoint: str, key: str = "event_id"):
    """Append a stream of events (event_id, entry_id, ...) to the Parquet log, each id once: the first in the order of ``file``, ``start`` and ``nth``, if there are these columns.

    Ids that have come are kept as keyed state, so a batch costs the same however
    long the log is. A stream with a new checkpoint begins with the ids of the log,
    which are written once beside the checkpoint and come with its first batch.
    Batches are folders of their own (run, batch), so one that runs again after a
    failure replaces itself.
    """
    spark, ids = events.sparkSession, f"{checkpoint}-known"
    schema = events.select(key).schema
    if or_empty(spark, lambda: spark.read.text(f"{ids}/_SUCCESS"), None) is None:  # none yet, or a write that did not end
        or_empty(spark, lambda: spark.read.parquet(log).select(key), schema).distinct().write.mode("overwrite").parquet(ids)
    known = spark.readStream.schema(schema).parquet(ids)
    order = tuple(c for c in ("file", "start", "nth") if c in events.columns) or tuple(c for c in events.columns if c != key)[:1]
    run = f"r{zlib.crc32(checkpoint.encode()):08x}"
    return state.start(state.first_arrivals(events, key, order, known), f"{log}/run={run}", checkpoint)


def process(rows: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Put a stream of elements (slug, element_id, ...) through ``work``, batch by batch.

    ``out`` gets, in a folder for each batch, a line for its start, for each row of ``work`` (slug,
    element_id, kept, skipped) and for its end: complete, or the error, after which
    the query fails with it.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark, own = batch.sparkSession, f"{out}/batch={number}"

        def tell(kind: str, text: str | None = None, mode: str = "append") -> None:
            told = spark.createDataFrame([(kind, text)], "type string, message string")
            told.selectExpr("type", "cast(null as string) as slug", "cast(null as string) as element_id", "cast(null as long) as kept", "message").write.mode(mode).parquet(own)

        # a batch that runs again after a failure begins its lines anew
        tell("start", mode="overwrite")
        try:
            work(batch).selectExpr("'element' as type", "slug", "element_id", "cast(kept as long) as kept", "skipped as message").write.mode("append").parquet(own)
        except Exception as e:
            tell("error", str(e)[:500])
            raise
        tell("complete")

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refold(log: DataFrame, touched: DataFrame) -> DataFrame:
    """The state of the entries in ``touched``, from all their events: late ones find their place, as the fold sorts first."""
    return fold(log.join(touched.select("entry_id").distinct(), "entry_id", "left_semi"))


def job_states(events: DataFrame) -> DataFrame:
    """A row (job, stage, n_events, n_errors, current, total, rate, eta) a batch and job; events of unknown type change nothing.

    Events of a batch apply in the order of ts, batches as they come. rate is the
    smoothed number of items a second over steps that make progress (new steps weigh
    0.3), eta the seconds left by it, from the third report on. The state is a job's
    counts, its last stage and its reports of progress, kept by Spark's own aggregates.
    """
    stages = F.create_map(*(F.lit(x) for pair in STAGES.items() for x in pair))
    # in a stream, the time with which its batch was planned: it has the batches in their order
    rows = events.select("job", "type", "current", "total", F.try_element_at(stages, F.col("type")).alias("stage"), F.struct(F.current_timestamp().alias("came"), F.col("ts").isNull().alias("none"), "ts").alias("at"))
    report = F.when((F.col("type") == "work-progress") & F.col("current").isNotNull(), F.struct("at", "current", "total"))
    last = F.max_by("stage", F.when(F.col("stage").isNotNull(), F.col("at")))
    jobs = rows.groupBy("job").agg(F.coalesce(last, F.lit("idle")).alias("stage"), F.count("stage").alias("n_events"), F.count_if(F.col("type") == "work-failed").alias("n_errors"), F.collect_list(report).alias("reports"))
    start = F.struct(F.lit(None).cast("double").alias("at"), F.lit(None).cast("long").alias("current"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("double").alias("rate"))

    def step(s, r):
        now = F.unix_micros(r["at"]["ts"].cast("timestamp")) / 1e6
        fresh = F.when((now > s["at"]) & (r["current"] > s["current"]), (r["current"] - s["current"]) / (now - s["at"]))
        rate = F.when(fresh.isNull(), s["rate"]).when(s["rate"].isNull(), fresh).otherwise(0.3 * fresh + 0.7 * s["rate"])
        return F.struct(now.alias("at"), r["current"].alias("current"), r["total"].alias("total"), rate.alias("rate"))

    # an array of one binds the fold, so that it is made once
    folds = F.array(F.aggregate(F.sort_array("reports"), start, step))
    jobs = jobs.select("job", "stage", "n_events", "n_errors", (F.size("reports") >= 3).alias("enough"), F.inline(folds))
    told = F.col("enough") & F.col("rate").isNotNull() & F.col("total").isNotNull()
    return jobs.select("job", "stage", "n_events", "n_errors", "current", "total", F.when(told, F.col("rate")).alias("rate"), F.when(told, F.greatest(F.lit(0), F.col("total") - F.col("current")) / F.col("rate")).alias("eta"))


def last_stages(events: DataFrame) -> DataFrame:
    """(job, stage, n_events, n_errors) of events (job, type, at) in batch form: the stage of the last known type by ``at``; 'idle' and no events where no type is known."""
    stages = F.create_map(*(F.lit(x) for pair in STAGES.items() for x in pair))
    rows = events.withColumn("stage", F.try_element_at(stages, F.col("type")))
    last = F.max_by(F.col("stage"), F.when(F.col("stage").isNotNull(), F.col("at")))
    return rows.groupBy("job").agg(F.coalesce(last, F.lit("idle")).alias("stage"), F.count("stage").alias("n_events"), F.count_if(F.col("type") == "work-failed").alias("n_errors"))


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """An extension: counts a window and type; events later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
