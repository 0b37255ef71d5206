"""Queries of file sources, sinks and streams: each writes to the shared folder, reads that back and, where SQL can, is held against the tables that it began with."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimark.functions import text as T
from sedimark.operators import events as E
from sedimark.operators.scratch import shared_path, written
from sedimark.plans import inputs as I
from sedimark.plans.registry import query
from sedimark.sources import files, sinks, stores
from sedimark.streaming import events as S
from sedimark.streaming import ndjson
from sedimark.streaming import state


@query("SELECT 'e' || event_id AS event_id, 'r' || user_id AS entry_id, CAST(value AS VARCHAR) IS NOT NULL AS has_value FROM events WHERE event_id % 7 <> 0")
def src_event_log(spark, sf_dir):
    """Events appended twice to a log of JSON lines, some of them invalid, and read back."""
    path = shared_path(spark, "log")
    e = I.table(spark, sf_dir, "events")
    stamp = T.iso_seconds(F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_id") % 7 == 0, "unknown").otherwise("created")
    rows = e.select(F.col("event_id").alias("ordinal"), F.concat(F.lit("e"), "event_id").alias("event_id"), stamp.alias("timestamp_utc"), kind.alias("event_type"), F.concat(F.lit("r"), "user_id").alias("entry_id"), F.lit(1).alias("schema_version"), F.to_json(F.struct("value")).alias("payload"))
    for _ in range(2):
        sinks.append_events(spark, path, rows)
    log = files.event_log(spark, path)
    return log.select("event_id", "entry_id", F.get_json_object("payload", "$.value").isNotNull().alias("has_value"))



@query(f"""WITH {I.PARAGRAPHS} SELECT 'doc-' || doc_id AS slug, idx // 5 + 1 AS page_number, CASE WHEN role IN ('title', 'sectionHeading') THEN 'heading' ELSE 'paragraph' END AS element_type, 'p' || (idx // 5 + 1) || '-' || substr(sha256(trim(content)), 1, 8) AS element_id, idx AS pos FROM paragraphs WHERE (role IS NULL OR role <> 'pageFooter') AND trim(content) <> ''""")
def src_layout_elements(spark, sf_dir):
    """Documents as layouts with a region for each line, and the elements read from them."""
    p = I.paragraphs(spark, sf_dir)
    region = F.array(F.struct((F.floor(F.col("idx") / 5) + 1).cast("int").alias("pageNumber"), F.array(F.lit(0.0), F.col("idx").cast("double")).alias("polygon")).alias("r"))
    line = F.struct("idx", F.struct("role", "content", region.alias("boundingRegions")).cast(files.PARAGRAPH).alias("p"))
    whole = p.groupBy(F.concat(F.lit("doc-"), "doc_id").alias("slug")).agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["p"]).alias("paragraphs"))
    none = {k: F.array().cast(f"array<{t}>") for k, t in (("tables", files.TABLE), ("figures", files.FIGURE))}
    e = files.elements(whole.withColumns(none))
    return e.select("slug", F.col("page_number").cast("long").alias("page_number"), "element_type", "element_id", F.col("pos").cast("long").alias("pos"))


@query(f"""WITH {I.PARAGRAPHS} SELECT doc_id, count(*) AS n, sum(length(content))::BIGINT AS chars FROM paragraphs WHERE idx > 0 AND content <> '' GROUP BY 1""")
def snk_chunk_lines(spark, sf_dir):
    """Lines written as JSON lines with nulls kept, and read by schema."""
    path = shared_path(spark, "chunks")
    p = I.paragraphs(spark, sf_dir).where("idx > 0 and content <> ''")
    rows = p.select(F.concat("doc_id", F.lit("-"), "idx").alias("chunk_id"), F.lit(None).cast("string").alias("title"), F.col("role").alias("section_heading"), F.col("content").alias("chunk"), F.col("doc_id").cast("string").alias("source_file"))
    sinks.write_lines(rows, path)
    back = files.chunk_lines(spark, path)
    return back.groupBy(F.col("source_file").cast("long").alias("doc_id")).agg(F.count("*").alias("n"), F.sum(F.length("chunk")).alias("chars"))


@query("""WITH b AS (SELECT doc_id, source, 1 AS version FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 2 = 0)
SELECT doc_id, source, 0 AS version FROM documents WHERE source NOT IN (SELECT source FROM b) UNION ALL SELECT * FROM b""")
def snk_replace_sources(spark, sf_dir):
    """A table partitioned by source, two of whose partitions are replaced."""
    path = shared_path(spark, "table")
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "source")
    sinks.replace_sources(docs.withColumn("version", F.lit(0)), path, "source")
    sinks.replace_sources(docs.where("source in ('src1', 'src2') and doc_id % 2 = 0").withColumn("version", F.lit(1)), path, "source")
    return spark.read.schema("doc_id long, version int, source string").parquet(path).select("doc_id", "source", "version")


@query("SELECT doc_id, source, n_chars + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n_chars FROM documents UNION ALL SELECT doc_id + 1000000000, source, n_chars FROM documents WHERE doc_id % 3 = 1")
def snk_upsert(spark, sf_dir):
    """Rows of an index replaced by their ids and new ones added."""
    from sedimark.operators import chunks as C

    docs = I.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    new = docs.where("doc_id % 3 = 1").withColumn("doc_id", F.col("doc_id") + 1_000_000_000)
    return C.upsert(docs, docs.where("doc_id % 3 = 0").withColumn("n_chars", F.col("n_chars") + 1).unionByName(new), "doc_id")


@query("SELECT 'e' || event_id AS event_id, event_id % 4 AS writer FROM events")
def snk_concurrent(spark, sf_dir):
    """Four writers append to one log at once, each its own events and some of every other's; each id is there once."""
    from threading import Thread

    path, failed = shared_path(spark, "log"), []
    e = I.table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("ordinal"), F.concat(F.lit("e"), "event_id").alias("event_id"), T.iso_seconds(F.col("ts").cast("timestamp")).alias("timestamp_utc"), F.lit("created").alias("event_type"), F.concat(F.lit("w"), F.col("event_id") % 4).alias("entry_id"), F.lit(1).alias("schema_version"), F.lit("{}").alias("payload"))
    mine = F.col("ordinal") % 4

    def write(n: int) -> None:
        try:
            sinks.append_events(spark, path, rows.where((mine == n) | (F.col("ordinal") % 10 == 0)))
        except Exception as e:
            failed.append(e)

    writers = [Thread(target=write, args=(n,)) for n in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    if failed:
        raise failed[0]
    return files.event_log(spark, path).select("event_id", F.substring("entry_id", 2, 1).cast("long").alias("writer"))


@query("""WITH b AS (SELECT doc_id, source, n_chars + 1 AS n_chars FROM documents WHERE doc_id % 97 = 0)
SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 97 <> 0 UNION ALL SELECT * FROM b UNION ALL SELECT doc_id + 1000000000, source, n_chars FROM documents WHERE doc_id % 97 = 1""")
def snk_upsert_stored(spark, sf_dir):
    """Rows put into a stored table by their ids, some twice in one batch, with only their buckets written anew."""
    path = shared_path(spark, "table")
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    stores.upsert_stored(docs, path, "doc_id")
    old = docs.where("doc_id % 97 = 0")
    new = docs.where("doc_id % 97 = 1").withColumn("doc_id", F.col("doc_id") + 1_000_000_000)
    stores.upsert_stored(old.unionByName(old.withColumn("n_chars", F.col("n_chars") + 1)).unionByName(new), path, "doc_id", "n_chars")
    return stores.stored(spark, path, "doc_id long, source string, n_chars long, bucket int").drop("bucket")


@query("SELECT page_id, length(html) AS n_chars, sha256(html) AS html_sha256 FROM pages WHERE html <> ''")
def snk_documents(spark, sf_dir):
    """Pages written as one file a document, twice, and read back."""
    path = shared_path(spark, "documents")
    pages = I.table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), "page_id").alias("slug"), F.col("html").alias("content"))
    stores.write_documents(pages.withColumn("content", F.lit("draft")), path)
    stores.write_documents(pages, path)
    back = stores.documents(spark, path)
    return back.select(F.substring("slug", 6, 30).cast("long").alias("page_id"), F.length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("html_sha256"))


def _arrivals(spark, rows, order, parts: int = 3):
    """A folder to which ``rows`` come as files in about equal ``parts``, those first in ``order`` (a number) first."""
    path, rows = shared_path(spark, "in"), written(rows.withColumn("at", order.cast("double")), "arrivals")
    cuts = rows.approxQuantile("at", [n / parts for n in range(1, parts)], 0.01)
    for low, high in zip([float("-inf"), *cuts], [*cuts, float("inf")], strict=True):
        rows.where((F.col("at") > low) & (F.col("at") <= high)).drop("at").write.mode("append").json(path)
        yield path


@query("SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations WHERE text IS NOT NULL")
def stream_ndjson(spark, sf_dir):
    """Conversations as lines of growing files, read by byte ranges in two batches."""
    path, out, checkpoint = (shared_path(spark, x) for x in ("in", "lines", "checkpoint"))
    c = I.table(spark, sf_dir, "conversations")
    for half in (0, 1):
        c.where(F.pmod("conv_id", F.lit(2)) == half).write.mode("append").json(path)
        state.run_to_end(ndjson.ndjson_lines(spark, path, 65_536), out, checkpoint)
    lines = state.batches(spark, out, "file string, place long, line string")
    rows = lines.select(F.from_json("line", "conv_id long, turn long, role string, text string").alias("r")).select("r.*")
    return rows.where("text is not null").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


def _event_files(spark, sf_dir, rows):
    path = shared_path(spark, "in")
    rows.repartition(4).write.json(path)
    return path


@query(f"WITH {I.GOLDEN} SELECT entry_id, created_event, n_reviews, deprecated FROM state")
def stream_ingest_fold(spark, sf_dir):
    """Golden events as files, streamed into a log, again streamed in, and folded."""
    g = I.golden_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("string"))
    schema = "entry_id long, event_id long, event_type string, ts timestamp_ntz, valid_created boolean, level string"
    path, log = _event_files(spark, sf_dir, g), shared_path(spark, "log")
    for _ in range(2):
        q = S.ingest(S.read_lines(spark, path, schema, numbered=True), log, shared_path(spark, "checkpoint"))
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return E.fold(spark.read.parquet(log)).select("entry_id", "created_event", F.size("review_chain").cast("long").alias("n_reviews"), "deprecated")


@query("""WITH k AS (SELECT *, CASE event_type WHEN 'signup' THEN 'loading' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS to_stage FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events))
SELECT user_id, coalesce(arg_max(to_stage, n) FILTER (WHERE to_stage IS NOT NULL), 'idle') AS stage, count(to_stage) AS n_events, count(*) FILTER (WHERE event_type = 'error') AS n_errors FROM k GROUP BY 1""")
def stream_job_states(spark, sf_dir):
    """Each job's stage after all its events have come as a stream of one file a batch."""
    names = F.create_map(*(F.lit(x) for pair in {"signup": "model-loading", "view": "work-progress", "purchase": "work-complete", "error": "work-failed"}.items() for x in pair))
    e = I.table(spark, sf_dir, "events")
    # microseconds that the id adds keep events of one second in order
    rows = e.select(F.col("user_id").cast("string").alias("job"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.coalesce(F.try_element_at(names, F.col("event_type")), F.col("event_type")).alias("type"), F.col("event_id").alias("current"), F.lit(None).cast("long").alias("total"))
    out, checkpoint = shared_path(spark, "states"), shared_path(spark, "checkpoint")

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    for path in _arrivals(spark, rows, F.unix_micros(F.col("ts").cast("timestamp"))):
        q = S.job_states(S.read_lines(spark, path, S.STAGE)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    last = spark.read.parquet(out).groupBy("job").agg(F.max_by(F.struct("stage", "n_events", "n_errors"), "batch").alias("s"))
    return last.select(F.col("job").cast("long").alias("user_id"), "s.*")


@query(f"WITH {I.GOLDEN} SELECT entry_id, created_event, n_reviews, deprecated, CASE coalesce(best, 0) WHEN 0 THEN 'synthetic' WHEN 1 THEN 'expert' WHEN 2 THEN 'phd' WHEN 3 THEN 'masters' WHEN 4 THEN 'bachelors' ELSE 'other' END AS level FROM state")
def stream_fold(spark, sf_dir):
    """Golden events that arrive in an order of their own, in three parts and a restart before each; the fold as it stands after the last."""
    g = I.golden_events(spark, sf_dir)
    schema = "entry_id long, event_id long, event_type string, ts timestamp_ntz, valid_created boolean, level string"
    out, checkpoint = shared_path(spark, "fold"), shared_path(spark, "checkpoint")
    for path in _arrivals(spark, g, F.xxhash64("event_id")):
        state.run_to_end(state.folded(S.read_lines(spark, path, schema)), out, checkpoint)
    last = state.batches(spark, out, state.FOLDED).groupBy("entry_id").agg(F.max_by(F.struct("created_event", "n_reviews", "deprecated", "level"), "batch").alias("s"))
    return last.select("entry_id", "s.*")


@query("""WITH k AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'model-loading' WHEN 'view' THEN 'work-progress' WHEN 'purchase' THEN 'work-complete' ELSE 'work-failed' END AS type FROM events WHERE event_type <> 'click'),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM k)
SELECT user_id, seq, type, CASE type WHEN 'model-loading' THEN 'loading' WHEN 'work-progress' THEN 'running' WHEN 'work-complete' THEN 'completed' ELSE 'failed' END AS stage,
  count(*) FILTER (WHERE type = 'work-failed') OVER (PARTITION BY user_id ORDER BY seq) AS n_errors,
  CASE WHEN type IN ('work-complete', 'work-failed') THEN seq END AS told FROM n""")
def stream_timelines(spark, sf_dir):
    """Each job's events in their order with the stage after each, and how many its closing rows tell, over three arrivals."""
    names = F.create_map(*(F.lit(x) for pair in {"signup": "model-loading", "view": "work-progress", "purchase": "work-complete", "error": "work-failed"}.items() for x in pair))
    e = I.table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("job"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.coalesce(F.try_element_at(names, F.col("event_type")), F.col("event_type")).alias("type"), F.lit(None).cast("long").alias("current"), F.lit(None).cast("long").alias("total"), F.col("event_id").alias("nth"))
    out, checkpoint = shared_path(spark, "timelines"), shared_path(spark, "checkpoint")
    for path in _arrivals(spark, rows, F.unix_micros(F.col("ts").cast("timestamp"))):
        state.run_to_end(state.timelines(S.read_lines(spark, path, S.STAGE + ", nth long")), out, checkpoint)
    told = state.batches(spark, out, "job string, seq long, type string, stage string, n_errors long, timeline array<string>")
    return told.select(F.col("job").cast("long").alias("user_id"), "seq", "type", "stage", "n_errors", F.when(F.col("timeline").isNotNull(), F.size("timeline")).cast("long").alias("told"))


@query(f"""WITH {I.PARAGRAPHS} SELECT doc_id, count(*) FILTER (WHERE content <> '') AS kept FROM paragraphs GROUP BY 1""")
def stream_process(spark, sf_dir):
    """Documents streamed through a step that counts their lines, with what the run tells of itself."""
    path, out = shared_path(spark, "in"), shared_path(spark, "told")
    I.table(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("s"), F.col("doc_id") % 3).alias("slug"), F.col("doc_id").cast("string").alias("element_id"), "text").write.json(path)
    rows = S.read_lines(spark, path, "slug string, element_id string, text string")

    def work(batch):
        return batch.select("slug", "element_id", F.size(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("kept"), F.lit(None).cast("string").alias("skipped"))

    q = S.process(rows, work, out, shared_path(spark, "checkpoint"))
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    told = written(spark.read.parquet(out), "told")
    return told.where("type = 'element'").select(F.col("element_id").cast("long").alias("doc_id"), "kept")
