"""Tables and documents that are changed in place: appends by many writers, upserts of a few buckets, one file a document."""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from sedimark.operators.scratch import written
from sedimark.sources.files import COMMITS, commits, or_empty

#: Times that a writer tries to become the next one of a log.
TRIES = 100


def claim(spark: SparkSession, marker: str, content: str) -> bool:
    """Whether this writer, and no other, has made ``marker``; it shows up with its whole content or not at all."""
    jvm = spark._jvm
    path, temporary = (jvm.org.apache.hadoop.fs.Path(x) for x in (marker, f"{posixpath.dirname(marker)}/.{uuid.uuid4().hex}"))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(temporary, True)
    out.write(bytearray(content.encode()))
    out.close()
    try:
        if fs.getScheme() != "file":
            return bool(fs.rename(temporary, path))  # refused where the marker is there
        own, there = (jvm.java.nio.file.Path.of(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for p in (path, temporary))
        try:
            jvm.java.nio.file.Files.createLink(own, there)  # a local rename would replace it
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True
    finally:
        fs.delete(temporary, False)


def append_committed(spark: SparkSession, path: str, fresh: Callable[[], DataFrame], write: Callable[[DataFrame, str], None]) -> int:
    """Append the rows of ``fresh()`` to the log at ``path`` and return the number of the commit, or -1 if there are none.

    Any number of writers may append at once. A writer looks up the last commit,
    makes its rows (``fresh`` leaves out what the log has by then), ``write``s them to a
    folder that nobody reads, and then claims the next number by a marker that names
    this folder. If another writer has that number, it begins again. Readers see
    the folders that have a marker: all of an append or nothing of it.
    """
    for _ in range(TRIES):
        number = len(commits(spark, path))
        rows = fresh()
        if rows.isEmpty():
            return -1
        folder = f"append-{number:012}-{uuid.uuid4().hex}"  # in the order of commits
        write(rows, f"{path}/{folder}")
        if claim(spark, f"{path}/{COMMITS}/{number:012}", folder):
            return number
    raise RuntimeError(f"no commit after {TRIES} tries: {path}")


BUCKETS = 64


def last_of_each(batch: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Of the rows of one key the last by ``order``; without an order the last by their columns."""
    last = [F.desc(order)] if order else [F.desc(c) for c in batch.columns if c != key]
    return batch.withColumn("nth from last", F.row_number().over(Window.partitionBy(key).orderBy(*last))).where("`nth from last` = 1").drop("nth from last")


def upsert_stored(batch: DataFrame, path: str, key: str, order: str | None = None, buckets: int = BUCKETS) -> int:
    """Put ``batch`` into the Parquet table at ``path`` by ``key``; returns how many buckets were written.

    The table is dealt into buckets by the hash of the key. A bucket that holds a key
    of the batch is read, merged and written anew; files of all others stay as they
    are. Of rows of the batch with one key the last counts; a null key is a key.
    """
    spark = batch.sparkSession
    new = written(last_of_each(batch, key, order).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "upsert")
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # ``buckets`` at most
    there = or_empty(spark, lambda: spark.read.schema(new.schema).parquet(path), new.schema).where(F.col("bucket").isin(touched))
    kept = there.alias("t").join(new.select(key).alias("n"), F.col(f"t.`{key}`").eqNullSafe(F.col(f"n.`{key}`")), "left_anti")
    merged = written(kept.select(*new.columns).unionByName(new), "merged")
    # a bucket in one task, so that it becomes one file
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return len(touched)


def _removed(spark: SparkSession, paths: list[str]) -> int:
    """How many of ``paths`` were there; none is afterwards."""
    n = 0
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def delete_stored(keys: DataFrame, path: str, schema: str, key: str, buckets: int = BUCKETS) -> int:
    """Delete the rows of ``keys`` from the table that :func:`upsert_stored` keeps at ``path`` (of ``schema``, with its bucket); returns how many went. Buckets without such a row stay as they are."""
    spark = keys.sparkSession
    named = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    gone = written(keys.select(key).distinct().select(key, named), "gone")
    there = stored(spark, path, schema)
    hit = there.alias("t").join(gone.alias("n"), (F.col("t.bucket") == F.col("n.bucket")) & F.col(f"t.`{key}`").eqNullSafe(F.col(f"n.`{key}`")), "left_semi")
    n = {r.bucket: r.n for r in hit.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # ``buckets`` at most
    if not n:
        return 0
    touched = there.where(F.col("bucket").isin(list(n)))
    left = written(touched.alias("t").join(gone.alias("n"), F.col(f"t.`{key}`").eqNullSafe(F.col(f"n.`{key}`")), "left_anti"), "left")
    left.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    empty = set(n) - {r.bucket for r in left.select("bucket").distinct().collect()}  # no row is written over these
    _removed(spark, [f"{path}/bucket={b}" for b in empty])
    return sum(n.values())


def delete_document(spark: SparkSession, slug: str, folders: list[str], tables: list[str] = ()) -> int:
    """Delete a document with all that is kept of it: its folder in each of ``folders`` and its partition (slug=...) in each of ``tables``. Returns how many of these there were; slugs that could leave their folder are refused."""
    if not slug or slug.startswith(".") or not set(slug).isdisjoint("/\\*?[]{}%=:"):
        raise ValueError(f"not a slug: {slug!r}")
    return _removed(spark, [*(f"{f}/{slug}" for f in folders), *(f"{t}/slug={slug}" for t in tables)])


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return or_empty(spark, lambda: spark.read.schema(schema).parquet(path), schema)


# --- one file a document

#: Documents that a folder of a task holds at most until its job ends; the driver holds the names of one such folder.
FOLDER = 50_000
#: Documents that a task reads at most, on average.
FILES = 1000
#: Bytes of documents beyond which no further one goes to Spark in the same batch.
BATCH_BYTES = 4_000_000


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The store of ``path``, and where it is there."""
    store, root = fs.FileSystem.from_uri(path)
    return store, root.rstrip("/")


@dataclass
class _Written(WriterCommitMessage):
    folders: list[str]


class DocumentFiles(DataSource):
    """The sink ``document_files``: rows (slug, content) as ``path``/slug/``file``.

    Tasks write beside the documents, to folders of the job; when all are done each
    document is moved to its place in one step. A job that fails leaves the old
    documents as they were. The driver gets the names of folders, and lists one
    at a time as it moves, so it never holds the names of all documents.
    """

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "slug string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _DocumentWriter(self.options["path"], self.options.get("file", "html.html"), uuid.uuid4().hex)


class _DocumentWriter(DataSourceWriter):
    def __init__(self, path: str, file: str, job: str) -> None:
        self.path, self.file, self.job = path, file, job

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, root = _place(self.path)
        folders = []
        for n, row in enumerate(iterator):
            if not row.slug or "/" in row.slug or "\\" in row.slug or row.slug.startswith("."):
                raise ValueError(f"not a slug: {row.slug!r}")
            if n % FOLDER == 0:
                folders.append(f"{root}/.job-{self.job}/{uuid.uuid4().hex}")
                store.create_dir(folders[-1], recursive=True)
            with store.open_output_stream(f"{folders[-1]}/{row.slug}", compression=None) as out:
                out.write((row.content or "").encode())
        return _Written(folders)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _place(self.path)
        for folder in (f for m in messages if m for f in m.folders):
            for x in store.get_file_info(fs.FileSelector(folder)):
                store.create_dir(f"{root}/{x.base_name}", recursive=True)
                store.move(x.path, f"{root}/{x.base_name}/{self.file}")
        self._clear(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_place(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        own = f"{root}/.job-{self.job}"
        if store.get_file_info(own).type != fs.FileType.NotFound:
            store.delete_dir(own)


def write_documents(rows: DataFrame, path: str, file: str = "html.html") -> None:
    """``rows`` (slug, content) as one file a document; of rows with one slug the last by content counts."""
    rows.sparkSession.dataSource.register(DocumentFiles)
    last_of_each(rows.select("slug", "content"), "slug").write.format("document_files").option("path", path).option("file", file).mode("append").save()


def _slugs(path: str) -> Iterator[str]:
    """Names in the folder at ``path``, one after another where it is local; other stores give all of them at once."""
    store, root = _place(path)
    if not isinstance(store, fs.LocalFileSystem):
        yield from (x.base_name for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)))
    elif os.path.isdir(root):
        with os.scandir(root) as there:
            yield from (x.name for x in there if x.name.encode(errors="ignore").decode() == x.name)  # else no slug has that name


def documents(spark: SparkSession, path: str, file: str = "html.html") -> DataFrame:
    """(slug, content) of the documents that have this file; a folder that isn't there has none, and files without a byte are passed over.

    One task lists the folder into a table, and tasks read ``FILES`` documents each at most, on average,
    so the driver holds no list of files. Stores that Arrow can't open are read by
    Spark's own reader, whose driver holds one.
    """
    try:
        _place(path)
    except (pa.ArrowException, OSError):
        rows = or_empty(spark, lambda: spark.read.format("binaryFile").load(f"{path}/*/{file}"), "path string, content binary")
        return rows.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("slug"), F.col("content").cast("string").alias("content"))

    def listed(batches):
        for _ in batches:  # one, of one row
            names = (x for x in _slugs(path) if not x.startswith(".job-"))
            while some := list(islice(names, FILES)):
                yield pa.RecordBatch.from_pydict({"slug": some})

    def read(batches):
        store, root = _place(path)
        slugs, contents, held = [], [], 0
        for batch in batches:
            for some in (batch.column(0)[n : n + FILES].to_pylist() for n in range(0, batch.num_rows, FILES)):
                for slug, x in zip(some, store.get_file_info([f"{root}/{s}/{file}" for s in some]), strict=True):
                    if x.type != fs.FileType.File or not x.size:
                        continue
                    if slugs and held + x.size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(slugs), pa.array(contents, pa.binary())], ["slug", "content"])
                        slugs, contents, held = [], [], 0
                    with store.open_input_stream(x.path, compression=None) as f:
                        slugs.append(slug)
                        contents.append(f.read())
                    held += x.size
        if slugs:
            yield pa.RecordBatch.from_arrays([pa.array(slugs), pa.array(contents, pa.binary())], ["slug", "content"])

    slugs = written(spark.range(0, 1, 1, 1).mapInArrow(listed, "slug string"), "slugs")
    n = slugs.count()
    dealt = slugs.repartition(max(1, -(-n // FILES), min(n, spark.sparkContext.defaultParallelism)), "slug")
    return dealt.mapInArrow(read, "slug string, content binary").select("slug", F.col("content").cast("string").alias("content"))


def overwrite_html(edits: DataFrame, path: str, touched_utc: str) -> DataFrame:
    """Write edited pages (slug, content) of documents that are there, and when they were touched to their metadata; returns the (slug) that aren't there.

    A document is there if it has a meta.json; its other fields stay as they are.
    """
    spark = edits.sparkSession
    meta = written(documents(spark, path, "meta.json"), "meta")
    known = written(edits.join(meta.select("slug"), "slug", "left_semi").select("slug", "content"), "edits")
    write_documents(known, path)
    fields = F.try_parse_json("content").cast("map<string,variant>")
    stamp = F.create_map(F.lit("last_touched_utc"), F.parse_json(F.to_json(F.array(F.lit(touched_utc)))).cast("array<variant>")[0])
    fresh = F.map_concat(F.map_filter(fields, lambda k, v: k != "last_touched_utc"), stamp)
    write_documents(meta.join(known.select("slug").distinct(), "slug", "left_semi").select("slug", F.to_json(fresh).alias("content")), path, "meta.json")
    return edits.join(meta.select("slug"), "slug", "left_anti").select("slug")
