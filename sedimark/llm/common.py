"""Small pieces that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's own setting by which a finished command lets go of the shuffle files that it made.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset a local session (tests) gets a folder of its own, and a cluster an error, since its machines share no temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="sedimark-")
        shared_dir.own = base
    return f"{base}/sedimark"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes inside give their shuffle files back as soon as they are done: what is read later is the written table."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What runs inside hands at most ``rows`` rows at a time to Python, so that neither side holds much of wide rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage (a lost executor costs only a re-read) and makes sure that
    an expensive or order-sensitive plan runs once although it is used twice.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(run: Callable) -> Callable:
    """``run`` (batches to batches) that gives its memory back at its end: workers are used again by later stages, and what allocators keep for themselves would add up over these."""

    @functools.wraps(run)
    def to_the_end(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim:
                trim(0)

    return to_the_end


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def learns(column: str, modulus: int, held_out_rest: int):
    """Rows from which labels may be learnt: crc32 of the id as text, modulo ``modulus``, is not ``held_out_rest``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus != held_out_rest


def bucketed(df: DataFrame, name: str, key: str) -> str:
    """Write ``df`` as a managed table bucketed by ``key``, whose name is returned: later joins on it shuffle the other side alone. ``DROP TABLE`` removes its files."""
    spark, own = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.bucketBy(shuffle_partitions(spark), key).sortBy(key).saveAsTable(own)
    return own
