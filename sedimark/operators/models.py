"""Models as plug-ins: embedders, completions with retries, detectors and parsers. A model is a function of plain values; Spark deals out its calls.

``register`` names a model once on the driver; nothing here opens a connection by
itself. The two embedders that come with the library need no model files.
"""

from __future__ import annotations

import os
import random
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


class ModelError(Exception):
    """A call that no retry will mend."""


class RateLimited(ModelError):
    """Too many calls: to be tried again."""


class ServerFailed(ModelError):
    """The provider failed: to be tried again."""


def translated(error: Exception) -> Exception:
    """A provider's error as one of ours, by its HTTP status: 401, 403 and 404 are set-up mistakes, 429 a limit, 500 and above a failure; others stay."""
    status = getattr(error, "status_code", None)
    if status in (401, 403, 404):
        return ModelError(str(error))
    if status == 429:
        return RateLimited(str(error))
    return ServerFailed(str(error)) if isinstance(status, int) and status >= 500 else error


def with_retry(call: Callable, attempts: int = 3, longest: float = 10.0, sleep: Callable[[float], None] = time.sleep, seed: int | None = None) -> Callable:
    """``call`` tried again after a limit or a failure of the provider, at most so often, waiting a random time that grows up to ``longest`` seconds."""
    rng = random.Random(seed)

    def run(*args, **kwargs):
        for attempt in range(attempts):
            try:
                return call(*args, **kwargs)
            except Exception as e:
                mine = translated(e)
                if attempt + 1 == attempts or not isinstance(mine, (RateLimited, ServerFailed)):
                    raise mine from e
                sleep(min(longest, rng.uniform(0, 2**attempt)))
        return None

    return run


@dataclass(frozen=True)
class Model:
    """``call`` makes a list of answers from a list of inputs; ``start`` makes it once a worker (to load weights), ``stop`` lets go of them."""

    name: str
    start: Callable[[], Callable[[list], list]]
    stop: Callable[[], None] | None = None


_MODELS: dict[str, Model] = {}


def register(model: Model) -> Model:
    _MODELS[model.name] = model
    return model


def model(name: str) -> Model:
    if name not in _MODELS:
        raise KeyError(f"no model is called {name!r}; there are {sorted(_MODELS)}")
    return _MODELS[name]


def chosen(settings: dict[str, str], key: str = "SEDIMARK_MODEL", default: str = "hashing") -> Model:
    """The model that the settings (such as the environment) name."""
    return model(settings.get(key) or default)


def ping(name: str, prompt: str = "ping") -> tuple[object, float]:
    """A model's answer to one prompt and the seconds that it took, loading not counted."""
    used = model(name)
    call = used.start()
    try:
        began = time.perf_counter()
        return call([prompt])[0], time.perf_counter() - began
    finally:
        if used.stop:
            used.stop()


def apply(rows: DataFrame, name: str, column: str, out: str, kind: str, batch: int = 256, attempts: int = 3) -> DataFrame:
    """``rows`` with a model's answer to ``column`` in ``out``. The model is started once a task and stopped at its end, whatever happens in between."""
    used = model(name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retry(used.start(), attempts)
        try:
            for pdf in batches:
                answers: list = []
                for at in range(0, len(pdf), batch):
                    answers += call(pdf[column].iloc[at : at + batch].tolist())
                yield pdf.assign(**{out: pd.Series(answers, index=pdf.index, dtype=object)})
        finally:
            if used.stop:
                used.stop()

    return rows.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{out}` {kind}"]))


def embedded(rows: DataFrame, name: str, column: str, store: str, out: str = "vector") -> DataFrame:
    """``rows`` with the vectors of ``column``, null for null texts. Each text is embedded once: the vectors (key, vector) are kept in the Parquet table ``store``, one for each model, and only texts that it lacks go to the model."""
    spark, key = rows.sparkSession, F.sha2(F.col(column), 256)
    path, schema = f"{store}/model={name}", "key string, vector array<double>"
    wanted = rows.where(F.col(column).isNotNull()).select(key.alias("key"), F.col(column).alias("text")).dropDuplicates(["key"])
    try:
        wanted = wanted.join(spark.read.schema(schema).parquet(path).select("key"), "key", "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
    apply(wanted, name, "text", "vector", "array<double>").select("key", "vector").write.mode("append").parquet(path)
    known = spark.read.schema(schema).parquet(path).select("key", F.col("vector").alias(out))
    return rows.withColumn("key of the text", key).join(known.withColumnRenamed("key", "key of the text"), "key of the text", "left").drop("key of the text")


def memory_mb() -> float | None:
    """What this process holds in memory, where the system tells it."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20
    except OSError:
        return None


def lifecycle(rows: DataFrame, name: str, column: str) -> DataFrame:
    """(partition, type, n, seconds, memory_mb, error): what a model's work is made of in each task, from loading to unloading. An error ends the work, not the task, so that it is told; ``reported`` raises it."""
    used = model(name)
    from pyspark import TaskContext

    def run(batches):
        part, began, events = TaskContext.get().partitionId(), time.perf_counter(), []

        def tell(kind, n=None, error=None):
            events.append((part, kind, n, time.perf_counter() - began, memory_mb(), error))

        tell("model-loading")
        call = used.start()
        tell("model-loaded")
        try:
            for pdf in batches:
                call(pdf[column].tolist())
                tell("work-progress", len(pdf))
            tell("work-complete")
        except Exception as e:
            tell("work-failed", error=f"{type(e).__name__}: {e}"[:500])
        tell("model-unloading")
        if used.stop:
            used.stop()
        tell("model-unloaded")
        yield pd.DataFrame(events, columns=["partition", "type", "n", "seconds", "memory_mb", "error"]).astype({"n": "Int64"})

    return rows.mapInPandas(run, "partition int, type string, n long, seconds double, memory_mb double, error string")


def reported(rows: DataFrame, name: str, column: str, out: str) -> DataFrame:
    """``lifecycle`` written to the new Parquet table ``out`` and opened again; if the work of a task failed, its error is raised once all is told."""
    lifecycle(rows, name, column).write.parquet(out)
    told = rows.sparkSession.read.parquet(out)
    failed = told.where("type = 'work-failed'").orderBy("partition").limit(1).collect()
    if failed:
        raise ModelError(failed[0].error)
    return told


# --- embedders


def letters(c: Column) -> Column:
    """A vector of how often each letter a to z stands in a text: an embedding that needs no model."""
    low = F.lower(c)
    return F.array(*((F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))).cast("double") for x in "abcdefghijklmnopqrstuvwxyz"))


def hashed(texts: list[str], dimensions: int = 64) -> list[list[float]]:
    """Words hashed to places with a sign, brought to length 1."""
    out = np.zeros((len(texts), dimensions))
    for i, text in enumerate(texts):
        for word in (text or "").lower().split():
            h = zlib.crc32(word.encode())
            out[i, h % dimensions] += 1 if h >> 16 & 1 else -1
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


register(Model("hashing", lambda: hashed))


@F.pandas_udf(ArrayType(DoubleType()))
def hashing_embedding(texts: pd.Series) -> pd.Series:
    return pd.Series(hashed(texts.tolist()))


#: Bytes that an approximate token holds, for a budget where no tokenizer is given.
BYTES_A_TOKEN = 4


def approximate_tokens(c: Column) -> Column:
    """About so many tokens as a common byte-pair vocabulary would give. An approximation; ``truncated`` takes a tokenizer."""
    return F.ceil(F.octet_length(c) / BYTES_A_TOKEN).cast("long")


class Vocabulary:
    """The encoding of a tokenizer file at ``path``."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.no_truncation()
        self.coder.no_padding()

    def encode(self, text: str) -> list[int]:
        return self.coder.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self.coder.decode(ids, skip_special_tokens=False)


def truncated(rows: DataFrame, column: str, encoding: Callable[[], object], most: int = 8191, least_bytes: int = 0) -> DataFrame:
    """``rows`` with ``column`` cut after so many tokens of ``encoding()`` (with encode and decode), made once a task. Where no token stands for less than ``least_bytes``, texts that are short by that aren't encoded."""

    def cut(text, coder):
        if text is None or len(text.encode()) <= most * least_bytes:
            return text
        ids = coder.encode(text)
        return text if len(ids) <= most else coder.decode(ids[:most])

    def run(batches):
        coder = encoding()
        for pdf in batches:
            yield pdf.assign(**{column: [cut(t, coder) for t in pdf[column]]})

    return rows.mapInPandas(run, rows.schema)
