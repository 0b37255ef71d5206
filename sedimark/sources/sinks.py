"""Results as files and tables. A write is one Spark job, so readers see all of it or none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.operators.events import first_of_each
from sedimark.sources import files, stores


def append_events(spark: SparkSession, path: str, batch: DataFrame) -> DataFrame:
    """Append the events of ``batch`` (with ``ordinal``) whose ids the log lacks; of equal ids in the batch the first counts. Returns the rows whose payload isn't JSON, which don't go in.

    Writers may append at the same time; see :func:`stores.append_committed`.
    """
    columns = ("event_id", "timestamp_utc", "event_type", "entry_id", "schema_version")
    rows = batch.withColumn("parsed", F.try_parse_json("payload"))
    good = rows.where(F.col("parsed").isNotNull() | F.col("payload").isNull())
    line = F.to_json(F.struct(*columns, F.col("parsed").alias("payload")), {"ignoreNullFields": "false"})

    def fresh() -> DataFrame:
        return first_of_each(good).join(files.event_ids(spark, path), "event_id", "left_anti")

    stores.append_committed(spark, path, fresh, lambda rows, to: rows.select(line.alias("value")).write.text(to))
    return rows.where(F.col("parsed").isNull() & F.col("payload").isNotNull()).select(*batch.columns)


def write_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines in which nulls are written out."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def replace_sources(batch: DataFrame, path: str, key: str = "source_file") -> None:
    """Replace the partitions of the batch's sources in the table at ``path``, and no others."""
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def ensure_table(spark: SparkSession, name: str, schema: str, path: str, key: str = "source_file", anew: bool = False) -> None:
    """Create the table if it is missing; ``anew``: drop what is there first."""
    if anew:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet PARTITIONED BY ({key}) LOCATION '{path}'")


def write_report(report: DataFrame, path: str, stamp: str, strategy: str = "unspecified") -> str:
    """A run's one-row report as JSON under a name of its time and strategy."""
    out = f"{path}/{stamp}-{strategy}"
    report.coalesce(1).write.option("ignoreNullFields", "false").json(out)
    return out


def schema_flags(table: DataFrame) -> DataFrame:
    """(name, type, searchable, filterable, retrievable) of each column, from its metadata."""
    rows = [(f.name, f.dataType.simpleString(), *(bool(f.metadata.get(x, x == "retrievable")) for x in ("searchable", "filterable", "retrievable"))) for f in table.schema]
    return table.sparkSession.createDataFrame(rows, "name string, type string, searchable boolean, filterable boolean, retrievable boolean")


def without_document(table: DataFrame, slug: str) -> DataFrame:
    """What is left when a document goes; slugs that could leave their folder are refused."""
    if not slug or "/" in slug or "\\" in slug or slug.startswith("."):
        raise ValueError(f"not a slug: {slug!r}")
    return table.where(F.col("slug") != slug)
