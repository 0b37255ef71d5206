"""Files as DataFrames: event logs, layout JSON, chunk lines, text folders, sidecars and catalogues.

Every scan reads through Spark's own readers, so a path may be in any store that
Spark knows. A path without files gives no row.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sedimark.functions import text as T
from sedimark.functions import validation as V
from sedimark.functions.text import strip
from sedimark.operators.chunks import element_type, without_noise

EVENT = "event_id string, timestamp_utc string, event_type string, entry_id string, schema_version string, payload string"
CHUNK = "chunk_id string, title string, section_heading string, chunk string, source_file string"
_REGION = "boundingRegions:array<struct<pageNumber:int,polygon:array<double>>>"
PARAGRAPH = f"struct<role:string,content:string,{_REGION}>"
TABLE = f"struct<rowCount:int,columnCount:int,cells:array<struct<rowIndex:int,columnIndex:int,content:string>>,{_REGION}>"
FIGURE = f"struct<caption:struct<content:string>,{_REGION}>"
BODY = f"paragraphs array<{PARAGRAPH}>, tables array<{TABLE}>, figures array<{FIGURE}>"
LAYOUT = f"{BODY}, analyzeResult struct<paragraphs:array<{PARAGRAPH}>,tables:array<{TABLE}>,figures:array<{FIGURE}>>"
BLOCK = "struct<type:string,bbox:array<string>,level:int,lines:array<struct<bbox:array<string>,spans:array<struct<content:string,html:string>>>>>"
MIDDLE = f"pdf_info array<struct<page_size:array<double>,para_blocks:array<{BLOCK}>,discarded_blocks:array<{BLOCK}>>>"

#: Fixed value: the size of a page that doesn't state its own.
PAGE_SIZE = (612.0, 792.0)


def or_empty(spark: SparkSession, read: Callable[[], DataFrame], schema, more: str | None = None) -> DataFrame | None:
    """What ``read`` opens; a path that isn't there gives a table of ``schema`` (and the columns ``more``) without rows, or None without a schema."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
    if schema is None:
        return None
    none = spark.createDataFrame([], schema)
    for c in StructType.fromDDL(more).fields if more else []:
        none = none.withColumn(c.name, F.lit(None).cast(c.dataType))
    return none


#: Folder of a log's commits: a file for each append, numbered, that names the folder of its rows.
COMMITS = "_commits"


def commits(spark: SparkSession, path: str) -> list[str]:
    """The folders of a log's appends in the order of their commits."""
    marks = or_empty(spark, lambda: spark.read.text(f"{path}/{COMMITS}/[0-9]*", wholetext=True), None)
    if marks is None:
        return []
    return [f"{path}/{r.value}" for r in sorted(marks.select("value", F.col("_metadata.file_name").alias("n")).collect(), key=lambda r: r.n)]  # one row an append


def slug_of(path: Column) -> Column:
    """The folder above a file's own; the folders of single appends don't count."""
    return F.regexp_extract(F.regexp_replace(path, "/append-[0-9a-f-]+/", "/"), r"([^/]+)/[^/]+/[^/]+$", 1)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, place) of each line that isn't blank; place orders the lines of a file."""
    whole = commits(spark, path) if isinstance(path, str) and "*" not in path else []
    lines = or_empty(spark, lambda: spark.read.text(whole or path), None)
    if lines is None:
        return spark.createDataFrame([], "value string, file string, place struct<start:bigint,n:bigint>")
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    return lines.select("value", F.col("_metadata.file_path").alias("file"), place.alias("place")).where(F.trim("value") != "")


def _parsed(lines: DataFrame) -> DataFrame:
    e = lines.select("value", "file", "place", F.from_json("value", EVENT).alias("e")).select("value", "file", "place", "e.*")
    e = e.withColumn("schema_version", F.col("schema_version").try_cast("int"))
    return e.withColumn("valid", V.event())


def event_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Valid events of JSONL logs, with the log's slug and an ``ordinal`` that orders them as their lines stand; a missing log is an empty one."""
    events = _parsed(_lines(spark, path)).where("valid")
    return events.select(slug_of(F.col("file")).alias("slug"), F.struct("file", "place").alias("ordinal"), "event_id", "timestamp_utc", "event_type", "entry_id", "schema_version", F.coalesce("payload", F.lit("{}")).alias("payload"))


def quarantine(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, value) of the lines that aren't valid events."""
    return _parsed(_lines(spark, path)).where("not valid").select("file", "value")


def event_ids(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Ids in a log, of invalid events too; lines without one are left out."""
    return _lines(spark, path).select(F.get_json_object("value", "$.event_id").alias("event_id")).where("event_id is not null").distinct()


def chunk_lines(spark: SparkSession, path: str, with_vector: bool = False) -> DataFrame:
    return spark.read.schema(CHUNK + (", vector array<float>" if with_vector else "")).json(path)


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of whole files, named by their stems."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("id"), F.col("value").alias("text"))


def latest_layouts(spark: SparkSession, path: str) -> DataFrame:
    """The last file by name of each slug under ``path``/<slug>/analyze; a body may stand at the top or under analyzeResult."""
    raw = spark.read.schema(LAYOUT).json(f"{path}/*/analyze/*.json", multiLine=True)
    named = raw.select("*", slug_of(F.col("_metadata.file_path")).alias("slug"), F.col("_metadata.file_name").alias("file_name"))
    last = named.withColumn("last", F.max("file_name").over(Window.partitionBy("slug"))).where("file_name = last")
    parts = (F.coalesce(p, f"analyzeResult.{p}").alias(p) for p in ("paragraphs", "tables", "figures"))
    return last.select("slug", *parts)


@F.pandas_udf(StructType().add("stub", "string").add("full", "string"))
def table_text(rows: pd.Series, cols: pd.Series, cells: pd.Series) -> pd.DataFrame:
    """A table's cells row by row: at most 3 rows of 5 cells, and all of it. Of cells in one place the last counts."""
    out = []
    for r, c, given in zip(rows.fillna(0).astype(int), cols.fillna(0).astype(int), cells, strict=True):
        grid = {(int(x["rowIndex"] or 0), int(x["columnIndex"] or 0)): (x["content"] or "").strip() for x in (() if given is None else given)}
        full = [[grid.get((i, j), "") for j in range(c)] for i in range(r)]
        stub = [" | ".join(row[:5] + ["..."] * (c > 5)) for row in full[:3]] + ["..."] * (r > 3)
        out.append(("\n".join(stub), "\n".join(map(" | ".join, full))))
    return pd.DataFrame(out, columns=["stub", "full"])


def _at(kind: str, rank: int, layouts: DataFrame) -> DataFrame:
    """Entries of one kind with page and height of their first region; those without are left out."""
    rows = layouts.select("slug", F.posexplode(kind).alias("pos", "r"))
    region = F.get("r.boundingRegions", F.lit(0))
    rows = rows.select("slug", F.lit(rank).alias("kind_rank"), "pos", region["pageNumber"].alias("page_number"), F.get(region["polygon"], F.lit(1)).alias("top_y"), "r.*")
    return rows.where("page_number is not null and top_y is not null")


def elements(layouts: DataFrame) -> DataFrame:
    """Paragraphs, tables and captioned figures; order by (slug, page_number, top_y, kind_rank, pos) to read them in sequence."""
    none = F.lit(None).cast("string")
    no_dims = F.lit(None).cast("struct<rows:int,cols:int>")
    key = ["slug", "page_number", "top_y", "kind_rank", "pos"]
    p = without_noise(_at("paragraphs", 0, layouts)).select(*key, element_type(F.col("role")).alias("element_type"), strip(F.col("content")).alias("content"), none.alias("caption"), no_dims.alias("table_dims"), none.alias("table_full_content")).where("content <> ''")
    p = p.withColumn("named", F.col("content"))
    t = _at("tables", 1, layouts).withColumn("t", table_text("rowCount", "columnCount", "cells")).where(strip(F.col("t.stub")) != "")
    dims = F.struct(F.coalesce("rowCount", F.lit(0)).alias("rows"), F.coalesce("columnCount", F.lit(0)).alias("cols")).cast("struct<rows:int,cols:int>")
    t = t.select(*key, F.lit("table").alias("element_type"), F.col("t.stub").alias("content"), none.alias("caption"), dims.alias("table_dims"), F.col("t.full").alias("table_full_content"), F.col("t.stub").alias("named"))
    f = _at("figures", 2, layouts).withColumn("caption", strip(F.col("caption.content"))).where("caption <> ''")
    f = f.select(*key, F.lit("figure").alias("element_type"), F.lit("").alias("content"), "caption", no_dims.alias("table_dims"), none.alias("table_full_content"), F.col("caption").alias("named"))
    rows = p.unionByName(t).unionByName(f)
    return rows.withColumn("element_id", T.element_id(F.col("page_number"), F.col("named"))).drop("named")


def in_sequence(rows: DataFrame) -> DataFrame:
    """``elements`` with ``place``, from 0, in the order in which their document is read."""
    order = Window.partitionBy("slug").orderBy("page_number", "top_y", "kind_rank", "pos")
    return rows.withColumn("place", F.row_number().over(order) - 1)


def element_counts(layouts: DataFrame) -> DataFrame:
    """(slug, n_elements), those without elements at 0."""
    n = elements(layouts).groupBy("slug").agg(F.count("*").alias("n"))
    return layouts.select("slug").distinct().join(n, "slug", "left").select("slug", F.coalesce("n", F.lit(0)).alias("n_elements"))


def middle_blocks(spark: SparkSession, path: str, pages: list[int] | None = None) -> DataFrame:
    """Blocks of a layout model's JSON; ``pages``: the document's pages that the model was given, in any order. Blocks without four numbers as their box are left out."""
    raw = spark.read.schema(MIDDLE).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode("pdf_info").alias("idx", "p"))
    page = F.get(F.array(*(F.lit(x) for x in sorted(pages))), F.col("idx")) if pages else F.col("idx") + 1
    nothing = F.array().cast(f"array<{BLOCK}>")
    both = F.concat(F.coalesce("p.para_blocks", nothing), F.coalesce("p.discarded_blocks", nothing))
    width, height = (F.coalesce(F.get("p.page_size", F.lit(i)), F.lit(PAGE_SIZE[i])) for i in (0, 1))
    rows = raw.select("file", page.alias("page"), width.alias("width"), height.alias("height"), F.posexplode(both).alias("pos", "b"))
    corners = [F.get("b.bbox", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    rows = rows.select("file", "page", "width", "height", "pos", F.col("b.type").alias("block_type"), F.col("b.level").alias("level"), F.size("b.bbox").alias("n"), *corners, F.col("b.lines").alias("lines"))
    return rows.where("n = 4 and page is not null and x0 is not null and y0 is not null and x1 is not null and y1 is not null").drop("n")


def detector_boxes(found: DataFrame, kinds: dict[str, str], first: int = 1, last: int | None = None) -> DataFrame:
    """Detections (page, idx, class, ...) as boxes: a class that has no kind is a paragraph; pages from first to last, both included."""
    known = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    kind = F.coalesce(F.try_element_at(known, F.col("class")), F.lit("paragraph"))
    inside = F.col("page") >= first if last is None else F.col("page").between(first, last)
    return found.where(inside).withColumn("kind", kind).withColumn("reading_order", F.col("idx")).drop("class", "idx")


def migrated(boxes: DataFrame) -> DataFrame:
    """Boxes of an older form, whose 'abandon' is 'auxiliary' now."""
    return boxes.withColumn("kind", F.when(F.col("kind") == "abandon", "auxiliary").otherwise(F.col("kind")))


def sidecars(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The JSON files ``name`` of the documents under ``path``, by slug, as one struct ``sidecar``; no row for documents without one, and a null struct for what isn't JSON."""
    rows = or_empty(spark, lambda: spark.read.text(f"{path}/*/{name}", wholetext=True).select("value", F.col("_metadata.file_path").alias("file")), "value string, file string")
    return rows.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("slug"), F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", schema)).alias("sidecar"))


def with_sidecar(documents: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """``documents`` (slug, ...) with their sidecar in ``column``, null where there is none."""
    return documents.join(found.select("slug", F.col("sidecar").alias(column)), "slug", "left")


def pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(slug, path, length) of the PDF files under ``path``, told by name and by first bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    good = F.lower(name).endswith(".pdf") & (F.substring("content", 1, 4) == F.lit(b"%PDF"))
    return files.where(good).select(T.slug_ascii(F.regexp_replace(name, r"(?i)\.pdf$", "")).alias("slug"), "path", "length")


def catalogue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents that have a meta.json, by slug."""
    rows = spark.read.schema(schema).json(f"{path}/*/meta.json", multiLine=True)
    return rows.withColumn("slug", F.regexp_extract("_metadata.file_path", r"([^/]+)/meta\.json$", 1))


def output_keys(path: Column) -> tuple[Column, Column]:
    """(slug, strategy) of a file's results: the folder above its own, and its stem from the first dash on."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    dashed = F.regexp_extract(stem, "^[^-]*-(.+)$", 1)
    return slug_of(path), F.when(dashed == "", "unknown").otherwise(dashed)


#: What a loader of elements has to give.
ELEMENT = {"slug": "string", "page_number": "int", "element_id": "string", "element_type": "string", "content": "string"}


def checked_elements(rows: DataFrame, schema: dict[str, str] | None = None) -> DataFrame:
    """``rows`` of any loader, if it has the columns of an element."""
    have, wanted = dict(rows.dtypes), schema or ELEMENT
    wrong = sorted(c for c, t in wanted.items() if have.get(c) != t)
    if wrong:
        raise ValueError(f"not elements: {', '.join(f'{c} is {have.get(c)}, not {wanted[c]}' for c in wrong)}")
    return rows


def images(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """(name, length, content) of the images in a folder, by name; or of one, whose name may not leave the folder."""
    if name is not None and (not name or "/" in name or "\\" in name or name.startswith(".")):
        raise ValueError(f"not a file name: {name!r}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", name or "*.{png,jpg,jpeg}").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content").orderBy("name")


def total_blocks(spark: SparkSession, path: str) -> int:
    """Blocks in a layout model's JSON, those without a box too."""
    raw = spark.read.schema(MIDDLE).json(path, multiLine=True).select(F.explode("pdf_info").alias("p"))
    size = lambda c: F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0))
    return raw.agg(F.coalesce(F.sum(size("p.para_blocks") + size("p.discarded_blocks")), F.lit(0)).alias("n")).first().n
