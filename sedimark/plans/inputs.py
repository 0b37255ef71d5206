"""Inputs that the queries derive from the plain tables, as DataFrames and as the SQL of the same name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(spark, sf_dir) -> DataFrame:
    """Lines of documents with a role by place and length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    rows = docs.select("doc_id", F.size("lines").alias("n"), F.posexplode("lines").alias("idx", "content"))
    role = F.when(F.col("idx") == 0, "title").when((F.col("idx") == F.col("n") - 1) & (F.col("n") > 2), "pageFooter").when(F.length("content") < 25, "sectionHeading")
    return rows.select("doc_id", "idx", role.alias("role"), "content")


PARAGRAPHS = """l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, len(lines) AS n, unnest(lines) AS content, generate_subscripts(lines, 1) - 1 AS idx FROM l),
paragraphs AS (SELECT doc_id, idx, content, CASE WHEN idx = 0 THEN 'title' WHEN idx = n - 1 AND n > 2 THEN 'pageFooter' WHEN length(content) < 25 THEN 'sectionHeading' END AS role FROM m)"""


def golden_events(spark, sf_dir) -> DataFrame:
    """Events as a golden log: the user is the entry; a purchase is a 'created' of another task, which doesn't count."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "created").when(F.col("event_type") == "error", "deprecated").otherwise("reviewed")
    levels = F.array(*(F.lit(x) for x in ("other", "bachelors", "masters", "phd", "expert")))
    level = F.when(F.col("event_id") % 2 == 0, F.get(levels, (F.col("event_id") % 5).cast("int")))
    return e.select(F.col("user_id").alias("entry_id"), "event_id", kind.alias("event_type"), "ts", (F.col("event_type") == "signup").alias("valid_created"), level.alias("level"))


GOLDEN = """g AS (SELECT user_id AS entry_id, event_id, ts, event_type = 'signup' AS valid_created,
  CASE WHEN event_type IN ('signup', 'purchase') THEN 'created' WHEN event_type = 'error' THEN 'deprecated' ELSE 'reviewed' END AS event_type,
  CASE WHEN event_id % 2 = 0 THEN 5 - event_id % 5 END AS rank FROM events),
o AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS ord FROM g),
b AS (SELECT *, max(CASE WHEN event_type = 'created' AND valid_created THEN ord END) OVER (PARTITION BY entry_id) AS born,
  min(CASE WHEN event_type = 'created' AND valid_created THEN ord END) OVER (PARTITION BY entry_id) AS first_born FROM o),
state AS (SELECT entry_id, max(CASE WHEN ord = born THEN event_id END) AS created_event,
  count(*) FILTER (WHERE event_type IN ('reviewed', 'deprecated')) AS n_reviews, bool_or(event_type = 'deprecated') AS deprecated,
  min(rank) FILTER (WHERE event_type IN ('reviewed', 'deprecated')) AS best FROM b WHERE ord >= born GROUP BY entry_id)"""


def boxes(spark, sf_dir) -> DataFrame:
    """All line items as boxes: ten orders' keys a page, so that pages stay small and their number grows with the table."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.floor(F.col("l_orderkey") / 10) + 1).alias("page"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        ((F.col("l_partkey") * 37) % 400).cast("double").alias("x0"), ((F.col("l_suppkey") * 53 + F.col("l_linenumber") * 97) % 680).cast("double").alias("y0"),
        (((F.col("l_partkey") * 37) % 400) + 80 + F.col("l_partkey") % 100).cast("double").alias("x1"), (((F.col("l_suppkey") * 53 + F.col("l_linenumber") * 97) % 680) + 30 + 10 * F.col("l_linenumber")).cast("double").alias("y1"),
        F.coalesce(F.get(F.array(*(F.lit(k) for k in ("heading", "paragraph", "table", "figure", "caption", "list_item"))), (F.col("l_linenumber") - 1).cast("int")), F.lit("discard")).alias("kind"),
        F.round(1 - 5 * F.col("l_discount"), 2).alias("confidence"), (F.col("l_partkey") % 17 == 0).alias("manually_activated"),
    )
    order = F.row_number().over(Window.partitionBy("page").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x1", "confidence")) - 1
    rows = rows.withColumn("reading_order", order)
    return rows.select("page", F.concat(F.lit("p"), F.col("page"), F.lit("-b"), F.col("reading_order")).alias("box_id"), "kind", "x0", "y0", "x1", "y1", "confidence", "reading_order", "manually_activated")


BOXES = """r AS (SELECT l_orderkey // 10 + 1 AS page, CAST((l_partkey * 37) % 400 AS DOUBLE) AS x0, CAST((l_suppkey * 53 + l_linenumber * 97) % 680 AS DOUBLE) AS y0,
  CAST((l_partkey * 37) % 400 + 80 + l_partkey % 100 AS DOUBLE) AS x1, CAST((l_suppkey * 53 + l_linenumber * 97) % 680 + 30 + 10 * l_linenumber AS DOUBLE) AS y1,
  coalesce(list_extract(['heading', 'paragraph', 'table', 'figure', 'caption', 'list_item'], l_linenumber), 'discard') AS kind, round(1 - 5 * l_discount, 2) AS confidence, l_partkey % 17 = 0 AS manually_activated,
  row_number() OVER (PARTITION BY l_orderkey // 10 + 1 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 100, round(1 - 5 * l_discount, 2)) - 1 AS reading_order FROM lineitem),
boxes AS (SELECT *, 'p' || page || '-b' || reading_order AS box_id FROM r)"""


def elements(spark, sf_dir) -> DataFrame:
    """All orders as extracted elements on the same pages, with one to four lines of text each."""
    o = table(spark, sf_dir, "orders")
    x0, y0 = (F.col("o_custkey") * 41) % 400, (F.col("o_orderkey") * 29) % 680
    kind = F.get(F.array(*(F.lit(k) for k in ("title", "text", "table", "image", "list"))), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    text = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 4 + 1).cast("int")), lambda i: F.concat(F.lit("line "), i, F.lit(" of order "), F.col("o_orderkey"))), "\n")
    no_parts = F.lit(None).cast("array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>")
    return o.select((F.floor(F.col("o_orderkey") / 10) + 1).alias("page"), F.col("o_orderkey").alias("element_id"), kind.alias("block_type"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 90).cast("double").alias("x1"), (y0 + 50).cast("double").alias("y1"), text.alias("text"), no_parts.alias("lines"), no_parts.alias("blocks"))


ELEMENTS = """elements AS (SELECT o_orderkey // 10 + 1 AS page, o_orderkey AS element_id, list_extract(['title', 'text', 'table', 'image', 'list'], CAST(substr(o_orderpriority, 1, 1) AS INT)) AS block_type,
  CAST((o_custkey * 41) % 400 AS DOUBLE) AS x0, CAST((o_orderkey * 29) % 680 AS DOUBLE) AS y0, CAST((o_custkey * 41) % 400 + 90 AS DOUBLE) AS x1, CAST((o_orderkey * 29) % 680 + 50 AS DOUBLE) AS y1 FROM orders),
j0 AS (SELECT b.page, b.box_id, b.kind, b.reading_order, e.element_id, e.block_type, greatest(least(b.x1, e.x1) - greatest(b.x0, e.x0), 0) * greatest(least(b.y1, e.y1) - greatest(b.y0, e.y0), 0) AS i,
  (b.x1 - b.x0) * (b.y1 - b.y0) AS ab, (e.x1 - e.x0) * (e.y1 - e.y0) AS ae, (e.x0 + e.x1) / 2 BETWEEN b.x0 AND b.x1 AND (e.y0 + e.y1) / 2 BETWEEN b.y0 AND b.y1 AS inside FROM boxes b JOIN elements e USING (page)),
j AS (SELECT *, CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE i / (ab + ae - i) END AS iou FROM j0)"""


def vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The queries, which are all vectors whose id is divisible by 50, and all vectors."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"), "label")
    return queries, e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"), "label")


VECTORS = """s AS (SELECT q.vec_id AS query, c.vec_id AS doc, round(
    list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) /
    (sqrt(list_sum(list_transform(q.embedding, lambda z: z::DOUBLE * z::DOUBLE))) * sqrt(list_sum(list_transform(c.embedding, lambda z: z::DOUBLE * z::DOUBLE)))), 6) AS score
  FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s),
knn AS (SELECT * FROM k WHERE rank <= 20),
rel AS (SELECT q.vec_id AS query, c.vec_id AS doc FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
h AS (SELECT knn.query, knn.rank, row_number() OVER (PARTITION BY knn.query ORDER BY knn.rank) AS nth FROM knn JOIN rel ON rel.query = knn.query AND rel.doc = knn.doc),
c AS (SELECT query, count(*) AS n FROM rel GROUP BY 1),
per_query AS (SELECT q.vec_id AS query, coalesce(max(c.n), 0) AS n_expected,
  coalesce(count(*) FILTER (WHERE h.rank <= 5) / max(c.n), 0.0) AS recall_5, coalesce(count(*) FILTER (WHERE h.rank <= 10) / max(c.n), 0.0) AS recall_10, coalesce(count(h.rank) / max(c.n), 0.0) AS recall_20,
  max(CASE WHEN h.rank = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit_1, coalesce(1.0::DOUBLE / min(h.rank), 0.0) AS mrr, coalesce(sum(h.nth::DOUBLE / h.rank) / max(c.n), 0.0) AS ap
  FROM embeddings q LEFT JOIN c ON c.query = q.vec_id LEFT JOIN h ON h.query = q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1)"""


def lexical_queries(spark, sf_dir) -> DataFrame:
    """Whole benchmark texts."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
