"""Queries of retrieval, chunks, events and streams. Those of boxes and text are in modules of their own, which ``QUERIES`` takes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions import text as T
from sedimark.operators import chunks as C
from sedimark.operators import curation as Cu
from sedimark.operators import events as E
from sedimark.operators import filters
from sedimark.operators import models
from sedimark.operators import retrieval as R
from sedimark.operators import vector_index as V
from sedimark.operators.scratch import written
from sedimark.plans import inputs as I
from sedimark.plans.registry import ORACLES, QUERIES, query
from sedimark.streaming import events as S

# --- retrieval and its evaluation


def _found(spark, sf_dir, k: int = 20):
    """(ranked, sizes): the (query, doc, rank, relevant) of the vector queries, where vectors of the same label are relevant, and each query's number of these."""
    queries, corpus = I.vectors(spark, sf_dir)
    labels = corpus.select("doc", F.col("label").alias("doc_label"))
    ranked = R.knn(queries, corpus, k).select("query", "doc", "rank").join(queries.select("query", "label"), "query").join(labels, "doc")
    ranked = ranked.select("query", "doc", "rank", (F.col("label") == F.col("doc_label")).alias("relevant"))
    size = corpus.groupBy("label").agg(F.count("*").alias("n"))
    sizes = queries.select("query", "label").join(size, "label").select("query", (F.col("n") - 1).alias("n_expected"))
    return ranked, sizes


@query(f"WITH {I.VECTORS} SELECT query, doc, score, rank FROM knn")
def knn_cosine_topk(spark, sf_dir):
    """Exact 20 nearest vectors of every fiftieth one."""
    return R.knn(*I.vectors(spark, sf_dir), 20).select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


@query()
def ann_topk(spark, sf_dir):
    """The 10 nearest vectors of every fiftieth one that the approximate index finds among all."""
    queries, corpus = I.vectors(spark, sf_dir)
    index = V.build(corpus)
    found = V.search(index, queries, 10) if index else R.knn(queries, corpus, 10)
    return found.select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


def _metrics(spark, sf_dir) -> DataFrame:
    ranked, sizes = _found(spark, sf_dir)
    return R.ranked_metrics(ranked.where("relevant").select("query", "rank"), sizes)


@query(f"WITH {I.VECTORS} SELECT query, n_expected, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10, round(recall_20, 6) AS recall_20, hit_1, round(mrr, 6) AS mrr, round(ap, 6) AS ap FROM per_query")
def ir_metrics_per_query(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return m.select("query", "n_expected", *(F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "recall_20")), "hit_1", F.round("mrr", 6).alias("mrr"), F.round("ap", 6).alias("ap"))


@query(f"""WITH {I.VECTORS} SELECT count(*) AS n, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(recall_20), 6) AS recall_20, round(avg(hit_1), 6) AS hit_1, round(avg(mrr), 6) AS mrr, round(avg(ap), 6) AS map,
  CASE WHEN count(*) < 30 THEN 'indicative' WHEN count(*) < 100 THEN 'preliminary' ELSE 'reportable' END AS status FROM per_query""")
def ir_metrics_aggregate(spark, sf_dir):
    means = [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias("map" if c == "ap" else c) for c in ("recall_5", "recall_10", "recall_20", "hit_1", "mrr", "ap")]
    return _metrics(spark, sf_dir).agg(F.count("*").alias("n"), *means, R.size_status(F.count("*")).alias("status"))


@query(f"WITH {I.VECTORS} SELECT rel.query, rel.doc, coalesce(knn.rank, -1) AS rank, knn.rank IS NOT NULL AS hit FROM rel LEFT JOIN knn ON rel.query = knn.query AND rel.doc = knn.doc")
def ir_ranks_hits(spark, sf_dir):
    """Each relevant vector of each query with its rank, or -1."""
    queries, corpus = I.vectors(spark, sf_dir)
    ranked = R.knn(queries, corpus, 20).select("query", "doc", "rank")
    wanted = queries.select("query", "label").join(corpus.select("doc", "label"), "label").where("query <> doc").select("query", "doc")
    return wanted.join(ranked, ["query", "doc"], "left").select("query", "doc", F.coalesce("rank", F.lit(-1)).cast("long").alias("rank"), F.col("rank").isNotNull().alias("hit"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, list_sort(list(value))[CAST(floor(0.95 * (count(value) - 1)) AS BIGINT) + 1] AS p95, count(*) FILTER (WHERE value < 0) AS failures FROM events GROUP BY 1""")
def ir_latency_p95(spark, sf_dir):
    e = I.table(spark, sf_dir, "events")
    means = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("value") < 0).alias("failures"))
    return means.join(R.p95(e, "event_type", "value"), "event_type", "left")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS n_ok, count(*) FILTER (WHERE event_type = 'error' OR event_type IS NULL) AS n_failed, round(avg(value) FILTER (WHERE event_type <> 'error'), 6) AS mean FROM events GROUP BY 1")
def run_outcomes(spark, sf_dir):
    """Events by day as calls, of which those of type error failed."""
    e = I.table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return R.outcomes(e, "day", F.col("event_type") == "error", "value").withColumn("mean", F.round("mean", 6))


@query(f"""WITH {I.VECTORS}, a AS (SELECT unnest(['recall', 'mrr', 'map']) AS metric, unnest([avg(recall_10), avg(CASE WHEN mrr >= 0.1 THEN mrr ELSE 0 END), avg(ap10)]) AS a, unnest([avg(recall_20), avg(mrr), avg(ap)]) AS b
  FROM per_query LEFT JOIN (SELECT h.query, sum(h.nth::DOUBLE / h.rank) / max(c.n) AS x FROM h JOIN c USING (query) WHERE rank <= 10 GROUP BY 1) y USING (query), LATERAL (SELECT coalesce(x, 0) AS ap10))
SELECT metric, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta FROM a""")
def ir_report_compare(spark, sf_dir):
    """Two runs, cut at 10 and at 20, metric by metric."""
    ranked, sizes = _found(spark, sf_dir)
    hits = written(ranked.where("relevant").select("query", "rank"), "hits")

    def report(k, name):
        m = R.ranked_metrics(hits.where(F.col("rank") <= k), sizes).agg(F.avg(f"recall_{k}").alias("recall"), F.avg("mrr").alias("mrr"), F.avg("ap").alias("map"))
        return m.unpivot([], ["recall", "mrr", "map"], "metric", name)

    both = report(10, "a").join(report(20, "b"), "metric", "full")
    return both.select("metric", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round(F.col("b") - F.col("a"), 6).alias("delta"))


PAIRS = """p AS (SELECT x.vec_id AS a, y.vec_id AS b, round(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) /
  (sqrt(list_sum(list_transform(x.embedding, lambda z: z::DOUBLE * z::DOUBLE))) * sqrt(list_sum(list_transform(y.embedding, lambda z: z::DOUBLE * z::DOUBLE)))), 6) AS score
  FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id)"""


def _vectors(spark, sf_dir):
    return I.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))


@query(f"WITH {PAIRS} SELECT * FROM p WHERE score >= 0.45")
def near_dup_pairs(spark, sf_dir):
    return R.near_pairs(_vectors(spark, sf_dir), 0.45)


def _greedy_sql(nodes: str, least: float) -> str:
    return f"""nodes AS ({nodes}), e AS (SELECT a, b FROM p WHERE score >= {least} AND a IN (SELECT vec_id FROM nodes) AND b IN (SELECT vec_id FROM nodes)),
n AS (SELECT b AS id, row_number() OVER (ORDER BY b) AS i, list(a) AS before FROM e GROUP BY b),
g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS gone UNION ALL
  SELECT n.i, CASE WHEN len(list_filter(n.before, lambda x: NOT list_contains(g.gone, x))) > 0 THEN list_append(g.gone, n.id) ELSE g.gone END FROM g JOIN n ON n.i = g.i + 1)
SELECT vec_id AS id, label FROM nodes WHERE NOT list_contains((SELECT gone FROM g ORDER BY i DESC LIMIT 1), vec_id)"""


@query(f"WITH RECURSIVE {PAIRS}, {_greedy_sql('SELECT vec_id, label FROM embeddings', 0.45)}")
def near_dup_greedy(spark, sf_dir):
    return R.greedy_unlike(_vectors(spark, sf_dir), 0.45)


@query(f"WITH RECURSIVE {PAIRS}, {_greedy_sql('SELECT vec_id, label FROM embeddings WHERE vec_id % 2 = 1 AND vec_id NOT IN (SELECT CASE WHEN a % 2 = 1 THEN a ELSE b END FROM p WHERE score >= 0.35 AND a % 2 <> b % 2)', 0.35)}")
def near_dup_baseline(spark, sf_dir):
    """Vectors with odd ids against those with even ones as a baseline, then among themselves."""
    v = _vectors(spark, sf_dir)
    return R.greedy_unlike(v.where("id % 2 = 1"), 0.35, v.where("id % 2 = 0"))


WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


def _bm25_sql(where: str = "true") -> str:
    return f"""q AS (SELECT item_id AS query, unnest(list_distinct({WORDS})) AS word FROM benchmark),
d AS (SELECT doc_id AS doc, {WORDS} AS w FROM documents WHERE {where}),
shape AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d WHERE w IS NOT NULL),
tf AS (SELECT doc, len, word, count(*) AS tf FROM (SELECT doc, len(w) AS len, unnest(w) AS word FROM d) SEMI JOIN q USING (word) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score FROM tf JOIN df USING (word) JOIN q USING (word), shape GROUP BY 1, 2),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 10)"""


LETTERS = "list_transform(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' '), lambda x: (length(lower(text)) - length(replace(lower(text), x, '')))::DOUBLE)"
HYBRID = f"""{_bm25_sql("lang = 'en'")},
qv AS (SELECT item_id AS query, {LETTERS} AS v FROM benchmark), dv AS (SELECT doc_id AS doc, {LETTERS} AS v FROM documents WHERE lang = 'en'),
cs AS (SELECT query, doc, round(coalesce(list_dot_product(q.v, d.v) / nullif(sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v)), 0), 0), 6) AS score FROM qv q, dv d),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM cs) WHERE rank <= 10),
f AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT query, doc, rank FROM lex UNION ALL SELECT query, doc, rank FROM vec) GROUP BY 1, 2),
hyb AS (SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM f) WHERE rank <= 5)"""


def _documents(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text", "lang", models.letters(F.col("text")).alias("vector"))


def _hybrid(spark, sf_dir):
    queries = I.lexical_queries(spark, sf_dir).withColumn("vector", models.letters(F.col("text")))
    return R.hybrid(queries, _documents(spark, sf_dir), 5, where=F.col("lang") == "en")


@query(f"WITH {_bm25_sql()} SELECT query, doc, round(score, 4) AS score FROM lex")
def bm25_topk(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return R.bm25(I.lexical_queries(spark, sf_dir), docs, 10).select("query", "doc", F.round("score", 4).alias("score"))


@query(f"WITH {_bm25_sql()} SELECT query, doc, round(score, 4) AS score FROM (SELECT *, max(score) OVER (PARTITION BY query) AS best FROM lex) WHERE score * 5 >= best * 2")
def search_strict(spark, sf_dir):
    """Hits of whole benchmark texts that come near enough to the best one."""
    docs = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return R.strict(R.bm25(I.lexical_queries(spark, sf_dir), docs, 10), 3).select("query", "doc", F.round("score", 4).alias("score"))


FIELDS = f"""q AS (SELECT item_id AS query, unnest(list_distinct({WORDS})) AS word FROM benchmark),
fd AS (SELECT doc_id AS doc, unnest(['title', 'content']) AS field, unnest([2.0::DOUBLE, 1.0]) AS weight, unnest([split_part(text, chr(10), 1), CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END]) AS text FROM documents),
fw AS (SELECT doc, field, weight, coalesce({WORDS}, []) AS w FROM fd),
fshape AS (SELECT field, count(*) AS n, avg(len(w)) AS mean FROM fw GROUP BY 1),
ftf AS (SELECT doc, field, weight, len, word, count(*) AS tf FROM (SELECT doc, field, weight, len(w) AS len, unnest(w) AS word FROM fw) SEMI JOIN q USING (word) GROUP BY ALL),
fdf AS (SELECT word, count(DISTINCT doc) AS df FROM ftf GROUP BY 1),
inf AS (SELECT doc, word, n, sum(weight * tf / (1 - 0.75 + 0.75 * len / mean)) AS tf FROM ftf JOIN fshape USING (field) GROUP BY ALL),
fs AS (SELECT query, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (1.2 + tf)), 6) AS score FROM inf JOIN fdf USING (word) JOIN q USING (word) GROUP BY 1, 2),
flex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM fs) WHERE rank <= 10)"""


def _fielded(spark, sf_dir, k: int = 10):
    text = F.col("text")
    docs = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text", F.substring_index(text, "\n", 1).alias("title"), F.when(F.instr(text, "\n") > 0, F.substr(text, F.instr(text, "\n") + 1)).otherwise("").alias("content"))
    return R.bm25f(I.lexical_queries(spark, sf_dir), docs, k, {"title": 2.0, "content": 1.0}), docs


@query(f"WITH {FIELDS} SELECT query, doc, score FROM flex")
def bm25f_topk(spark, sf_dir):
    """Whole benchmark texts against documents as a title, their first line, and content."""
    return _fielded(spark, sf_dir)[0].select("query", "doc", "score")


@query(f"""WITH {FIELDS}, pw AS (SELECT h.query, h.doc, h.score, w[i] AS word, i FROM flex h JOIN (SELECT doc_id AS doc, {WORDS} AS w FROM documents) d USING (doc), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
pp AS (SELECT pw.query, doc, i, pw.word, lag(i) OVER o AS before, lag(pw.word) OVER o AS other FROM pw JOIN q ON q.query = pw.query AND q.word = pw.word WINDOW o AS (PARTITION BY pw.query, doc ORDER BY i)),
p AS (SELECT query, doc, coalesce(sum(CASE WHEN other <> word THEN 1.0::DOUBLE / ((i - before) * (i - before)) END), 0) AS p FROM pp GROUP BY 1, 2),
r AS (SELECT query, doc, round(score + p / (1 + p), 6) AS score FROM flex JOIN p USING (query, doc))
SELECT query, doc, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM r) WHERE rank <= 5""")
def search_proximity(spark, sf_dir):
    """The best of the fielded hits by how close the query's words stand in them."""
    hits, docs = _fielded(spark, sf_dir)
    return R.by_proximity(hits, I.lexical_queries(spark, sf_dir), docs, 5).select("query", "doc", "score")


@query("""SELECT source, lang, count(*) AS n FROM documents WHERE (source IN ('src1', 'src2', 'src3') AND NOT (lang = 'en' OR n_chars >= 3000)) OR (lang = 'de' AND n_chars < 500 AND source IS NOT NULL) GROUP BY ALL""")
def search_filtered(spark, sf_dir):
    """Documents that a filter expression of a search lets pass."""
    docs = I.table(spark, sf_dir, "documents")
    where = "source in ('src1', 'src2', 'src3') and not (lang eq 'en' or n_chars ge 3000) or lang eq 'de' and n_chars lt 500 and source ne null"
    return docs.where(filters.condition(where, docs.columns)).groupBy("source", "lang").agg(F.count("*").alias("n"))


@query(f"WITH {HYBRID} SELECT query, doc, score, rank FROM hyb")
def hybrid_rrf(spark, sf_dir):
    """Text and vector search over the English documents, fused by rank."""
    return _hybrid(spark, sf_dir).select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {HYBRID}, r AS (SELECT h.query, h.doc, CASE WHEN d.doc_id % 2 = 0 THEN round(d.n_chars / 1000.0, 3) ELSE h.score END AS score FROM hyb h JOIN documents d ON d.doc_id = h.doc) SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM r")
def search_reranked(spark, sf_dir):
    """Hits by a second score where they have one (here the length of documents with even ids)."""
    second = I.table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("doc"), F.round(F.col("n_chars") / 1000, 3).alias("rerank"))
    hits = written(_hybrid(spark, sf_dir).select("query", "doc", "score"), "hits")  # used twice
    return R.reranked(hits, hits.select("query", "doc").join(second, "doc"), 5).select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {HYBRID} SELECT query, sha256(string_agg('[' || doc || '] ' || text, chr(10) ORDER BY rank)) AS context_sha256, count(*) AS n_cited FROM hyb JOIN documents ON doc_id = doc GROUP BY 1")
def search_context(spark, sf_dir):
    """What a completion would be given: each query's hits as one text, and their scores as citations."""
    c = R.contexts(_hybrid(spark, sf_dir), _documents(spark, sf_dir))
    return c.select("query", F.sha2("context", 256).alias("context_sha256"), F.size("citations").cast("long").alias("n_cited"))


# --- paragraphs and chunks

CHUNKS = f"""{I.PARAGRAPHS}, n AS (SELECT doc_id, idx, role, trim(regexp_replace(content, '[\\s\\x1c-\\x1f]+', ' ', 'g')) AS content FROM paragraphs WHERE role IS NULL OR role <> 'pageFooter'),
w AS (SELECT *, coalesce(role IN ('title', 'sectionHeading'), false) AS opens FROM n WHERE content <> ''),
x AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY idx) AS section, max(CASE WHEN role = 'title' THEN content END) OVER (PARTITION BY doc_id) AS title FROM w),
chunks AS (SELECT doc_id, 'doc-' || doc_id || '-' || CASE WHEN section < 1000 THEN lpad(section::VARCHAR, 3, '0') ELSE section::VARCHAR END AS chunk_id, coalesce(max(title), '') AS title,
  max(CASE WHEN opens THEN content END) AS section_heading, coalesce(string_agg(CASE WHEN NOT opens THEN content END, ' ' ORDER BY idx), '') AS chunk FROM x WHERE section > 0 GROUP BY doc_id, section)"""


@query(f"WITH {CHUNKS} SELECT * FROM chunks")
def section_chunks(spark, sf_dir):
    return C.section_chunks(I.paragraphs(spark, sf_dir))


@query()
def chunk_inputs(spark, sf_dir):
    """What an embedder is given of each chunk: its heading and text, up to 8191 tokens of a byte-level vocabulary."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    chunks = C.section_chunks(I.paragraphs(spark, sf_dir)).select("chunk_id", F.concat_ws(" ", F.coalesce("section_heading", F.lit("")), "chunk").alias("text"))
    sized = chunks.withColumn("chars", F.length("text").cast("long"))
    cut = models.truncated(sized, "text", lambda: models.Vocabulary(path), least_bytes=1)
    return cut.select("chunk_id", "chars", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH {CHUNKS} SELECT doc_id, max(title) AS title, count(*) AS n_chunks, count(*) FILTER (WHERE chunk = '') AS n_empty FROM chunks GROUP BY 1")
def chunk_title(spark, sf_dir):
    return C.section_chunks(I.paragraphs(spark, sf_dir)).groupBy("doc_id").agg(F.max("title").alias("title"), F.count("*").alias("n_chunks"), F.count_if(F.col("chunk") == "").alias("n_empty"))


@query(f"WITH {I.PARAGRAPHS} SELECT coalesce(role, '<body>') AS role, CASE WHEN role IN ('title', 'sectionHeading') THEN 'heading' ELSE 'paragraph' END AS element_type, count(*) AS n FROM paragraphs GROUP BY ALL")
def role_counts(spark, sf_dir):
    return I.paragraphs(spark, sf_dir).groupBy(F.coalesce("role", F.lit("<body>")).alias("role"), C.element_type(F.col("role")).alias("element_type")).agg(F.count("*").alias("n"))


@query(f"WITH {I.PARAGRAPHS} SELECT doc_id, idx, 'p' || (idx // 5 + 1) || '-' || substr(sha256(content), 1, 8) AS element_id, substr(sha256(content), 1, 8) AS bare_id FROM paragraphs WHERE content <> ''")
def element_ids(spark, sf_dir):
    rows = I.paragraphs(spark, sf_dir).where("content <> ''").withColumn("element_id", T.element_id(F.floor(F.col("idx") / 5) + 1, F.col("content")))
    return rows.select("doc_id", F.col("idx").cast("long").alias("idx"), "element_id", T.bare_element_id(F.col("element_id")).alias("bare_id"))


SOURCED = f"""{I.PARAGRAPHS}, {I.GOLDEN}, el AS (SELECT doc_id, idx, 'p' || (idx // 5 + 1) || '-' || substr(sha256(content), 1, 8) AS element_id, substr(sha256(content), 1, 8) AS bare_id, content FROM paragraphs WHERE content <> ''),
dn AS (SELECT doc_id, count(*) AS n FROM el GROUP BY 1), nth AS (SELECT doc_id, bare_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS k FROM el),
entries AS (SELECT s.entry_id, s.deprecated, dn.doc_id, nth.bare_id, 'question ' || s.entry_id AS query FROM state s JOIN dn ON dn.doc_id = s.entry_id % (SELECT max(doc_id) + 1 FROM documents) JOIN nth ON nth.doc_id = dn.doc_id AND nth.k = s.created_event % dn.n)"""


def _sourced(spark, sf_dir):
    """(elements, entries): all elements, and the entries of the golden log, each of which names an element of the document that its id falls to."""
    rows = I.paragraphs(spark, sf_dir).where("content <> ''").withColumn("element_id", T.element_id(F.floor(F.col("idx") / 5) + 1, F.col("content"))).withColumn("bare_id", T.bare_element_id(F.col("element_id")))
    in_order = Window.partitionBy("doc_id")
    place = rows.select("doc_id", "bare_id", (F.row_number().over(in_order.orderBy("idx")) - 1).alias("k"), F.count("*").over(in_order).alias("n"))
    last = I.table(spark, sf_dir, "documents").agg((F.max("doc_id") + 1).alias("docs"))  # one row
    state = E.fold(I.golden_events(spark, sf_dir)).crossJoin(F.broadcast(last)).withColumn("doc_id", F.col("entry_id") % F.col("docs"))
    entries = state.join(place, "doc_id").where(F.col("created_event") % F.col("n") == F.col("k"))
    return rows, entries.select("entry_id", "deprecated", "doc_id", "bare_id", F.concat(F.lit("question "), "entry_id").alias("query"))


@query(f"""WITH {SOURCED}, n AS (SELECT doc_id, bare_id, count(*) AS n FROM entries WHERE NOT deprecated GROUP BY 1, 2)
SELECT el.doc_id, el.idx, coalesce(n.n, 0) AS n_entries FROM el LEFT JOIN n USING (doc_id, bare_id)""")
def entries_per_element(spark, sf_dir):
    """All elements with the number of active entries that name them."""
    elements, entries = _sourced(spark, sf_dir)
    n = entries.where("not deprecated").groupBy("doc_id", "bare_id").agg(F.count("*").alias("n"))
    return elements.join(n, ["doc_id", "bare_id"], "left").select("doc_id", F.col("idx").cast("long").alias("idx"), F.coalesce("n", F.lit(0)).alias("n_entries"))


@query(f"""WITH {SOURCED}, own AS (SELECT doc_id, bare_id, string_agg(entry_id || ':' || query, ',' ORDER BY entry_id::VARCHAR) AS q FROM entries WHERE NOT deprecated GROUP BY 1, 2)
SELECT el.doc_id, el.idx, el.element_id, own.q AS entries FROM el JOIN own USING (doc_id, bare_id)""")
def element_detail(spark, sf_dir):
    """Elements that entries name, with these."""
    elements, entries = _sourced(spark, sf_dir)
    own = lambda df: df.withColumn("slug", F.col("doc_id").cast("string"))
    d = Cu.element_detail(own(elements), own(entries).withColumn("entry_id", F.col("entry_id").cast("string"))).where(F.size("entries") > 0)
    said = F.array_join(F.transform("entries", lambda e: F.concat(e["entry_id"], F.lit(":"), e["query"])), ",")
    return d.select("doc_id", F.col("idx").cast("long").alias("idx"), "element_id", said.alias("entries"))


@query(f"WITH {SOURCED} SELECT entry_id, doc_id, deprecated FROM entries WHERE doc_id % 3 = 0 AND NOT deprecated UNION ALL SELECT entry_id, doc_id, deprecated FROM entries WHERE doc_id % 3 = 1")
def entries_listing(spark, sf_dir):
    """Entries by document: of a third of the documents the active ones, of another third all."""
    _, entries = _sourced(spark, sf_dir)
    e = entries.withColumn("slug", F.concat(F.lit("third-"), F.col("doc_id") % 3))
    return Cu.listing(e, slug="third-0").unionByName(Cu.listing(e, slug="third-1", with_deprecated=True)).select("entry_id", "doc_id", "deprecated")


@query(f"""WITH {CHUNKS}, h AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN chunk_id || '-gone' ELSE chunk_id END AS chunk_id, 'sha256:' || sha256(chunk) || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END AS hash FROM chunks)
SELECT DISTINCT h.doc_id AS entry_id FROM h LEFT JOIN chunks c USING (chunk_id) WHERE c.chunk_id IS NULL OR 'sha256:' || sha256(c.chunk) <> h.hash""")
def drift_check(spark, sf_dir):
    """Entries that hold their document's chunk hashes, spoilt in every seventh document and for chunks that are gone in every eleventh."""
    chunks = C.section_chunks(I.paragraphs(spark, sf_dir))
    h = F.concat(T.content_hash(F.col("chunk")), F.when(F.col("doc_id") % 7 == 0, "x").otherwise(""))
    at = F.concat("chunk_id", F.when(F.col("doc_id") % 11 == 0, "-gone").otherwise(""))
    entries = chunks.groupBy(F.col("doc_id").alias("entry_id")).agg(F.map_from_entries(F.collect_list(F.struct(at, h))).alias("chunk_hashes"))
    return C.drifted(entries, chunks)


@query("""WITH b AS (SELECT doc_id, source, 0::BIGINT AS n_chars FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 2 = 0)
SELECT doc_id, source, n_chars FROM documents WHERE source NOT IN (SELECT source FROM b) UNION ALL SELECT * FROM b""")
def replace_by_source(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    batch = docs.where(F.col("source").isin("src1", "src2") & (F.col("doc_id") % 2 == 0)).withColumn("n_chars", F.lit(0).cast("long"))
    return C.replace_by_source(docs, batch)


@query("SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 100) ORDER BY md5('7:' || doc_id), doc_id LIMIT 20")
def ranked_sample(spark, sf_dir):
    """Twenty documents drawn from the hundred longest."""
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return C.seeded_sample(docs, 20, 7, "doc_id", [F.desc_nulls_last("n_chars")])


@query("SELECT doc_id, source FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark, sf_dir):
    return C.seeded_sample(I.table(spark, sf_dir, "documents").select("doc_id", "source"), 100, 7, "doc_id")


# --- golden events


@query(f"WITH {I.GOLDEN} SELECT entry_id, created_event, n_reviews, deprecated FROM state")
def events_fold(spark, sf_dir):
    return E.fold(I.golden_events(spark, sf_dir)).select("entry_id", "created_event", F.size("review_chain").cast("long").alias("n_reviews"), "deprecated")


@query(f"WITH {I.GOLDEN} SELECT entry_id FROM state WHERE NOT deprecated")
def events_active(spark, sf_dir):
    return E.active(E.fold(I.golden_events(spark, sf_dir))).select("entry_id")


@query(f"WITH {I.GOLDEN} SELECT entry_id, coalesce(list_extract(['expert', 'phd', 'masters', 'bachelors', 'other'], best), 'synthetic') AS level FROM state")
def events_level(spark, sf_dir):
    return E.fold(I.golden_events(spark, sf_dir)).select("entry_id", "level")


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 <> 0")
def events_idempotent(spark, sf_dir):
    """A batch with repeated ids against a log that has a third of them."""
    e = I.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_id").alias("ordinal"))
    batch = e.unionByName(e.where("event_id % 5 = 0").withColumn("ordinal", F.col("ordinal") + 1_000_000_000))
    return E.new_events(e.where("event_id % 3 = 0"), batch).select("event_id", "user_id")


@query(f"WITH {I.GOLDEN} SELECT entry_id, event_id FROM b WHERE event_type IN ('reviewed', 'deprecated') AND (first_born IS NULL OR ord < first_born)")
def events_orphans(spark, sf_dir):
    return E.orphans(I.golden_events(spark, sf_dir)).select("entry_id", "event_id")


@query(f"""WITH {I.GOLDEN}, t AS (SELECT entry_id FROM state WHERE NOT deprecated AND entry_id % 4 = 0)
SELECT entry_id + 1000000 AS entry_id, 'created' AS event_type, entry_id AS refines FROM t UNION ALL SELECT entry_id, 'deprecated', NULL FROM t""")
def refine_chain(spark, sf_dir):
    g = I.golden_events(spark, sf_dir)
    asked = g.select("entry_id").distinct().where("entry_id % 4 = 0").withColumn("new_id", F.col("entry_id") + 1_000_000)
    return E.refine(E.fold(g), asked)


ACTOR = '{"kind": "human", "pseudonym": "a", "level": "phd"}'
REQUESTS = f"""{I.GOLDEN}, asked AS (SELECT DISTINCT user_id * 3 AS entry_id FROM events), r AS (SELECT a.entry_id, CASE WHEN s.entry_id IS NULL THEN 'NotFound' WHEN s.deprecated THEN 'Deprecated' END AS error, 'log-' || (a.entry_id % 2) AS slug, s.entry_id IS NOT NULL AS known FROM asked a LEFT JOIN state s USING (entry_id))"""


def _requests(spark, sf_dir):
    state = E.fold(I.golden_events(spark, sf_dir)).select(F.col("entry_id").cast("string").alias("entry_id"), "deprecated", F.concat(F.lit("log-"), F.col("entry_id") % 2).alias("slug"))
    asked = I.table(spark, sf_dir, "events").select((F.col("user_id") * 3).cast("string").alias("entry_id")).distinct()
    return state, asked.withColumn("query", F.concat(F.lit("new "), "entry_id")).withColumn("chunk_hashes", F.create_map().cast("map<string,string>")).withColumn("reason", F.lit("refined"))


@query(f"""WITH {REQUESTS} SELECT entry_id::VARCHAR AS asked, CASE WHEN known THEN slug END AS slug, error, 'created' AS event_type, entry_id::VARCHAR AS refines, NULL AS reason, true AS is_new FROM r WHERE error IS NULL
UNION ALL SELECT entry_id::VARCHAR, slug, NULL, 'deprecated', NULL, 'refined', false FROM r WHERE error IS NULL UNION ALL SELECT entry_id::VARCHAR, CASE WHEN known THEN slug END, error, NULL, NULL, NULL, NULL FROM r WHERE error IS NOT NULL""")
def refine_requests(spark, sf_dir):
    """Requests by entry id over several logs: two events with one time each, or an error."""
    e = Cu.refine(*_requests(spark, sf_dir), ACTOR, "2026-01-01T00:00:00Z")
    return e.select("asked", "slug", "error", "event_type", F.get_json_object("payload", "$.entry_data.refines").alias("refines"), F.get_json_object("payload", "$.reason").alias("reason"), (F.col("entry_id") != F.col("asked")).alias("is_new"))


@query(f"WITH {REQUESTS} SELECT entry_id::VARCHAR AS asked, CASE WHEN known THEN slug END AS slug, error, CASE WHEN error IS NULL THEN 'deprecated' END AS event_type, CASE WHEN error IS NULL THEN entry_id::VARCHAR END AS entry_id FROM r")
def deprecate_requests(spark, sf_dir):
    e = Cu.deprecate(*_requests(spark, sf_dir), ACTOR, "2026-01-01T00:00:00Z")
    return e.select("asked", "slug", "error", "event_type", "entry_id")


# --- curation and streams in their batch form


@query("""WITH a AS (SELECT conv_id AS curator, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, length(text) % 20 AS s FROM conversations)
SELECT curator, place, 'src' || s AS slug FROM a WHERE s % 2 = 0""")
def curator_visibility(spark, sf_dir):
    """Assigned documents that are open for curation, in the order of assignment."""
    c = I.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("curator_id"), F.struct("turn", F.concat(F.lit("src"), F.length("text") % 20).alias("slug")).alias("a"))
    people = c.groupBy("curator_id").agg(F.transform(F.sort_array(F.collect_list("a")), lambda x: x["slug"]).alias("assigned_slugs"))
    meta = spark.range(20).select(F.concat(F.lit("src"), "id").alias("slug"), F.when(F.col("id") % 2 == 0, "open-for-curation").otherwise("raw").alias("status"))
    return Cu.visible_documents(people, meta).select(F.col("curator_id").alias("curator"), F.col("place").cast("long").alias("place"), "slug")


ASSIGNED = """a AS (SELECT conv_id, turn, 'src' || (length(text) % 20) AS slug FROM conversations), f AS (SELECT conv_id, slug, min(turn) AS first_turn FROM a GROUP BY 1, 2)"""


@query(f"WITH {ASSIGNED} SELECT 'c' || conv_id AS curator_id, string_agg(slug, ',' ORDER BY first_turn) FILTER (WHERE slug <> 'src3') AS slugs FROM f GROUP BY 1")
def curator_assign(spark, sf_dir):
    """Assignments turn by turn, each document once in the order of its first, and one document taken back."""
    c = I.table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("curator_id"), "turn", F.concat(F.lit("src"), F.length("text") % 20).alias("slug"))
    people = c.groupBy("curator_id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("turn", "slug"))), lambda x: x["slug"])).alias("assigned_slugs"))
    again = Cu.assign(people, c.where("turn = 0").select("curator_id", "slug"))  # what is there already changes nothing
    less = Cu.assign(again, people.select("curator_id", F.lit("src3").alias("slug")), remove=True)
    return less.select("curator_id", F.nullif(F.array_join("assigned_slugs", ","), F.lit("")).alias("slugs"))


@query("SELECT 't' || conv_id AS token, CASE WHEN conv_id % 3 = 0 AND conv_id % 2 = 0 THEN 'curator' ELSE 'admin' END AS role, CASE WHEN conv_id % 3 = 0 AND conv_id % 2 = 0 THEN 'c' || conv_id END AS curator_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE (conv_id % 3 = 0 AND conv_id % 2 = 0) OR conv_id = 1")
def identity_lookup(spark, sf_dir):
    """Tokens by their hashes: of active curators, and the administrator's."""
    ids = I.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    people = ids.where("conv_id % 3 = 0").select(F.sha2(F.concat(F.lit("t"), "conv_id"), 256).alias("token_sha256"), F.concat(F.lit("c"), "conv_id").alias("curator_id"), (F.col("conv_id") % 2 == 0).alias("active"))
    return Cu.identities(ids.select(F.concat(F.lit("t"), "conv_id").alias("token")), people, "t1")


@query("SELECT page_id FROM pages WHERE contains(lower(url), 'example.com/fr') OR contains(lower(regexp_replace(url, '[^a-z]', '', 'g')), 'example.com/fr')")
def inbox_filter(spark, sf_dir):
    p = I.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("filename"), F.lower(F.regexp_replace("url", "[^a-z]", "")).alias("slug"))
    return Cu.inbox(p, "example.COM/fr").select("page_id")


#: Event types of the table as those of a worker; a click is of no known type.
WORKER = {"signup": "model-loading", "view": "work-progress", "purchase": "work-complete", "error": "work-failed"}


@query("""WITH k AS (SELECT *, CASE event_type WHEN 'signup' THEN 'loading' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS to_stage FROM events)
SELECT user_id, coalesce(arg_max(to_stage, (ts, event_id)) FILTER (WHERE to_stage IS NOT NULL), 'idle') AS stage, count(to_stage) AS n_events, count(*) FILTER (WHERE event_type = 'error') AS n_errors FROM k GROUP BY 1""")
def stream_reduce(spark, sf_dir):
    """Each job's stage after its last event of a known type, in batch form."""
    names = F.create_map(*(F.lit(x) for pair in WORKER.items() for x in pair))
    e = I.table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.coalesce(F.try_element_at(names, F.col("event_type")), F.col("event_type")).alias("type"), F.struct("ts", "event_id").alias("at"))
    return S.last_stages(e).select(F.col("job").alias("user_id"), "stage", "n_events", "n_errors")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_tumbling(spark, sf_dir):
    e = I.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, no""")
def ext_session(spark, sf_dir):
    e = I.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


# the other queries register themselves
from sedimark.plans import box_queries, flow_queries, text_queries  # noqa: E402, F401
