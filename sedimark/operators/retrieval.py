"""Top-k retrieval (vectors, words, both fused) and its evaluation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.operators import models
from sedimark.operators.scratch import written, written_in_small_batches
from sedimark.operators.vector_index import FEW, each_row, knn, matrix, top_k


#: Vectors in one block, pairs in one batch from Python.
BLOCK, PART = 1024, 65_536


def vector_blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """(grp, first, ids, vectors, centre, radius) of ``rows`` (id, grp, vector): at most ``size`` vectors of one group, like ones together.

    ``vectors`` are brought to length 1 (null ones stay 0) and held as bytes; no
    vector of a block is farther from ``centre`` than ``radius`` (an angle).
    """
    rows = rows.select(F.col("id").cast("long"), F.col("grp").cast("string"), F.col("vector").cast("array<double>"))

    def code(batches):
        signs = None
        for batch in batches:
            x = matrix(batch.column(2))
            if signs is None:
                signs = np.random.default_rng(7).normal(size=(x.shape[1], 32))
            bits = np.packbits(x @ signs > 0, axis=1) if len(x) else np.zeros((0, 4), np.uint8)
            codes = bits.astype(np.int64) @ (1 << np.array([24, 16, 8, 0], np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int64())], ["id", "grp", "vector", "code"])

    def block(batches):
        held: list[tuple] = []

        def close():
            m = np.array([v for _, _, v in held])
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            centre = m.mean(0)
            centre /= max(np.linalg.norm(centre), 1e-300)
            radius = float(np.arccos(np.clip(m @ centre, -1, 1)).max())
            row = [[held[0][1]], [held[0][0]], [[i for i, _, _ in held]], [m.tobytes()], [centre.tobytes()], [radius]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.float64()], strict=True)], ["grp", "first", "ids", "vectors", "centre", "radius"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (held[-1][1] != row[1] or len(held) == size or len(held[-1][2]) != len(row[2])):
                    yield close()
                held.append(row)
        if held:
            yield close()

    dealt = rows.mapInArrow(code, "id long, grp string, vector array<double>, code long").repartitionByRange("grp", "code", "id").sortWithinPartitions("grp", "code", "id")
    return dealt.mapInArrow(block, "grp string, first long, ids array<long>, vectors binary, centre binary, radius double")


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


#: Pairs of a query and a document that one task scores, about.
PAIRS = 500_000


def dealt_by_document(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``docs`` (doc, ...) with all rows of a document in one partition, in as many partitions as a task's pairs ask for."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(max(least, -(-docs.count() * queries.count() // PAIRS)), "doc")


def bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi BM25 over ``docs`` (doc, text) for ``queries`` (query, text).

    Texts are dealt out by document; from there on all rows of a document stay in one
    partition, since what they are joined with is the queries' words alone. So neither
    its words nor its scores cross a shuffle: a task hands on each query's k best. That
    is done twice, first for each word's number of documents; the row for the empty
    word carries the corpus's number of documents and mean length.
    """
    terms = queries.select("query", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    asked = queries.select(F.explode(F.array_append(words(F.coalesce("text", F.lit(""))), F.lit(""))).alias("word")).distinct()
    sized = dealt_by_document(docs.select("doc", "text"), queries).select("doc", words(F.col("text")).alias("w")).select("doc", F.size("w").alias("len"), F.explode(F.array_append("w", F.lit(""))).alias("word"))
    counts = sized.join(asked, "word", "left_semi").groupBy("doc", "len", "word").agg(F.count("*").alias("tf"))
    seen = written(counts.groupBy("word").agg(F.count("*").alias("df"), F.avg("len").alias("mean")), "words")  # a row a word of the queries
    shape = seen.where("word = ''").select(F.col("df").alias("n"), "mean")  # one row
    tf = counts.where("word <> ''")
    df = seen.where("word <> ''").select("word", "df")
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    weighed = tf.join(df, "word").crossJoin(F.broadcast(shape)).select("doc", "word", weight.alias("weight"))
    return top_k(weighed.join(terms, "word").groupBy("query", "doc").agg(F.round(F.sum("weight"), 6).alias("score")), k)


def bm25f(queries: DataFrame, docs: DataFrame, k: int, weights: dict[str, float], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 over several fields of ``docs`` (doc and the fields of ``weights``) for ``queries`` (query, text).

    A word's count in a field is divided by the field's length against its mean, and
    weighed; the sum over fields saturates as one. As in :func:`bm25`, a document's
    rows stay in one partition, and a row for the empty word carries each field's length.
    """
    terms = queries.select("query", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    asked = queries.select(F.explode(F.array_append(words(F.coalesce("text", F.lit(""))), F.lit(""))).alias("word")).distinct()
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(float(w)).alias("weight"), F.coalesce(words(F.col(f)), F.array().cast("array<string>")).alias("w")) for f, w in weights.items()))
    sized = dealt_by_document(docs.select("doc", *weights), queries).select("doc", F.explode(fields).alias("f")).select("doc", "f.field", "f.weight", F.size("f.w").alias("len"), F.explode(F.array_append("f.w", F.lit(""))).alias("word"))
    counts = sized.join(asked, "word", "left_semi").groupBy("doc", "field", "weight", "len", "word").agg(F.count("*").alias("tf"))
    # a document counts once for a word in whatever field, and once for each field's length
    own = F.col("word") == ""
    once = counts.select("doc", "word", F.when(own, F.col("field")).alias("field"), F.when(own, F.col("len")).alias("len")).distinct()
    seen = written(once.groupBy("word", "field").agg(F.count("*").alias("df"), F.avg("len").alias("mean")), "words")  # a row a word of the queries, and one a field
    shape = seen.where("word = ''").select("field", F.col("df").alias("n"), "mean")
    norm = 1 - b + b * F.coalesce(F.try_divide("len", "mean"), F.lit(1.0))
    in_fields = counts.where("word <> ''").join(F.broadcast(shape), "field").groupBy("doc", "word", "n").agg(F.sum(F.col("weight") * F.col("tf") / norm).alias("tf"))
    df = seen.where("word <> ''").select("word", "df")
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") / (k1 + F.col("tf"))
    weighed = in_fields.join(df, "word").select("doc", "word", weight.alias("weight"))
    return top_k(weighed.join(terms, "word").groupBy("query", "doc").agg(F.round(F.sum("weight"), 6).alias("score")), k)


def by_proximity(hits: DataFrame, queries: DataFrame, docs: DataFrame, k: int, share: float = 1.0) -> DataFrame:
    """Hits (query, doc, score) ranked anew by how close the query's words stand in the document: score + share * p / (1 + p).

    p is the sum of 1 / gap^2 over neighbouring occurrences of different words of the
    query, in the order of their places. Only texts of hits are looked at.
    """
    wanted = queries.select("query", F.array_distinct(words(F.col("text"))).alias("wanted"))
    both = written(hits.select("query", "doc", "score"), "hits").join(docs.select("doc", "text"), "doc").join(wanted, "query")
    places = F.filter(F.transform(words(F.col("text")), lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains("wanted", x["w"]))
    # a step of its own: the places are made once
    rows = written(both.select("query", "doc", "score", places.alias("p")), "places")
    gap = F.zip_with(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), lambda y, x: F.when(x["w"] == y["w"], 0.0).otherwise(1.0 / (y["i"] - x["i"]) ** 2))
    near = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)
    return top_k(rows.select("query", "doc", F.round(F.col("score") + share * near / (1 + near), 6).alias("score")), k)


def hybrid(queries: DataFrame, docs: DataFrame, k: int, depth: int = 10, where: Column | None = None) -> DataFrame:
    """Text and vector search in one: ``queries`` (query, text, vector) against ``docs`` (doc, text, vector, ...) that pass ``where``, both lists of ``depth`` fused by rank."""
    asked = docs if where is None else docs.where(where)
    found = queries.select("query", "text"), asked.select("doc", "text")
    vectors = written(asked.select("doc", "vector"), "vectors")  # made of whole texts: once
    # ids of queries and documents are of different kinds: none is left out of the vector list as itself
    near = knn(queries.select((-1 - F.col("query")).alias("query"), "vector"), vectors, depth)
    return fuse([bm25(*found, depth), near.withColumn("query", -1 - F.col("query"))], k)


def reranked(hits: DataFrame, rerank: DataFrame, k: int) -> DataFrame:
    """Hits (query, doc, score) by a second score (query, doc, rerank) where they have one."""
    both = hits.join(rerank, ["query", "doc"], "left").select("query", "doc", F.coalesce("rerank", "score").alias("score"))
    return top_k(both, k)


def contexts(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """(query, context, citations): each query's documents in the order of their ranks as one text, and the map of their scores."""
    hits = written(hits.select("query", "doc", "rank", "score"), "hits")  # few: made once, and the texts needn't be sorted to meet them
    j = hits.join(docs.select("doc", "text"), "doc").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "doc", "score", "text"))).alias("h"))
    cited = F.map_from_entries(F.transform("h", lambda x: F.struct(x["doc"], x["score"])))
    return j.select("query", F.array_join(F.transform("h", lambda x: F.concat(F.lit("["), x["doc"], F.lit("] "), x["text"])), "\n").alias("context"), cited.alias("citations"))


def strict(hits: DataFrame, strictness: int = 3) -> DataFrame:
    """Hits (query, doc, score) that are near enough to their query's best: 1 keeps all, each step up to 5 asks for a fifth more of the best score."""
    if not 1 <= strictness <= 5:
        raise ValueError(f"strictness goes from 1 to 5: {strictness}")
    best = F.max("score").over(Window.partitionBy("query"))
    return hits.withColumn("best", best).where(F.col("score") * 5 >= F.col("best") * (strictness - 1)).drop("best")


def answered(context: DataFrame, queries: DataFrame, name: str) -> DataFrame:
    """(query, answer, citations): what the model ``name`` says to each query's text after its context; a query without a context isn't asked."""
    asked = context.join(queries.select("query", "text"), "query").withColumn("prompt", F.concat_ws("\n\n", "context", "text"))
    return models.apply(asked.select("query", "citations", "prompt"), name, "prompt", "answer", "string").select("query", "answer", "citations")


def fuse(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query, doc, rank)."""
    both = lists[0].select("query", "doc", "rank")
    for more in lists[1:]:
        both = both.unionByName(more.select("query", "doc", "rank"))
    return top_k(both.groupBy("query", "doc").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 6).alias("score")), k)


def recall(expected: Column, retrieved: Column, k: int) -> Column:
    wanted = F.array_distinct(expected)
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(wanted, F.slice(retrieved, 1, k))) / F.size(wanted))


def hit_rate(expected: Column, retrieved: Column, k: int) -> Column:
    return F.coalesce(F.arrays_overlap(expected, F.slice(retrieved, 1, k)), F.lit(False)).cast("double")


def ranks_of_hits(expected: Column, retrieved: Column) -> Column:
    return F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(expected, x), i + 1)), lambda r: r.isNotNull())


def reciprocal_rank(expected: Column, retrieved: Column) -> Column:
    return F.coalesce(1.0 / F.array_min(ranks_of_hits(expected, retrieved)), F.lit(0.0))


def average_precision(expected: Column, retrieved: Column) -> Column:
    """Sum of precision at each hit over the number of expected ids; an id retrieved twice counts twice."""
    total = F.aggregate(F.transform(ranks_of_hits(expected, retrieved), lambda r, i: (i + 1).cast("double") / r), F.lit(0.0), lambda s, x: s + x)
    n = F.size(F.array_distinct(expected))
    return F.when(n == 0, 0.0).otherwise(total / n)


def first_ranks(expected: Column, retrieved: Column) -> Column:
    """1-based rank of each expected id, -1 when it is missing."""
    return F.transform(expected, lambda x: F.when(F.array_contains(retrieved, x), F.array_position(retrieved, x)).otherwise(F.lit(-1).cast("long")))


def ranked_metrics(hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """Metrics of each query from the ranks of its hits, (query, rank) rows, and its number of relevant documents, (query, n_expected). No list of relevant documents is held."""
    ranks = hits.groupBy("query").agg(F.sort_array(F.collect_set("rank")).alias("ranks"))
    j = sizes.join(ranks, "query", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))
    n = F.col("n_expected")

    def recall_at(k: int) -> Column:
        return F.when(n == 0, 0.0).otherwise(F.size(F.filter("ranks", lambda r: r <= k)) / n).alias(f"recall_{k}")

    precision = F.aggregate(F.transform("ranks", lambda r, i: (i + 1).cast("double") / r), F.lit(0.0), lambda s, x: s + x)
    first = F.get("ranks", F.lit(0))
    return j.select("query", "n_expected", *map(recall_at, (5, 10, 20)), F.coalesce((first == 1).cast("double"), F.lit(0.0)).alias("hit_1"), F.coalesce(1.0 / first, F.lit(0.0)).alias("mrr"), F.when(n == 0, 0.0).otherwise(precision / n).alias("ap"))


def p95(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, p95): the value at the floor of 0.95 * (n - 1) in order. Values are counted first, so what a window sorts is the distinct ones."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(by).orderBy(value))
    total = F.sum("n").over(Window.partitionBy(by))
    reached = counts.select(by, value, upto.alias("upto"), total.alias("total")).where(F.col("upto") > F.floor(0.95 * (F.col("total") - 1)))
    return reached.groupBy(by).agg(F.min(value).alias("p95"))


def outcomes(rows: DataFrame, by: str, failed: Column, value: str) -> DataFrame:
    """(by, n, n_ok, n_failed, mean): calls that went well and that failed, and the mean of ``value`` over those that went well; a status that isn't known counts as a failure."""
    bad = F.coalesce(failed, F.lit(True))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(~bad).alias("n_ok"), F.count_if(bad).alias("n_failed"), F.avg(F.when(~bad, F.col(value))).alias("mean"))


def drift_warning(drifted: Column, n: Column) -> Column:
    """Whether so many entries have drifted that an evaluation may mislead."""
    return drifted > F.greatest(F.lit(1), F.floor(n / 10))


def run_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(key, a, b) of the metadata in which two runs (one row each) differ, of the keys by which runs are comparable."""
    one, two = (x.select(*(F.col(k).cast("string").alias(k) for k in keys)).unpivot([], keys, "key", name) for x, name in ((a, "a"), (b, "b")))
    return one.join(two, "key").where(~F.col("a").eqNullSafe(F.col("b")))


def size_status(n: Column) -> Column:
    return F.when(n < 30, "indicative").when(n < 100, "preliminary").otherwise("reportable")


def near_pairs(rows: DataFrame, threshold: float, others: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, score) of one label whose vectors (id, label, vector) are alike: a < b in ``rows``, or a in ``others`` and b in ``rows``.

    Exact, in blocks: pairs of blocks whose centres are too far apart for their
    radii are passed over, the others are one matrix product each.
    """
    blocks = written(vector_blocks(rows.select("id", F.col("label").alias("grp"), "vector")), "blocks")
    against = blocks if others is None else vector_blocks(others.select("id", F.col("label").alias("grp"), "vector"))
    y = against.select("grp", *(F.col(c).alias(f"{c}_b") for c in ("first", "ids", "vectors", "centre", "radius")))
    pairs, within = blocks.join(y, "grp"), others is None
    if within:
        pairs = pairs.where("first <= first_b")

    def run(batches):
        for batch in batches:
            own, radii = (batch.select(names).to_pydict() for names in (["first", "first_b"], ["radius", "radius_b"]))
            for n, (ids, ids_b, m, m_b, c, c_b) in enumerate(each_row(batch.select(["ids", "ids_b", "vectors", "vectors_b", "centre", "centre_b"]))):
                apart = np.arccos(np.clip(np.frombuffer(c) @ np.frombuffer(c_b), -1, 1)) - radii["radius"][n] - radii["radius_b"][n]
                if apart > 0 and np.cos(min(apart, np.pi)) < threshold - 1e-6:
                    continue
                scores = np.round(np.frombuffer(m).reshape(len(ids), -1) @ np.frombuffer(m_b).reshape(len(ids_b), -1).T, 6)
                i, j = np.nonzero(scores >= threshold)
                x, y, s = ids[i], ids_b[j], scores[i, j]
                if within and own["first"][n] == own["first_b"][n]:
                    once = x < y
                    x, y, s = x[once], y[once], s[once]
                a, b = (np.minimum(x, y), np.maximum(x, y)) if within else (y, x)
                for at in range(0, len(s), PART):
                    yield pa.RecordBatch.from_arrays([pa.array(v[at : at + PART]) for v in (a, b, s)], ["a", "b", "score"])

    both = pairs.select("first", "first_b", "ids", "ids_b", "vectors", "vectors_b", "centre", "centre_b", "radius", "radius_b")
    return written_in_small_batches(both.mapInArrow(run, "a long, b long, score double"), "near", FEW)


def greedy_unlike(rows: DataFrame, threshold: float, baseline: DataFrame | None = None) -> DataFrame:
    """Rows (id, label, vector) kept when, in the order of id within their label, neither the baseline nor any kept before is as alike as ``threshold``.

    The pairs that are alike are found in blocks; only these are gone through. In
    each round the rows that no undecided earlier row is like are kept and what is
    like them goes, so rounds are as many as the longest chain of such rows.
    """
    if baseline is not None:
        known = near_pairs(rows, threshold, baseline).select(F.col("b").alias("id")).distinct()
        rows = written(rows.join(known, "id", "left_anti"), "unlike")
    edges = near_pairs(rows, threshold).select("a", "b")
    gone = edges.select(F.col("b").alias("id")).limit(0)
    while not edges.isEmpty():
        free = edges.select(F.col("a").alias("id")).distinct().join(edges.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        now = written(edges.join(free.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id")).distinct(), "gone")
        gone = gone.unionByName(now)
        left = edges.join(now.withColumnRenamed("id", "a"), "a", "left_anti").join(now.withColumnRenamed("id", "b"), "b", "left_anti")
        edges = written(left.join(free.withColumnRenamed("id", "a"), "a", "left_anti").select("a", "b"), "alike")
    return rows.join(gone, "id", "left_anti").select("id", "label")
