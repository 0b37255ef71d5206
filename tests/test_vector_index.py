"""Exact search in cells against brute force, and the approximate index's recall."""

import numpy as np
import pyarrow as pa
import pytest

from sedimark.operators import retrieval, vector_index
from sedimark.operators.scratch import written_in_small_batches
from sedimark.plans import inputs, queries


def brute(queries, corpus, k):
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-300) for i, v in corpus}
    out = set()
    for q, v in queries:
        v = np.array(v) / max(np.linalg.norm(v), 1e-300)
        scored = sorted((-round(float(v @ x), 6) + 0.0, i) for i, x in unit.items() if i != q)
        out |= {(q, i, round(-s, 6) + 0.0, n + 1) for n, (s, i) in enumerate(scored[:k])}
    return out


def frame(spark, rows, name):
    return spark.createDataFrame([(i, v) for i, v in rows], f"{name} long, vector array<double>")


def clustered(n, d, groups, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d)) * 5
    return [(i, np.round(centres[i % groups] + rng.normal(size=d) * 0.3, 3).tolist()) for i in range(n)]


def as_set(df):
    return {(r.query, r.doc, round(r.score, 6) + 0.0, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("d", [2, 8])
def test_knn_equals_brute_force(spark, d):
    corpus = clustered(400, d, 7, d)
    corpus += [(1000 + i, corpus[3][1]) for i in range(60)] + [(2000 + i, [0.0] * d) for i in range(5)]
    asked = corpus[::37] + [(2000, [0.0] * d), (-1, [1.0] + [0.0] * (d - 1))]
    got = as_set(vector_index.knn(frame(spark, asked, "query"), frame(spark, corpus, "doc"), 6))
    assert got == brute(asked, corpus, 6)


def test_knn_of_few_or_no_rows(spark):
    corpus = clustered(3, 4, 2, 1)
    assert as_set(vector_index.knn(frame(spark, corpus, "query"), frame(spark, corpus, "doc"), 6)) == brute(corpus, corpus, 6)
    none = frame(spark, [], "doc")
    assert vector_index.knn(frame(spark, corpus, "query"), none, 3).count() == 0
    assert vector_index.build(none) is None


def test_index_finds_nearly_all_of_clustered_vectors_in_few_cells(spark):
    corpus = clustered(2000, 16, 40, 3)
    index = vector_index.build(frame(spark, corpus, "doc"))
    assert index.probes <= len(index.quantiser.cells.centres) // 2
    asked = corpus[::50]
    found = as_set(vector_index.search(index, frame(spark, asked, "query"), 10))
    true = brute(asked, corpus, 10)
    assert len({x[:2] for x in found} & {x[:2] for x in true}) >= 0.9 * len(true)
    assert spark.read.parquet(index.vectors).count() == sum(len(r.ids) for r in spark.read.parquet(index.codes).collect()) == 2000


def test_ann_topk_has_the_recall_that_it_states_and_no_cross_join(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.ann_topk(spark, sf)
    true = retrieval.knn(*inputs.vectors(spark, sf), 10)
    assert vector_index.recall(found, true).head().recall >= 0.9
    for df in (found, true):
        assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("NestedLoop", "Cartesian"))


def test_blocks_come_to_python_few_at_a_time(spark, monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array([[1, 2], [3]], pa.list_(pa.int64())), pa.array([b"ab", b"c"], pa.binary())], ["ids", "block"])
    rows = list(vector_index.each_row(batch))
    assert [(ids.tolist(), bytes(block)) for ids, block in rows] == [([1, 2], b"ab"), ([3], b"c")]
    given = []
    monkeypatch.setattr(retrieval, "written_in_small_batches", lambda df, name, n: given.append(n) or written_in_small_batches(df, name, n))
    vectors = spark.createDataFrame([(i, 1, [float(i % 3 == k) for k in range(3)]) for i in range(9)], "id long, label int, vector array<double>")
    assert {(r.a, r.b) for r in retrieval.near_pairs(vectors, 0.9).collect()} == {(a, b) for a in range(9) for b in range(a + 1, 9) if a % 3 == b % 3}
    assert given == [vector_index.FEW]
