"""Filters of a search: precedence, literals, nulls, errors, push-down."""

import re

import pytest

from sedimark.operators.filters import FilterError, condition

ROWS = [(1, "a", 3, True), (2, "b'c", 5, False), (3, None, 7, None), (4, "or", None, True)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id int, s string, n int, ok boolean")


@pytest.mark.parametrize("text, ids", [
    (None, [1, 2, 3, 4]), ("  ", [1, 2, 3, 4]), ("s eq 'b''c'", [2]), ("s eq 'or' or s eq 'a' and n gt 3", [4]), ("(s eq 'or' or s eq 'a') and n eq 3", [1]),
    ("not ok", [2, 3]), ("ok", [1, 4]), ("ok eq false", [2]), ("s eq null", [3]), ("n ne null", [1, 2, 3]), ("s ne 'a'", [2, 3, 4]), ("not s eq 'a' and n ge 5", [2, 3]),
    ("id in (1, 3,9)", [1, 3]), ("s in ('a', null)", [1, 3]), ("n le 5.5 and n gt -1e1", [1, 2]), ("not (n lt 6)", [3, 4]), ("not not ok", [1, 4]), ("id gt 1 and id lt 4 or id eq 1", [1, 2, 3]),
])
def test_conditions(table, text, ids):
    assert sorted(r.id for r in table.where(condition(text, table.columns)).collect()) == ids


@pytest.mark.parametrize("text", ["s eq", "s eq 'a", "eq 'a'", "nosuch eq 1", "(id eq 1", "id eq 1)", "id eq 1 s eq 'a'", "id = 1", "n gt null", "id in ()", "id in (1", "s eq a", "1 eq id", "not", "id; drop"])
def test_errors(table, text):
    with pytest.raises(FilterError):
        condition(text, table.columns)


def test_fields_of_structures_and_push_down(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, ("x", 2)), (2, ("y", 3))], "id int, m struct<k:string,v:int>").write.parquet(path)
    t = spark.read.parquet(path)
    found = t.where(condition("m/k eq 'y' and id ge 2", t.columns))
    assert [r.id for r in found.collect()] == [2]
    assert "GreaterThanOrEqual(id,2)" in found._jdf.queryExecution().executedPlan().toString()


def test_scores_do_not_cross_a_shuffle(spark):
    """A task hands on each query's best alone: what is shuffled is texts, not their words or the pairs of queries and documents."""
    from sedimark.operators import retrieval as R
    from sedimark.operators.scratch import written

    queries = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, None)], "query long, text string")
    docs = spark.createDataFrame([(n, " ".join(["alpha"] * (n % 3) + ["beta"] * (n % 5) + ["delta"])) for n in range(200)] + [(900, None)], "doc long, text string")
    queries, docs = written(queries, "queries"), written(docs, "docs")
    for found in (R.bm25(queries, docs, 3), R.bm25f(queries, docs, 3, {"text": 1.0})):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(query" in plan
        assert not re.search(r"hashpartitioning\(query#\d+L?, doc", plan)
        assert sorted({r.query for r in found.collect()}) == [1, 2]


def test_small_batches_reach_python(spark):
    from sedimark.operators.scratch import written_in_small_batches

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    told = [r.n for r in written_in_small_batches(spark.range(0, 1000, 1, 1).mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(told) == 1000 and max(told) == 200 and spark.conf.get(key) == before
