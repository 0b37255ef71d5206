"""Question synthesis, models, entries and their changes, streams that report."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sedimark.operators import chunks
from sedimark.operators import curation as C
from sedimark.operators import models as Mo
from sedimark.operators import retrieval as R
from sedimark.operators import synthesis as Y
from sedimark.streaming import events as S

ELEMENTS = "slug string, ordinal long, element_id string, element_type string, page_number int, content string"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Das ist ein Satz. Hier ist noch einer!", ["Das ist ein Satz.", "Hier ist noch einer!"]),
        ("Siehe Abb. 3 und z. B. Tab. 4. Danach geht es weiter.", ["Siehe Abb. 3 und z. B. Tab. 4.", "Danach geht es weiter."]),
        ("Am 3. Mai kam Dr. Müller. Er blieb.", ["Am 3. Mai kam Dr. Müller.", "Er blieb."]),
        ("Was? Ja! „So.“ Ende", ["Was?", "Ja!", "„So.“", "Ende"]),
        ("  \n ", []),
        ("ohne Ende", ["ohne Ende"]),
    ],
)
def test_sentences(text, want):
    assert Y.split_sentences(text) == want


def elements(spark):
    rows = [("d", 0, "p1-a", "paragraph", 1, "Eins ist da. Zwei auch."), ("d", 1, "p1-b", "table", 1, "h1 | h2\n\na | b\nc | d"), ("d", 2, "p1-c", "table", 1, "only header"), ("d", 3, "p1-d", "list_item", 1, "- x\n* y\n3. z\n\n"), ("d", 4, "p2-e", "heading", 2, "Title"), ("d", 5, "p2-f", "paragraph", 2, " ")]
    return spark.createDataFrame(rows, ELEMENTS)


def test_sub_units(spark):
    got = {r.element_id: r.u for r in elements(spark).select("element_id", Y.sub_units(F.col("element_type"), F.col("content")).alias("u")).collect()}
    assert got == {"p1-a": ["Eins ist da.", "Zwei auch."], "p1-b": ["h1 | h2\na | b", "h1 | h2\nc | d"], "p1-c": [], "p1-d": ["x", "y", "z"], "p2-e": [], "p2-f": []}


def test_selection_and_start(spark):
    e = elements(spark)
    assert [r.ordinal for r in Y.selection(e, "p1-c", 2).orderBy("ordinal").collect()] == [2, 3]
    assert Y.selection(e, "nowhere").count() == 0
    assert (Y.start_position(e), Y.start_position(e, "p1-c"), Y.start_position(e, "p2"), Y.start_position(e, cached="gone"), Y.start_position(e, cached="p1-d")) == (0, 2, 4, 0, 3)
    with pytest.raises(ValueError, match="p9"):
        Y.start_position(e, "p9")
    templates = spark.createDataFrame([("table_row", "v1", "T {content}"), ("table_row", "v2", "no place")], "name string, version string, template string")
    assert Y.templates(templates, "v1").count() == 1
    with pytest.raises(ValueError, match="table_row"):
        Y.templates(templates, "v2")


CALLS = []


def echo(prompts):
    return [json.dumps({"questions": [{"sub_unit": line[:1], "question": f"about {line[3:]}?"} for line in p.split("\n")[1:] for _ in range(2)]}) if "fail" not in p else "{" for p in prompts]


Mo.register(Mo.Model("echo", lambda: echo))


def test_a_run_of_synthesis(spark):
    named = spark.createDataFrame([("table_row", "Ask\n{content}"), ("paragraph", "Ask\n{content}")], "name string, template string")
    more = spark.createDataFrame([("d", 6, "p3-g", "paragraph", 3, "Das fail geht nicht. Nie."), ("d", 7, "p3-h", "paragraph", 3, "Alt ist es.")], ELEMENTS)
    before = spark.createDataFrame([("h",)], "bare_id string")
    asked = Y.prompts(elements(spark).unionByName(more), named, before, most_tokens=6)
    rows = asked.collect()
    assert {r.element_id: r.skipped for r in rows if r.skipped} == {"p1-c": "no_sub_units", "p1-d": "no_template", "p2-e": "no_sub_units", "p2-f": "no_sub_units", "p3-h": "resume_skip"}
    assert {(r.element_id, r.call): r.prompt for r in rows if r.element_id == "p1-a"} == {("p1-a", 0): "Ask\n0. Eins ist da.", ("p1-a", 1): "Ask\n0. Zwei auch."}
    answered = Y.answers(asked, "echo")
    made = Y.questions(answered)
    assert made.where("element_id = 'p3-g'").count() == 2 and made.where("element_id = 'p1-a'").count() == 4  # one prompt of g can't be read
    unlike = Y.kept(made, most=100)
    old = spark.createDataFrame([("d", "a", "about Zwei auch.?")], "slug string, bare_id string, question string")
    capped = Y.kept(made, existing=old, most=1)
    assert sorted(r.question for r in capped.where("bare_id = 'a'").collect()) == ["about Eins ist da.?"]
    assert Y.kept(made, embed=None, most=100).count() == made.count()
    (s,) = Y.summary(asked, made, unlike, Y.kept(made, most=1)).collect()
    assert (s.elements_seen, s.elements_skipped, s.questions_generated) == (8, 5, made.count()) and s.questions_kept == s.elements_with_questions == 3
    assert s.questions_dropped_dedup + s.questions_dropped_cap + s.questions_kept == s.questions_generated and s.questions_dropped_dedup >= 5
    events = Y.events(capped, '{"kind": "llm", "model": "echo"}', "2026-01-01T00:00:00Z")
    payload = json.loads(events.where("entry_id is not null").first().payload)
    assert payload["notes"] is None and payload["entry_data"]["refines"] is None and payload["actor"]["model"] == "echo" and payload["entry_data"]["source_element"]["document_id"] == "d"
    assert Y.existing_questions(events, "a").count() == 1


class Failure(Exception):
    def __init__(self, status_code):
        self.status_code = status_code


def test_retries():
    waits = []

    def failing(codes):
        left = list(codes)

        def call():
            if left:
                raise Failure(left.pop(0))
            return "done"

        return call

    assert Mo.with_retry(failing([429, 503]), sleep=waits.append)() == "done" and len(waits) == 2 and all(0 <= w <= 10 for w in waits)
    with pytest.raises(Mo.ServerFailed):
        Mo.with_retry(failing([500] * 3), sleep=waits.append)()
    for status, kind in ((401, Mo.ModelError), (400, Failure)):
        with pytest.raises(kind):
            Mo.with_retry(failing([status]), sleep=waits.append)()
    assert len(waits) == 4


def test_models_over_rows(spark, tmp_path):
    marks = str(tmp_path / "marks")

    def start():
        with open(marks, "a") as f:
            f.write("start ")
        return lambda texts: [t.upper() for t in texts]

    def stop():
        with open(marks, "a") as f:
            f.write("stop ")

    Mo.register(Mo.Model("upper", start, stop))
    df = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)
    assert {r.u for r in Mo.apply(df, "upper", "t", "u", "string", batch=1).collect()} == {"A", "B"} and open(marks).read() == "start stop "
    assert [r.type for r in Mo.lifecycle(df, "upper", "t").collect()] == ["model-loading", "model-loaded", "work-progress", "work-complete", "model-unloading", "model-unloaded"]
    answer, seconds = Mo.ping("upper", "a")
    assert answer == "A" and seconds >= 0
    told = Mo.reported(df, "upper", "t", str(tmp_path / "told"))
    assert told.where("memory_mb > 1").count() == told.count() == 6 and told.where("error is not null").count() == 0

    def fail(texts):
        raise RuntimeError("no answer")

    Mo.register(Mo.Model("failing", lambda: fail))
    with pytest.raises(Mo.ModelError, match="RuntimeError: no answer"):
        Mo.reported(df, "failing", "t", str(tmp_path / "failed"))
    assert [r.type for r in spark.read.parquet(str(tmp_path / "failed")).collect()] == ["model-loading", "model-loaded", "work-failed", "model-unloading", "model-unloaded"]
    with pytest.raises(RuntimeError, match="no answer"):
        Mo.ping("failing")
    with pytest.raises(KeyError, match="nobody"):
        Mo.model("nobody")
    assert Mo.chosen({}).name == "hashing" and Mo.chosen({"SEDIMARK_MODEL": "upper"}).name == "upper"
    v = df.select(Mo.letters(F.col("t")).alias("l"), Mo.hashing_embedding("t").alias("h")).first()
    assert v.l[0] == 1.0 and len(v.l) == 26 and sum(x * x for x in v.h) == pytest.approx(1)

    class Words:
        encode, decode = staticmethod(str.split), staticmethod(" ".join)

    assert [r.t for r in Mo.truncated(spark.createDataFrame([("a b c",), ("a",), (None,)], "t string"), "t", Words, 2).collect()] == ["a b", "a", None]


def test_truncation_with_a_vocabulary(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder, texts = Mo.Vocabulary(path), [None, "", "short", "x" * 40, "some words about rivers " * 50, "é漢字" * 30, " " * 2000 + "end"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for most in (1, 7, 60):
        want = {i: t if t is None or len(coder.encode(t)) <= most else coder.decode(coder.encode(t)[:most]) for i, t in enumerate(texts)}
        for least in (0, 1):
            assert {r.i: r.t for r in Mo.truncated(df, "t", lambda: Mo.Vocabulary(path), most, least).collect()} == want


def test_strictness_answers_and_outcomes(spark):
    hits = spark.createDataFrame([(1, 10, 10.0, 1), (1, 11, 4.0, 2), (1, 12, 3.9, 3), (2, 10, 0.0, 1)], "query long, doc long, score double, rank int")
    assert sorted((r.query, r.doc) for r in R.strict(hits, 3).collect()) == [(1, 10), (1, 11), (2, 10)]
    assert R.strict(hits, 1).count() == 4 and R.strict(hits, 5).count() == 2
    for bad in (0, 6):
        with pytest.raises(ValueError, match="strictness"):
            R.strict(hits, bad)
    Mo.register(Mo.Model("last-line", lambda: lambda prompts: [p.rsplit("\n", 1)[1].upper() for p in prompts]))
    docs = spark.createDataFrame([(10, "ten"), (11, "eleven"), (12, "twelve")], "doc long, text string")
    got = R.answered(R.contexts(hits, docs), spark.createDataFrame([(1, "why?"), (2, "how?"), (3, "who?")], "query long, text string"), "last-line")
    assert {r.query: (r.answer, r.citations) for r in got.collect()} == {1: ("WHY?", {10: 10.0, 11: 4.0, 12: 3.9}), 2: ("HOW?", {10: 0.0})}
    calls = spark.createDataFrame([("a", False, 1.0), ("a", True, 9.0), ("a", None, 9.0), ("a", False, 3.0), ("b", True, 2.0)], "k string, bad boolean, v double")
    assert {r.k: tuple(r)[1:] for r in R.outcomes(calls, "k", F.col("bad"), "v").collect()} == {"a": (4, 2, 2, 2.0), "b": (1, 0, 1, None)}


def test_samples_of_ranked_rows(spark):
    rows = spark.createDataFrame([(i, float(i % 50)) for i in range(500)], "id long, score double")
    best = {i for _, i in sorted((-float(i % 50), i) for i in range(500))[:100]}
    drawn = [r.id for r in chunks.seeded_sample(rows, 20, 3, "id", [F.desc("score")]).collect()]
    assert len(set(drawn)) == 20 and set(drawn) <= best
    assert drawn == [i for _, i in sorted((hashlib.md5(f"3:{i}".encode()).hexdigest(), i) for i in best)][:20]
    assert len({r.id for r in chunks.seeded_sample(rows, 200, 3, "id", [F.desc("score")]).collect()}) == 200
    with pytest.raises(ValueError, match="positive"):
        chunks.seeded_sample(rows, 0, 3, "id")


def test_texts_are_embedded_once(spark, tmp_path):
    marks = tmp_path / "marks"

    def call(texts):
        with open(marks, "a") as f:
            f.write("".join(texts))
        return [[float(len(t))] for t in texts]

    Mo.register(Mo.Model("lengths", lambda: call))
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "i int, t string")
    for more in (df, df.union(spark.createDataFrame([(5, "ccc")], "i int, t string"))):
        got = {r.i: r.vector for r in Mo.embedded(more, "lengths", "t", str(tmp_path / "store")).collect()}
    assert got == {1: [1.0], 2: [2.0], 3: [1.0], 4: None, 5: [3.0]} and sorted(marks.read_text()) == list("abbccc")


def test_entry_changes(spark):
    state = spark.createDataFrame([("r1", False, "b"), ("r1", True, "c"), ("r2", True, "a")], "entry_id string, deprecated boolean, slug string")
    asked = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "entry_id string").withColumn("query", F.lit("q")).withColumn("chunk_hashes", F.create_map(F.lit("c1"), F.lit("h"))).withColumn("reason", F.lit(None).cast("string"))
    rows = C.refine(state, asked, '{"kind": "human"}', "2026-01-01T00:00:00Z")
    got = rows.collect()
    assert {r.asked: r.error for r in got if r.error} == {"r2": "Deprecated", "r3": "NotFound"}
    new, old = sorted((r for r in got if not r.error), key=lambda r: r.event_type)
    assert (new.slug, old.entry_id, new.timestamp_utc) == ("b", "r1", old.timestamp_utc) and json.loads(new.payload)["entry_data"] == {"query": "q", "expected_chunk_ids": ["c1"], "chunk_hashes": {"c1": "h"}, "refines": "r1"}
    assert json.loads(old.payload) == {"actor": {"kind": "human"}, "reason": None}
    with pytest.raises(C.Deprecated, match="r2"):
        C.raise_errors(rows)
    with pytest.raises(C.NotFound, match="r3"):
        C.raise_errors(rows.where("asked <> 'r2'"))
    assert C.raise_errors(rows.where("asked = 'r1'")).count() == 2
    made = C.created(spark.createDataFrame([("d", "e", "paragraph", 1, "q?", "me", "phd")], "slug string, bare_id string, element_type string, page_number int, query string, pseudonym string, level string"), "2026-01-01T00:00:00Z")
    assert json.loads(made.first().payload)["entry_data"]["source_element"]["element_id"] == "e"


def test_lookups(spark):
    rows = spark.createDataFrame([("a", "O'Neil"), ("b", "x")], "slug string, source string")
    assert C.only(rows, "slug", "a").source == "O'Neil"
    with pytest.raises(C.NotFound):
        C.only(rows, "slug", "z")
    assert C.filtered(rows, "source eq 'O''Neil'").count() == 1 and C.filtered(rows, None).count() == 2
    for bad in ("source eq 'a' or 1 eq '1'", "nothing eq 'a'", "source ne 'x'"):
        with pytest.raises(ValueError):
            C.filtered(rows, bad)
    assert C.one_slug(rows.limit(0), "given") == "given" and C.one_slug(rows.where("slug = 'a'")) == "a"
    for few in (rows, rows.limit(0)):
        with pytest.raises(ValueError):
            C.one_slug(few)
    actors = spark.createDataFrame([('{"kind":"human","pseudonym":"p","level":"phd"}',), ('{"kind":"llm","model":"m","temperature":0.5}',), ('{"kind":"cat"}',)], "a string")
    assert [r.x and (r.x.kind, r.x.name, r.x.level, r.x.temperature) for r in actors.select(C.actor(F.col("a")).alias("x")).collect()] == [("human", "p", "phd", None), ("llm", "m", None, 0.5), None]


def test_curators_and_documents(spark):
    none = spark.createDataFrame([], "curator_id string, name string, token_sha256 string, assigned_slugs array<string>, active boolean")
    people = C.create_curators(none, spark.createDataFrame([("Ann", "t1"), ("Bob", "t2")], "name string, token string"))
    assert "token_sha256" not in C.public(people).columns and C.create_curators(people, spark.createDataFrame([("Ann", "t1")], "name string, token string")).count() == 2
    ann = people.where("name = 'Ann'").first().curator_id
    pairs = spark.createDataFrame([(ann, "d2"), (ann, "d1")], "curator_id string, slug string")
    some = C.assign(C.assign(people, pairs), pairs.where("slug = 'd1'"))
    assert C.only(some, "name", "Ann").assigned_slugs == ["d1", "d2"] and C.curators_of(some, "d2").count() == 1
    assert C.only(C.assign(some, pairs.where("slug = 'd1'"), remove=True), "name", "Ann").assigned_slugs == ["d2"]
    assert C.revoke(some, pairs).count() == 1
    docs = spark.createDataFrame([("d1", "raw", "t0"), ("d2", "raw", "t0")], "slug string, status string, last_touched_utc string")
    changes = spark.createDataFrame([("d1", "archived", 2), ("d1", "open-for-curation", 1), ("d9", "raw", 1)], "slug string, status string, ordinal int")
    moved = C.transition(docs, changes, "t1")
    assert {tuple(r) for r in moved.collect()} == {("d1", "archived", "t1"), ("d2", "raw", "t0")} and [r.slug for r in C.unknown(changes, docs, "slug").collect()] == ["d9"]
    opened = C.transition(docs, changes.where("ordinal = 1"), "t1")
    assert [tuple(r) for r in C.visible_documents(some, opened).select("place", "slug").collect()] == [(0, "d1")]
    asked = spark.createDataFrame([("d1", "e1", "c", "q", "now"), ("d1", "gone", "c", "q", "now")], "slug string, element_id string, curator_id string, query string, created_at string")
    empty = spark.createDataFrame([], "question_id string, slug string, element_id string, curator_id string, query string, created_at string")
    q = C.add_questions(empty, asked, spark.createDataFrame([("d1", "e1")], "slug string, element_id string"))
    refined = C.patch(q, "question_id", q.select("question_id", F.lit("better").alias("refined_query"), F.lit(True).alias("deprecated")))
    assert [(r.query, r.refined_query, r.deprecated) for r in refined.collect()] == [("q", "better", True)]
    shown = C.curator_elements(spark.createDataFrame([("b", None, None, None)], "box_id string, kind string, page int, text string"))
    assert tuple(shown.first()) == ("b", "paragraph", 1, "")


def test_a_failing_stream_says_so(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"slug": "d", "element_id": "e"}')
    out = str(tmp_path / "out")

    def work(batch):
        raise ValueError("no luck")

    q = S.process(S.read_lines(spark, str(tmp_path / "in"), "slug string, element_id string"), work, out, str(tmp_path / "cp"))
    with pytest.raises(Exception, match="no luck"):
        q.awaitTermination(120)
    assert sorted((r.type, r.message) for r in spark.read.parquet(out).collect()) == [("error", "no luck"), ("start", None)]


def test_abbreviations_are_learnt_from_their_stops(spark):
    texts = ["Siehe Abs. 3 und Abs. 4. Das Haus steht. Ein Haus brennt, das Haus.", "Der Abs. 5 gilt. Das Haus steht dort. Nach Abs. 6 steht es.", "Dort steht es und gilt, wie es dort steht: es gilt dort"] * 20
    docs = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string")
    rows = {r.word: r for r in Y.stop_scores(docs).collect()}
    assert (rows["Abs"].n, rows["Abs"].n_stop) == (80, 80) and (rows["Haus"].n, rows["Haus"].n_stop) == (80, 20)
    found = {r.word for r in Y.abbreviations(docs).collect()}
    assert "Abs" in found and not found & {"Haus", "steht", "es"}
    text = spark.createDataFrame([("Nach Abs. Vier gilt es. Ende.",)], "text string")
    units = lambda more: text.select(Y.sentences(F.col("text"), more)).first()[0]
    assert units(frozenset(found)) == ["Nach Abs. Vier gilt es.", "Ende."]
    assert Y.split_sentences("Nach Xyz. Vier gilt.") == ["Nach Xyz.", "Vier gilt."] and Y.split_sentences("Nach Xyz. Vier gilt.", frozenset({"Xyz"})) == ["Nach Xyz. Vier gilt."]
    assert Y.stop_scores(docs.limit(0)).count() == 0


def test_a_table_s_lines_are_made_once(spark):
    from sedimark.operators import synthesis

    rows = spark.createDataFrame([("head\n\na\n b",), ("head",), ("",), (None,)], "c string").select(synthesis.table_units(F.col("c")).alias("u"))
    assert [r.u for r in rows.collect()] == [["head\na", "head\n b"], [], [], None]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
