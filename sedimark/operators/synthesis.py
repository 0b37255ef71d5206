"""Questions made from elements: sub-units, prompts within a budget, answers read, near duplicates and caps, events and a summary.

Elements are (slug, ordinal, element_id, element_type, page_number, content). Every
step is a DataFrame; the model is a plug-in (``models``), called in batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from sedimark.functions import text as T
from sedimark.operators import models, retrieval
from sedimark.operators.scratch import written, written_in_small_batches

#: Abbreviations after which a German sentence goes on.
ABBREVIATIONS = "Abb Abs Bd Dr Fr Hr Jh Kap Nr Prof S Str Tab bzw ca etc evtl f ff ggf gem inkl max min o sog u usw vgl z zzgl".split()
_END = re.compile(r"(?<=[.!?…])[\"'»“”)\]]*\s+(?=[\"'«„“(\[]*[A-ZÄÖÜ0-9])")
_INITIAL, _LAST_WORD = re.compile(r"(?:^|[\s(])[A-Za-zÄÖÜäöü]\.$"), re.compile(r"(?:^|[\s(])([^\s(]+)\.$")
_ORDINAL, _MONTH = re.compile(r"(?:^|\s)\d{1,2}\.$"), re.compile("Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember")


def split_sentences(text: str, abbreviations: frozenset[str] = frozenset(ABBREVIATIONS)) -> list[str]:
    """Sentences of a German text: they end at a stop before a capital or a digit, but not after an abbreviation or initial, nor between a day and its month."""
    out, start = [], 0
    for m in _END.finditer(text):
        before = text[start : m.start()].rstrip("\"'»“”)]")
        word = _LAST_WORD.search(before)
        goes_on = _INITIAL.search(before) or (word and word[1] in abbreviations)
        if not goes_on and not (_ORDINAL.search(before) and _MONTH.match(text, m.end())):
            out.append(text[start : m.end()].strip())
            start = m.end()
    out.append(text[start:].strip())
    return [s for s in out if s]


def sentences(c: Column, more: frozenset[str] = frozenset()) -> Column:
    """Sentences of each text; ``more`` are abbreviations beside the fixed ones, such as those that :func:`abbreviations` finds."""
    known = frozenset(ABBREVIATIONS) | more

    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_sentences(t or "", known))

    return run(c)


#: What a word's stops are measured against: the share of stops after an abbreviation, and the score from which a word is one.
STOPS, LEAST_SCORE = 0.99, 0.3


def stop_scores(docs: DataFrame) -> DataFrame:
    """(word, n, n_stop, score) of the words of ``docs`` (text) that a stop follows somewhere.

    score is twice the logarithm of how much likelier the stops of a word are if a
    stop belongs to it (``STOPS`` of the time) than if stops follow words at the rate
    of the corpus; it shrinks with the word's length and with the share of its
    occurrences that have no stop, as abbreviations are short and hardly ever
    stand without. Counts are made inside tasks before they are shuffled by word.
    """
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-zÄÖÜäöüß]+\.?"), 0)).alias("w"))
    stop = F.endswith("w", F.lit("."))
    counts = written(found.groupBy(F.rtrim("w", F.lit(".")).alias("word")).agg(F.count("*").alias("n"), F.count_if(stop).alias("n_stop")), "stops")
    rate = counts.agg((F.sum("n_stop") / F.sum("n")).alias("rate"))  # one row

    def likelihood(p: Column) -> Column:
        return F.col("n_stop") * F.log(p) + (F.col("n") - F.col("n_stop")) * F.log(1 - p)

    # a corpus of nothing but stops, or of none, says nothing
    p = F.least(F.greatest("rate", F.lit(1e-9)), F.lit(1 - 1e-9))
    raw = 2 * (likelihood(F.lit(STOPS)) - likelihood(p))
    length = F.length("word")
    score = raw * F.exp(-length.cast("double")) * F.pow(length.cast("double"), -(F.col("n") - F.col("n_stop")).cast("double"))
    return counts.where("n_stop > 0").crossJoin(F.broadcast(rate)).select("word", "n", "n_stop", score.alias("score"))


def abbreviations(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(word, n, n_stop, score) of the words whose stops are part of them."""
    return stop_scores(docs).where(F.col("score") >= least)


def table_units(c: Column) -> Column:
    """A table's rows, each under its header; none if there is only a header."""
    lines = F.filter(F.split(c, "\n"), lambda x: T.strip(x) != "")

    def under_header(t):
        rows = F.slice(t["lines"], F.lit(2), F.greatest(F.size(t["lines"]) - 1, F.lit(0)))
        return F.transform(rows, lambda r: F.concat(F.get(t["lines"], F.lit(0)), F.lit("\n"), r))

    # an array of one binds the lines, so that they are made once and not for each row
    return F.get(F.transform(F.array(F.struct(lines.alias("lines"))), under_header), F.lit(0))


def list_units(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), T.strip_bullet), lambda x: x != "")


def sub_units(element_type: Column, content: Column) -> Column:
    """What is asked about in an element: sentences of a paragraph, rows of a table, items of a list; nothing of headings and figures."""
    found = F.when(element_type == "paragraph", sentences(F.when(element_type == "paragraph", content))).when(element_type == "table", table_units(content)).when(element_type == "list_item", list_units(content))
    return F.coalesce(found, F.array().cast("array<string>"))


def template_name(element_type: Column) -> Column:
    """The prompt template of a type; null for types that are left out."""
    return F.when(element_type == "table", "table_row").when(element_type.isin("paragraph", "list_item"), element_type)


def templates(rows: DataFrame, version: str) -> DataFrame:
    """(name, template) of one version of (name, version, template) rows; each has to have one place for the content, and a name one row."""
    own = rows.where(F.col("version") == version)
    bad = own.where(F.coalesce(~F.contains("template", F.lit("{content}")), F.lit(True))).select("name").union(own.groupBy("name").count().where("count > 1").select("name"))
    wrong = [r.name for r in bad.distinct().collect()]  # templates are a handful
    if wrong:
        raise ValueError(f"no usable template: {sorted(wrong)}")
    return own.select("name", "template")


def selection(elements: DataFrame, start_from: str | None = None, limit: int | None = None) -> DataFrame:
    """The elements from an exact id on, so many of them at most; an unknown id gives none."""
    if start_from is not None:
        first = elements.where(F.col("element_id") == start_from).agg(F.min("ordinal").alias("first"))
        elements = elements.join(first, F.col("ordinal") >= F.col("first"), "left_semi")
    return elements if limit is None else elements.orderBy("ordinal").limit(limit)


def start_position(elements: DataFrame, explicit: str | None = None, cached: str | None = None) -> int:
    """The ordinal to start from: of an exact id, else of the first that begins so, else an error; a cached id that is gone gives 0."""
    wanted = explicit if explicit is not None else cached
    if wanted is None:
        return 0
    exact, prefix = F.col("element_id") == wanted, F.col("element_id").startswith(wanted)
    found = elements.agg(F.min(F.when(exact, F.col("ordinal"))).alias("exact"), F.min(F.when(prefix, F.col("ordinal"))).alias("prefix")).first()
    if explicit is None:
        return 0 if found.exact is None else found.exact
    if found.exact is None and found.prefix is None:
        raise ValueError(f"no element is called {explicit!r} or begins so")
    return found.prefix if found.exact is None else found.exact


def prompts(elements: DataFrame, named: DataFrame, asked_before: DataFrame | None = None, most_tokens: int = 8000, tokens=models.approximate_tokens) -> DataFrame:
    """A row for each prompt (with its units), and one with the reason for each element that is passed over.

    Reasons are resume_skip (its bare id is in ``asked_before``), no_sub_units and
    no_template. An element whose units together exceed the budget is asked unit by unit.
    """
    rows = elements.withColumn("bare_id", T.bare_element_id(F.col("element_id"))).withColumn("units", sub_units(F.col("element_type"), F.col("content"))).withColumn("name", template_name(F.col("element_type")))
    if asked_before is not None:
        rows = rows.join(asked_before.select("bare_id").distinct().withColumn("before", F.lit(True)), "bare_id", "left")
    else:
        rows = rows.withColumn("before", F.lit(None).cast("boolean"))
    rows = rows.join(named, "name", "left")
    reason = F.when(F.col("before"), "resume_skip").when(F.size("units") == 0, "no_sub_units").when(F.col("template").isNull(), "no_template")
    rows = rows.withColumn("skipped", reason).withColumn("bundled", T.render_prompt(F.col("template"), F.col("units")))
    calls = F.when(F.col("skipped").isNotNull(), F.array(F.lit(None).cast("array<string>"))).when(tokens(F.col("bundled")) > most_tokens, F.transform("units", lambda u: F.array(u))).otherwise(F.array("units"))
    rows = rows.select("slug", "ordinal", "element_id", "bare_id", "element_type", "page_number", "template", "skipped", F.posexplode(calls).alias("call", "asked"))
    prompt = F.when(F.col("skipped").isNull(), T.render_prompt(F.col("template"), F.col("asked")))
    return rows.withColumn("prompt", prompt).withColumn("tokens", F.coalesce(tokens(F.col("prompt")), F.lit(0)).cast("long")).drop("template")


def answers(asked: DataFrame, model: str) -> DataFrame:
    """``asked`` with each prompt's questions. An answer that can't be read is asked for once more; after that the prompt has none."""
    todo = asked.where("prompt is not null")
    first = written_in_small_batches(models.apply(todo, model, "prompt", "raw", "string"), "answers")
    again = first.where(T.parse_questions(F.col("raw")).isNull()).drop("raw")
    good = first.where(T.parse_questions(F.col("raw")).isNotNull())
    both = good.unionByName(written_in_small_batches(models.apply(again, model, "prompt", "raw", "string"), "answers"))
    read = both.withColumn("questions", T.parse_questions(F.col("raw"))).drop("raw")
    passed = asked.where("prompt is null").withColumn("questions", F.lit(None).cast(read.schema["questions"].dataType))
    return read.unionByName(passed)


def questions(answered: DataFrame) -> DataFrame:
    """(id, slug, ordinal, element_id, bare_id, element_type, page_number, question) in the order in which they were made."""
    rows = answered.select("slug", "ordinal", "element_id", "bare_id", "element_type", "page_number", "call", F.posexplode("questions").alias("n", "q"))
    place = F.row_number().over(Window.partitionBy("slug", "element_id").orderBy("call", "n")) - 1
    return rows.select("slug", "ordinal", "element_id", "bare_id", "element_type", "page_number", place.alias("place"), F.col("q.question").alias("question"))


def kept(asked: DataFrame, existing: DataFrame | None = None, embed=models.letters, threshold: float = 0.95, most: int = 20) -> DataFrame:
    """Questions that none of the same element's, neither of ``existing`` (slug, bare_id, question) nor any kept before, is as alike as the threshold; so many an element at most, in order. Without an embedder all pass."""
    if embed is not None:
        # ids in the order of places, one label a source: comparisons stay inside an element
        rows = asked.withColumn("label", F.concat_ws("/", "slug", "bare_id")).repartitionByRange("label", "place").sortWithinPartitions("label", "place")
        rows = written(rows.withColumn("id", F.monotonically_increasing_id()).withColumn("vector", embed(F.col("question"))), "questions")
        before = None if existing is None else existing.select(F.xxhash64("slug", "bare_id", "question").alias("id"), F.concat_ws("/", "slug", "bare_id").alias("label"), embed(F.col("question")).alias("vector"))
        asked = rows.join(retrieval.greedy_unlike(rows.select("id", "label", "vector"), threshold, before).select("id"), "id", "left_semi").drop("id", "label", "vector")
    nth = F.row_number().over(Window.partitionBy("slug", "element_id").orderBy("place"))
    return asked.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def events(kept_questions: DataFrame, actor: str, timestamp: str) -> DataFrame:
    """A 'created' event for each question; ids come from what they name, so a second run makes the same ones. ``actor`` is JSON."""
    key = lambda kind: F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(F.concat_ws("|", F.lit(kind), "slug", "element_id", "question"), 256), 1, 16))
    source = F.struct(F.col("slug").alias("document_id"), "page_number", F.col("bare_id").alias("element_id"), "element_type")
    none = F.lit(None).cast("string")
    entry = F.struct(F.col("question").alias("query"), F.array().cast("array<string>").alias("expected_chunk_ids"), F.create_map().cast("map<string,string>").alias("chunk_hashes"), none.alias("refines"), source.alias("source_element"))
    payload = F.struct(F.lit("retrieval").alias("task_type"), F.parse_json(F.lit(actor)).alias("actor"), F.lit("synthesised").alias("action"), none.alias("notes"), entry.alias("entry_data"))
    return kept_questions.select(key("ev").alias("event_id"), F.lit(timestamp).alias("timestamp_utc"), F.lit("created").alias("event_type"), key("r").alias("entry_id"), F.lit(1).alias("schema_version"), F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"), "slug", "ordinal", "place")


def summary(asked: DataFrame, made: DataFrame, unlike: DataFrame, capped: DataFrame) -> DataFrame:
    """One row a slug: elements seen and skipped, questions generated, kept, dropped as near duplicates and by the cap, and tokens asked."""
    seen = asked.groupBy("slug", "element_id").agg(F.max("skipped").alias("skipped"), F.sum("tokens").alias("tokens"))
    seen = seen.groupBy("slug").agg(F.count("*").alias("elements_seen"), F.count("skipped").alias("elements_skipped"), F.sum("tokens").alias("prompt_tokens_estimated"))
    counts = [x.groupBy("slug").agg(F.count("*").alias(name)) for x, name in ((made, "questions_generated"), (unlike, "unlike"), (capped, "questions_kept"))]
    with_any = capped.groupBy("slug").agg(F.count_distinct("element_id").alias("elements_with_questions"))
    for c in (*counts, with_any):
        seen = seen.join(c, "slug", "left")
    seen = seen.na.fill(0)
    return seen.select("slug", "elements_seen", "elements_skipped", "elements_with_questions", "questions_generated", "questions_kept", (F.col("questions_generated") - F.col("unlike")).alias("questions_dropped_dedup"), (F.col("unlike") - F.col("questions_kept")).alias("questions_dropped_cap"), "prompt_tokens_estimated")


def existing_questions(log: DataFrame, bare_id: str | None = None) -> DataFrame:
    """(slug, bare_id, question) of the 'created' retrieval entries of an event log (slug, event_type, payload as JSON) that name a source element."""
    at = lambda path: F.get_json_object("payload", path)
    rows = log.where("event_type = 'created'").select("slug", at("$.task_type").alias("task"), at("$.entry_data.source_element.element_id").alias("bare_id"), at("$.entry_data.query").alias("question"))
    rows = rows.where("task = 'retrieval' and bare_id is not null and question <> ''").drop("task")
    return rows if bare_id is None else rows.where(F.col("bare_id") == bare_id)
