"""Golden entries, their elements and those who curate them: listings, lookups, and changes with their errors.

Changes of entries are events to be appended (``sources.sinks``); changes of small
tables (documents, curators, questions) give the new table.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from sedimark.operators.events import LEVELS


class NotFound(LookupError):
    pass


class Deprecated(ValueError):
    pass


def only(rows: DataFrame, key: str, value: Any, order: str | None = None) -> Row:
    """The row with a key, the first by ``order`` if there are several; NotFound if there is none."""
    found = rows.where(F.col(key) == value)
    first = (found.orderBy(order) if order else found).limit(1).collect()
    if not first:
        raise NotFound(f"{key}: {value}")
    return first[0]


def maybe(rows: DataFrame, key: str, value: Any, order: str | None = None) -> Row | None:
    """:func:`only`, but None where there is no such row."""
    try:
        return only(rows, key, value, order)
    except NotFound:
        return None


def listing(entries: DataFrame, slug: str | None = None, source_element: str | None = None, with_deprecated: bool = False) -> DataFrame:
    """Entries (slug, source_element, deprecated, ...) of a document or element; deprecated ones on demand."""
    for column, value in (("slug", slug), ("source_element", source_element)):
        if value is not None:
            entries = entries.where(F.col(column) == value)
    return entries if with_deprecated else entries.where(~F.col("deprecated"))


_FILTER = re.compile(r"\s*(\w+)\s+eq\s+'((?:[^']|'')*)'\s*")


def filtered(rows: DataFrame, expression: str | None) -> DataFrame:
    """Rows that pass a search filter of the form ``field eq 'value'``, with quotes doubled inside the value; any other form is an error."""
    if expression is None:
        return rows
    m = _FILTER.fullmatch(expression)
    if not m or m[1] not in rows.columns:
        raise ValueError(f"not a filter on {rows.columns}: {expression!r}")
    return rows.where(F.col(m[1]) == m[2].replace("''", "'"))


def inbox(documents: DataFrame, term: str) -> DataFrame:
    """Documents whose file name or slug holds a term, whatever its case."""
    wanted = F.lit(term.lower())
    return documents.where(F.contains(F.lower("filename"), wanted) | F.contains("slug", wanted))


def one_slug(documents: DataFrame, explicit: str | None = None) -> str:
    """The slug that is asked for, or the only one there is."""
    if explicit is not None:
        return explicit
    found = [r.slug for r in documents.select("slug").distinct().orderBy("slug").limit(6).collect()]
    if len(found) != 1:
        raise ValueError(f"name a document: {', '.join(found[:5])}{', ...' if len(found) > 5 else ''}" if found else "there is no document")
    return found[0]


def shown(snippets: DataFrame, boxes: DataFrame) -> DataFrame:
    """Snippets (page, box_id, ...) without those of discarded boxes."""
    return snippets.join(boxes.where("kind = 'discard'").select("page", "box_id"), ["page", "box_id"], "left_anti")


def element_detail(elements: DataFrame, entries: DataFrame) -> DataFrame:
    """Each element (slug, bare_id, ...) with its active entries (slug, bare_id, entry_id, query) in one array, by entry."""
    own = entries.where(~F.col("deprecated")).groupBy("slug", "bare_id").agg(F.sort_array(F.collect_list(F.struct("entry_id", "query"))).alias("entries"))
    return elements.join(own, ["slug", "bare_id"], "left").withColumn("entries", F.coalesce("entries", F.array().cast("array<struct<entry_id:string,query:string>>")))


def actor(c: Column) -> Column:
    """A human or a model from its JSON, as one wide struct; null for another kind."""
    at = lambda name: F.get_json_object(c, f"$.{name}")
    none = F.lit(None).cast("string")
    human = F.struct(F.lit("human").alias("kind"), at("pseudonym").alias("name"), at("level").alias("level"), none.alias("version"), F.lit(None).cast("double").alias("temperature"))
    model = F.struct(F.lit("llm").alias("kind"), at("model").alias("name"), none.alias("level"), at("model_version").alias("version"), at("temperature").try_cast("double").alias("temperature"))
    return F.when((at("kind") == "human") & at("level").isin(LEVELS), human).when(at("kind") == "llm", model)


# --- changes of entries


def _event(kind: str, entry: Column, payload: Column, timestamp: str) -> Column:
    """Ids come from what the event says, so that a repeated request makes the same event."""
    body = F.to_json(payload, {"ignoreNullFields": "false"})
    key = F.concat(F.lit("ev-"), F.substring(F.sha2(F.concat_ws("|", F.lit(kind), F.lit(timestamp), entry, body), 256), 1, 16))
    return F.struct(key.alias("event_id"), F.lit(timestamp).alias("timestamp_utc"), F.lit(kind).alias("event_type"), entry.alias("entry_id"), F.lit(1).alias("schema_version"), body.alias("payload"))


def checked(state: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (entry_id, ...) with ``slug``, the first log that knows the entry, and ``error``: NotFound, Deprecated or null."""
    first = F.row_number().over(Window.partitionBy("entry_id").orderBy("slug"))
    own = state.withColumn("nth", first).where("nth = 1").select("entry_id", "slug", "deprecated")
    error = F.when(F.col("deprecated").isNull(), "NotFound").when(F.col("deprecated"), "Deprecated")
    return requests.join(own, "entry_id", "left").withColumn("error", error).drop("deprecated")


def refine(state: DataFrame, requests: DataFrame, actor_json: str, timestamp: str) -> DataFrame:
    """(slug, error, entry_id, new_id, event...): for each good request (entry_id, query, chunk_hashes, reason) a 'created' event that refines the entry and, at the same time, the old one's 'deprecated' event; for each bad one a row with its error."""
    rows = checked(state, requests)
    who = F.parse_json(F.lit(actor_json))
    new = F.concat(F.lit("r-"), F.substring(F.sha2(F.concat_ws("|", "entry_id", "query", F.lit(timestamp)), 256), 1, 16))
    entry = F.struct("query", F.map_keys("chunk_hashes").alias("expected_chunk_ids"), "chunk_hashes", F.col("entry_id").alias("refines"))
    created = F.struct(F.lit("retrieval").alias("task_type"), who.alias("actor"), F.lit("created_from_scratch").alias("action"), F.lit(None).cast("string").alias("notes"), entry.alias("entry_data"))
    gone = F.struct(who.alias("actor"), F.col("reason").alias("reason"))
    both = F.array(_event("created", new, created, timestamp), _event("deprecated", F.col("entry_id"), gone, timestamp))
    nothing = F.array(F.lit(None).cast(rows.select(both.alias("b")).schema["b"].dataType.elementType))
    return rows.select("slug", "error", F.col("entry_id").alias("asked"), F.explode(F.when(F.col("error").isNull(), both).otherwise(nothing)).alias("e")).select("slug", "error", "asked", "e.*")


def deprecate(state: DataFrame, requests: DataFrame, actor_json: str, timestamp: str) -> DataFrame:
    """As ``refine``, with the one event of requests (entry_id, reason)."""
    rows = checked(state, requests)
    e = _event("deprecated", F.col("entry_id"), F.struct(F.parse_json(F.lit(actor_json)).alias("actor"), "reason"), timestamp)
    return rows.select("slug", "error", F.col("entry_id").alias("asked"), F.when(F.col("error").isNull(), e).alias("e")).select("slug", "error", "asked", "e.*")


def raise_errors(changes: DataFrame) -> DataFrame:
    """The events alone, once no request is bad; else the first error by entry."""
    bad = changes.where("error is not null").orderBy("asked").select("asked", "error").limit(1).collect()
    if bad:
        raise {"NotFound": NotFound, "Deprecated": Deprecated}[bad[0].error](bad[0].asked)
    return changes.drop("error", "asked")


def created(questions: DataFrame, timestamp: str) -> DataFrame:
    """'created' events of questions that curators asked by hand: (slug, bare_id, element_type, page_number, query, pseudonym, level)."""
    who = F.struct(F.lit("human").alias("kind"), "pseudonym", "level")
    source = F.struct(F.col("slug").alias("document_id"), "page_number", F.col("bare_id").alias("element_id"), "element_type")
    entry = F.struct("query", F.array().cast("array<string>").alias("expected_chunk_ids"), F.create_map().cast("map<string,string>").alias("chunk_hashes"), F.lit(None).cast("string").alias("refines"), source.alias("source_element"))
    payload = F.struct(F.lit("retrieval").alias("task_type"), who.alias("actor"), F.lit("created_from_scratch").alias("action"), F.lit(None).cast("string").alias("notes"), entry.alias("entry_data"))
    key = F.concat(F.lit("r-"), F.substring(F.sha2(F.concat_ws("|", "slug", "bare_id", "query", "pseudonym"), 256), 1, 16))
    return questions.select("slug", _event("created", key, payload, timestamp).alias("e")).select("slug", "e.*")


# --- questions, documents and curators


def patch(table: DataFrame, key: str, patches: DataFrame) -> DataFrame:
    """``table`` with the columns of ``patches`` that aren't null in the rows of their keys; columns that the table lacks are new ones."""
    named = [c for c in patches.columns if c != key]
    j = table.join(patches.select(key, F.struct(*named).alias("patch")), key, "left")
    old = [F.coalesce(f"patch.{c}", c).alias(c) if c in named else F.col(c) for c in table.columns]
    return j.select(*old, *(F.col(f"patch.{c}").alias(c) for c in named if c not in table.columns))


def add_questions(questions: DataFrame, asked: DataFrame, elements: DataFrame) -> DataFrame:
    """``questions`` and those asked (slug, element_id, curator_id, query, created_at) about elements that are there."""
    good = asked.join(elements.select("slug", "element_id").distinct(), ["slug", "element_id"], "left_semi")
    key = F.concat(F.lit("q-"), F.substring(F.sha2(F.concat_ws("|", "slug", "element_id", "curator_id", "query", "created_at"), 256), 1, 8))
    return questions.unionByName(good.withColumn("question_id", key), allowMissingColumns=True)


#: The states of a document.
STATUSES = ["raw", "segmenting", "extracting", "extracted", "synthesising", "synthesised", "open-for-curation", "archived", "done"]


def transition(documents: DataFrame, changes: DataFrame, at: str) -> DataFrame:
    """``documents`` (slug, status, last_touched_utc, ...) with the last of ``changes`` (slug, status, ordinal) in effect. Changes of unknown documents change nothing; ``unknown`` tells them."""
    last = changes.groupBy("slug").agg(F.max_by("status", "ordinal").alias("status")).withColumn("last_touched_utc", F.lit(at))
    return patch(documents, "slug", last)


def unknown(requests: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Requests that name what isn't in the table."""
    return requests.join(table.select(key), key, "left_anti")


def create_curators(curators: DataFrame, new: DataFrame) -> DataFrame:
    """``curators`` and new ones (name, token), of whom the token's hash alone is kept."""
    hashed = F.sha2("token", 256)
    rows = new.select(F.concat(F.lit("c-"), F.substring(hashed, 1, 8)).alias("curator_id"), "name", hashed.alias("token_sha256"), F.array().cast("array<string>").alias("assigned_slugs"), F.lit(True).alias("active"))
    return curators.unionByName(rows.join(curators.select("curator_id"), "curator_id", "left_anti"))


def revoke(curators: DataFrame, ids: DataFrame) -> DataFrame:
    return curators.join(ids.select("curator_id").distinct(), "curator_id", "left_anti")


def assign(curators: DataFrame, pairs: DataFrame, remove: bool = False) -> DataFrame:
    """``curators`` with slugs (curator_id, slug) added behind what they have, each once, or removed."""
    asked = pairs.groupBy("curator_id").agg(F.array_sort(F.collect_set("slug")).alias("asked"))
    old, new = F.col("assigned_slugs"), F.coalesce("asked", F.array().cast("array<string>"))
    slugs = F.array_except(old, new) if remove else F.array_union(old, new)
    return curators.join(asked, "curator_id", "left").withColumn("assigned_slugs", slugs).drop("asked")


def curators_of(curators: DataFrame, slug: str) -> DataFrame:
    return public(curators.where(F.array_contains("assigned_slugs", slug)))


def public(curators: DataFrame) -> DataFrame:
    return curators.drop("token_sha256")


def identities(tokens: DataFrame, curators: DataFrame, admin_token: str) -> DataFrame:
    """(token, role, curator_id) of tokens that someone has: an active curator, else the administrator."""
    own = curators.where("active").select("token_sha256", "curator_id")
    j = tokens.select("token", F.sha2("token", 256).alias("token_sha256")).join(own, "token_sha256", "left")
    role = F.when(F.col("curator_id").isNotNull(), "curator").when(F.col("token") == admin_token, "admin")
    return j.select("token", role.alias("role"), "curator_id").where("role is not null")


def visible_documents(curators: DataFrame, documents: DataFrame) -> DataFrame:
    """(curator_id, place, slug): the assigned documents that are open for curation, in the order of assignment."""
    slugs = curators.select("curator_id", F.posexplode("assigned_slugs").alias("place", "slug"))
    return slugs.join(documents.where("status = 'open-for-curation'").select("slug"), "slug").select("curator_id", "place", "slug")


def curator_elements(elements: DataFrame) -> DataFrame:
    """Exported elements as curators see them: box ids as element ids, kind, page and text never null."""
    return elements.select(F.col("box_id").alias("element_id"), F.coalesce("kind", F.lit("paragraph")).alias("kind"), F.coalesce("page", F.lit(1)).alias("page"), F.coalesce("text", F.lit("")).alias("text"))
