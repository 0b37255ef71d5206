"""Whether a record is valid, as one boolean expression a kind; null counts as invalid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
EVENT_TYPES = ["created", "reviewed", "deprecated"]
ELEMENT_TYPES = ["paragraph", "heading", "table", "figure", "list_item"]
ACTIONS = ["created_from_scratch", "synthesised", "imported_from_faq", "accepted_unchanged", "approved", "rejected", "deprecated"]
BOX_KINDS = ["heading", "paragraph", "table", "figure", "caption", "formula", "list_item", "auxiliary", "discard"]

TIME = r"([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d+)?)?)?(Z|[+-]([01]\d|2[0-3])(:?[0-5]\d){0,2})?"


def iso_timestamp(c: Column) -> Column:
    """A date, or a date and a time, in the extended ISO 8601 form; the date has to exist."""
    return F.coalesce(c.rlike(rf"^\d{{4}}-\d\d-\d\d(.{TIME})?$") & F.try_to_timestamp(F.substring(c, 1, 10)).isNotNull(), F.lit(False))


def filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def _all(*tests: Column) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def event(e: str = "") -> Column:
    """(event_id, timestamp_utc, event_type, entry_id, schema_version, payload as JSON text)."""
    c = lambda name: F.col(f"{e}{name}")
    return _all(filled(c("event_id")), filled(c("entry_id")), iso_timestamp(c("timestamp_utc")), c("event_type").isin(EVENT_TYPES), c("schema_version") >= 1, c("payload").isNull() | F.ltrim(c("payload")).startswith("{"))


def source_element(e: str = "") -> Column:
    c = lambda name: F.col(f"{e}{name}")
    return _all(filled(c("document_id")), filled(c("element_id")), c("page_number") >= 1, c("element_type").isin(ELEMENT_TYPES))


def actor(e: str, levels: list[str]) -> Column:
    """A human with a name and a level, or a model with its versions and temperature."""
    c = lambda name: F.col(f"{e}{name}")
    human = _all(c("kind") == "human", filled(c("pseudonym")), c("level").isin(levels))
    model = _all(c("kind") == "llm", filled(c("model")), filled(c("model_version")), filled(c("prompt_template_version")), c("temperature").isNotNull())
    return human | model


def box(e: str = "") -> Column:
    c = lambda name: F.col(f"{e}{name}")
    corners = (c(x).isNotNull() for x in ("x0", "y0", "x1", "y1"))
    return _all(c("page") >= 1, c("confidence").between(0, 1), c("kind").isin(BOX_KINDS), *corners)


def merge(ids: Column) -> Column:
    """Boxes to be merged are two or more, each named once."""
    return _all(F.size(ids) >= 2, F.size(F.array_distinct(ids)) == F.size(ids))
