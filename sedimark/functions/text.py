"""Text functions as column expressions; Python only where Spark has no expression."""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as str.split() sees it.
SPACES = r"(?U)[\s\x1c-\x1f]+"


def strip(c: Column) -> Column:
    """No white space at the ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def collapse_spaces(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def content_hash(c: Column) -> Column:
    """Hash of a chunk's text, blind to its white space."""
    return F.concat(F.lit("sha256:"), F.sha2(collapse_spaces(c), 256))


def element_id(page: Column, content: Column) -> Column:
    return F.concat(F.lit("p"), page.cast("string"), F.lit("-"), F.substring(F.sha2(content, 256), 1, 8))


def bare_element_id(c: Column) -> Column:
    return F.regexp_replace(c, r"^p\d+-", "")


def slug_url(filename: Column) -> Column:
    """Lower-case name without .pdf, everything but a-z, 0-9 and - as single dashes."""
    name = F.lower(F.regexp_replace(filename, r"(?i)\.pdf$", ""))
    return F.regexp_replace(F.regexp_replace(name, "[^a-z0-9-]+|-+", "-"), "^-+|-+$|-+(?=-)", "")


@F.pandas_udf(StringType())
def slug_ascii(names: pd.Series) -> pd.Series:
    """ASCII slug by compatibility decomposition, 'untitled' when nothing is left."""
    plain = names.fillna("").map(lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())
    plain = plain.str.lower().str.replace(r"[\s_]+", "-", regex=True).str.replace(r"[^a-z0-9-]", "", regex=True).str.replace(r"-+", "-", regex=True).str.strip("-")
    return plain.where(plain != "", "untitled")


def overlaps(query: Column, source: Column, threshold: int) -> Column:
    """Whether any window of ``threshold`` characters of the query stands in the source; a threshold of 0 is always met."""
    if threshold <= 0:
        return F.lit(True)

    def found(x):
        starts = F.sequence(F.lit(1), F.greatest(F.length(x["q"]) - threshold + 1, F.lit(1)))
        return F.when(F.length(x["q"]) < threshold, False).otherwise(F.exists(starts, lambda i: F.contains(x["s"], F.substring(x["q"], i, F.lit(threshold)))))

    # an array of one binds both texts, so that they are brought to their form once and not for each window
    both = F.array(F.struct(F.lower(collapse_spaces(query)).alias("q"), F.lower(collapse_spaces(source)).alias("s")))
    return F.get(F.transform(both, found), F.lit(0))


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([A-Za-z][A-Za-z0-9]*));")


@F.pandas_udf(StringType())
def _unescape_closed(texts: pd.Series) -> pd.Series:
    def decoded(m: re.Match) -> str:
        return html.entities.html5.get(m[1] + ";", m[0]) if m[1] else html.unescape(m[0])

    return texts.map(lambda s: _CLOSED.sub(decoded, s), na_action="ignore")


def unescape(c: Column, closed: bool = False) -> Column:
    """Character references decoded, all of HTML's; ``closed``: those alone that end in a semicolon, so that '&amp' at the end of a cut text stays. Only texts that hold an ampersand go to Python."""
    run = _unescape_closed if closed else _unescape
    return F.coalesce(run(F.when(F.contains(c, F.lit(";" if closed else "&")) & F.contains(c, F.lit("&")), c)), c)


def html_to_text(c: Column, closed: bool = False) -> Column:
    """Text between tags, character references (``closed``: those with a semicolon) decoded."""
    return unescape(F.regexp_replace(c, "<[^>]+>", ""), closed)


def heading_level(tag: Column) -> Column:
    found = F.regexp_extract(F.lower(tag), "^h([1-6])$", 1)
    return F.when(found == "", 1).otherwise(found.try_cast("int"))


def page_of_box(box_id: Column) -> Column:
    return F.regexp_extract(box_id, r"^p(\d+)-", 1).try_cast("int")


def strip_bullet(c: Column) -> Column:
    """A list item without its mark and blanks around: -, * or •, or a number with a dot."""
    return strip(F.regexp_replace(c, r"^\s*(?:[-*•]|\d+\.)\s+", ""))


def strip_marks(c: Column) -> Column:
    """A line without any bullets and blanks before it."""
    return strip(F.regexp_replace(c, r"^[\s\-·•*]+", ""))


def label(c: Column, most: int = 60) -> Column:
    """At most so many characters, the last one an ellipsis when cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def numbered(units: Column) -> Column:
    """Units as lines '0. first', '1. second', ..."""
    return F.array_join(F.transform(units, lambda s, i: F.concat(i.cast("string"), F.lit(". "), s)), "\n")


def render_prompt(template: Column, units: Column) -> Column:
    return F.replace(template, F.lit("{content}"), numbered(units))


def parse_questions(raw: Column) -> Column:
    """array<struct(sub_unit, question)> of a model's JSON answer {"questions": [...]}; null where it isn't valid JSON of that form. Items that lack a text or ask nothing fall away."""
    answer = F.try_parse_json(raw)
    items = F.try_variant_get(answer, "$.questions", "array<variant>")
    read = lambda x, name: F.when(F.schema_of_variant(F.try_variant_get(x, f"$.{name}", "variant")) == "STRING", F.try_variant_get(x, f"$.{name}", "string"))
    found = F.transform(items, lambda x: F.struct(read(x, "sub_unit").alias("sub_unit"), read(x, "question").alias("question")))
    return F.filter(found, lambda q: q["sub_unit"].isNotNull() & (strip(q["question"]) != ""))


#: Fixed values here and below: the words of these headers.
def element_block(element_type: Column, page: Column, element_id: Column, content: Column, caption: Column, rows: Column, cols: Column) -> Column:
    """An element as it is shown in review: a header by type, then what it holds."""
    name = F.when(element_type == "heading", "Überschrift").when(element_type == "list_item", "Listpunkt").otherwise("Absatz")
    table = F.format_string("[Tabelle, Seite %d, %d×%d, id=%s]\n%s\n(Drücke 't' für die volle Tabelle.)", page, F.coalesce(rows, F.lit(0)), F.coalesce(cols, F.lit(0)), element_id, content)
    figure = F.format_string("[Abbildung, Seite %d, id=%s]\n%s\n(Bild kann im Terminal nicht angezeigt werden — siehe PDF Seite %d.)", page, element_id, F.coalesce(caption, F.lit("")), page)
    return F.when(element_type == "table", table).when(element_type == "figure", figure).otherwise(F.format_string("[%s, Seite %d, id=%s]\n%s", name, page, element_id, content))


def table_block(page: Column, element_id: Column, content: Column, full: Column, rows: Column, cols: Column) -> Column:
    """A table in full, or its short form where that is all there is."""
    return F.format_string("[Tabelle (voll), Seite %d, %d×%d, id=%s]\n%s", page, F.coalesce(rows, F.lit(0)), F.coalesce(cols, F.lit(0)), element_id, F.coalesce(full, content))


def preview(c: Column, most: int = 120) -> Column:
    """The first characters of a text, as printed in a listing."""
    return F.substring(c, 1, most)


def score_line(score: Column, chunk_id: Column) -> Column:
    return F.format_string("%.3f %s", score, chunk_id)


def quoted(c: Column) -> Column:
    """A string inside single quotes of a filter expression."""
    return F.replace(c, F.lit("'"), F.lit("''"))


def utc(c: Column) -> Column:
    """The wall clock of an instant in UTC, whatever the session's time zone."""
    return F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone())


def compact_time(c: Column) -> Column:
    """YYYYMMDDTHHMMSS of a timestamp, in UTC."""
    return F.date_format(utc(c), "yyyyMMdd'T'HHmmss")


def iso_seconds(c: Column) -> Column:
    """ISO 8601 to seconds of a timestamp, in UTC."""
    return F.date_format(utc(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_time(c: Column) -> Column:
    """The time that an ISO 8601 text states, null if it states none."""
    return F.try_to_timestamp(c)
