"""Vectors and boxes as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is null-length. Vectors of different length are an error."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors of different length")))


def box(prefix: str) -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def area(b) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def intersection(a, b) -> Column:
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))


def iou(a, b) -> Column:
    both = intersection(a, b)
    return F.when(both == 0, 0.0).otherwise(both / (area(a) + area(b) - both))


def centre_in(inner, outer) -> Column:
    return ((inner[0] + inner[2]) / 2).between(outer[0], outer[2]) & ((inner[1] + inner[3]) / 2).between(outer[1], outer[3])


#: Which block types a box of a kind takes. (kind, types, factor); the first that fits counts, 1 otherwise.
COMPATIBLE = [
    ("table", ["table", "chart"], 1.5),
    ("table", None, 0.0),
    ("figure", ["image"], 1.5),
    ("figure", None, 0.0),
    ("formula", ["equation", "interline_equation", "code"], 1.5),
    ("formula", ["image", "table", "chart", "code"], 0.0),
    ("heading paragraph caption list_item auxiliary", ["image", "table", "chart", "code"], 0.0),
    ("heading", ["title"], 1.5),
    ("list_item", ["list"], 1.5),
]


def compatibility(kind: Column, block_type: Column) -> Column:
    out = F.when(F.coalesce(block_type, F.lit("")) == "", 1.0)
    for kinds, types, factor in COMPATIBLE:
        fits = kind.isin(kinds.split())
        out = out.when(fits if types is None else fits & block_type.isin(types), factor)
    return out.otherwise(1.0)


def adjacency(text, visual, most_gap: float = 50.0) -> Column:
    """How well a text box sits above or below a visual one: 1 / (1 + gap) if they share 30 % of the text's width and the gap is small, else 0."""
    shared = F.greatest(F.least(text[2], visual[2]) - F.greatest(text[0], visual[0]), F.lit(0.0))
    gap = F.greatest(visual[1] - text[3], text[1] - visual[3], F.lit(0.0))
    fits = (shared / F.greatest(text[2] - text[0], F.lit(1.0)) >= 0.3) & (gap <= most_gap)
    return F.when(fits, 1.0 / (1.0 + gap)).otherwise(0.0)


def points(pixels: Column, dpi: Column | int) -> Column:
    return pixels * 72 / dpi


def pixels(points: Column, dpi: Column | int) -> Column:
    return points * dpi / 72
