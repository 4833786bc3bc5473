"""Polygons in well-known text, and whether they contain a point, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rings(wkt: Column) -> Column:
    """All rings of a POLYGON or MULTIPOLYGON: an array of arrays of (x, y); null for other texts."""
    number = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
    found = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    points = lambda r: F.transform(F.split(r, ","), lambda p: F.transform(F.regexp_extract_all(p, F.lit(f"({number})"), F.lit(1)), lambda x: x.cast("double")))
    xy = lambda r: F.transform(points(r), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return F.when(wkt.rlike(r"(?i)^\s*(MULTI)?POLYGON\b"), F.transform(found, xy))


def contains(ring_array: Column, x: Column, y: Column) -> Column:
    """Whether a point lies within: a ray to the right crosses an odd number of all rings' edges, so holes are outside.

    Points on an edge count by the half-open rule (low ends and left edges inside). Null for a null point or polygon.
    """

    def crossings(ring: Column) -> Column:
        edges = F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

        def crosses(e: Column) -> Column:
            a, b = e["a"], e["b"]
            return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

        return F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False))))

    total = F.aggregate(F.transform(ring_array, crossings), F.lit(0), lambda acc, n: acc + n)
    return F.when(x.isNull() | y.isNull() | ring_array.isNull(), None).otherwise(total % 2 == 1)


def box(ring_array: Column) -> Column:
    """low_x, high_x, low_y, high_y of a polygon."""
    xs = F.flatten(F.transform(ring_array, lambda r: F.transform(r, lambda p: p["x"])))
    ys = F.flatten(F.transform(ring_array, lambda r: F.transform(r, lambda p: p["y"])))
    return F.struct(F.array_min(xs).alias("low_x"), F.array_max(xs).alias("high_x"), F.array_min(ys).alias("low_y"), F.array_max(ys).alias("high_y"))
