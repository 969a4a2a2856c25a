"""Rectangles as struct columns (x0, y0, x1, y1: double): areas, overlaps, coverage, distances, alignment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)))


def valid(r: Column) -> Column:
    """Finite, not negative, not empty."""
    finite = F.lit(True)
    for c in ("x0", "y0", "x1", "y1"):
        finite = finite & ~F.isnan(r[c]) & (F.abs(r[c]) < float("inf")) & (r[c] >= 0)
    return F.coalesce(finite & (r["x0"] < r["x1"]) & (r["y0"] < r["y1"]), F.lit(False))


def _length(low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), high - low)


def area(r: Column) -> Column:
    return _length(r["x0"], r["x1"]) * _length(r["y0"], r["y1"])


def intersection(a: Column, b: Column) -> Column:
    wide = _length(F.greatest(a["x0"], b["x0"]), F.least(a["x1"], b["x1"]))
    return wide * _length(F.greatest(a["y0"], b["y0"]), F.least(a["y1"], b["y1"]))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union != 0, both / union).otherwise(F.lit(0.0))


def overlaps(a: Column, b: Column) -> Column:
    return (F.greatest(a["x0"], b["x0"]) < F.least(a["x1"], b["x1"])) & (F.greatest(a["y0"], b["y0"]) < F.least(a["y1"], b["y1"]))


def touches(a: Column, b: Column) -> Column:
    return (F.greatest(a["x0"], b["x0"]) <= F.least(a["x1"], b["x1"])) & (F.greatest(a["y0"], b["y0"]) <= F.least(a["y1"], b["y1"]))


def contains(outer: Column, inner: Column, tolerance: float = 1e-6) -> Column:
    low = (outer["x0"] <= inner["x0"] + tolerance) & (outer["y0"] <= inner["y0"] + tolerance)
    return low & (outer["x1"] >= inner["x1"] - tolerance) & (outer["y1"] >= inner["y1"] - tolerance)


def grown(r: Column, by: float) -> Column:
    return rect(r["x0"] - by, r["y0"] - by, r["x1"] + by, r["y1"] + by)


def coverage(expected: Column, applied: Column, epsilon: float = 0.5) -> Column:
    """Share of a rect that the union of an array of rects covers, exactly, on the grid that their edges make."""
    spread = F.transform(applied, lambda r: grown(r, epsilon))

    def edges(low: str, high: str) -> Column:
        inner = F.flatten(F.transform(spread, lambda r: F.array(r[low], r[high])))
        clipped = F.transform(F.concat(F.array(expected[low], expected[high]), inner), lambda v: F.least(F.greatest(v, expected[low]), expected[high]))
        return F.array_sort(F.array_distinct(clipped))

    def cells(xs: Column, ys: Column) -> Column:
        def row(x: Column, i: Column) -> Column:
            def cell(y: Column, j: Column) -> Column:
                x1, y1 = F.get(xs, i + 1), F.get(ys, j + 1)
                inside = F.exists(spread, lambda r: (r["x0"] <= x) & (r["y0"] <= y) & (r["x1"] >= x1) & (r["y1"] >= y1))
                return F.when(x1.isNotNull() & y1.isNotNull() & inside, (x1 - x) * (y1 - y)).otherwise(F.lit(0.0))

            return F.aggregate(F.transform(ys, cell), F.lit(0.0), lambda a, v: a + v)

        return F.aggregate(F.transform(xs, row), F.lit(0.0), lambda a, v: a + v)

    grid = F.transform(F.array(F.struct(edges("x0", "x1").alias("xs"), edges("y0", "y1").alias("ys"))), lambda e: cells(e["xs"], e["ys"]))[0]
    covered = F.when(F.size(spread) == 1, intersection(expected, spread[0])).otherwise(grid)  # one rect needs no grid
    whole = area(expected)
    return F.when(whole > 0, F.least(F.lit(1.0), covered / whole)).otherwise(F.lit(0.0))


def faults(expected: Column, applied: Column, protected: Column, epsilon: float = 0.5) -> Column:
    """Names of what is wrong with masks: missing geometry, incomplete coverage, intrusion into a neighbour."""
    missing = (F.size(expected) <= 0) | (F.size(applied) <= 0)
    bare = F.filter(expected, lambda r: coverage(r, applied, epsilon) < 1.0)
    shrunk = F.filter(F.transform(protected, lambda r: grown(r, -epsilon)), lambda r: area(r) > 0)
    hurt = F.filter(shrunk, lambda r: F.exists(applied, lambda a: intersection(r, a) > 0))
    named = lambda rects, name: F.transform(rects, lambda _: F.lit(name))
    return F.when(F.coalesce(missing, F.lit(True)), F.array(F.lit("missing_geometry"))).otherwise(
        F.concat(named(bare, "incomplete_coverage"), named(F.coalesce(hurt, F.array().cast(shrunk_type())), "protected_neighbor_intrusion"))
    )


def shrunk_type() -> str:
    return "array<struct<x0:double,y0:double,x1:double,y1:double>>"


def distance(a: Column, b: Column) -> Column:
    """Of the nearest points."""
    dx = F.greatest(F.lit(0.0), b["x0"] - a["x1"], a["x0"] - b["x1"])
    dy = F.greatest(F.lit(0.0), b["y0"] - a["y1"], a["y0"] - b["y1"])
    return F.hypot(dx, dy)


def gap(label: Column, value: Column) -> Column:
    """Horizontal distance."""
    return F.greatest(F.lit(0.0), value["x0"] - label["x1"], label["x0"] - value["x1"])


def same_row(a: Column, b: Column) -> Column:
    """Centres no further apart than the larger half height, or 3."""
    apart = F.abs((a["y0"] + a["y1"] - b["y0"] - b["y1"]) / 2)
    return apart <= F.greatest(F.lit(3.0), (a["y1"] - a["y0"]) / 2, (b["y1"] - b["y0"]) / 2)


def part_of(r: Column, start: Column, end: Column, length: Column) -> Column:
    """The stretch of a word's rect that some of its letters take, all letters being equally wide."""
    step = (r["x1"] - r["x0"]) / length
    return rect(r["x0"] + step * start, r["y0"], r["x0"] + step * end, r["y1"])


def union(rects: Column) -> Column:
    """The box around an array of rects."""
    side = lambda f, n: f(F.transform(rects, lambda r: r[n]))
    return rect(side(F.array_min, "x0"), side(F.array_min, "y0"), side(F.array_max, "x1"), side(F.array_max, "y1"))


def micro(v: Column) -> Column:
    """A coordinate as it enters identities."""
    return F.floor(v * 1000000 + F.lit(0.5)).cast("long")


def fingerprint(rects: Column) -> Column:
    """Order-free hash of an array of rects."""
    texts = F.transform(rects, lambda r: F.concat(F.lit("["), F.concat_ws(",", *(micro(r[c]).cast("string") for c in ("x0", "y0", "x1", "y1"))), F.lit("]")))
    return F.sha2(F.concat(F.lit("["), F.array_join(F.array_sort(texts), ","), F.lit("]")), 256)
