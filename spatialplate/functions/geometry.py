"""Geometry as Column builders over rings: arrays of points with x and y.

Only simplification and the count of meetings run Python, on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import thinning

Pair = tuple[Column, Column]


def xy(pair: Column) -> Column:
    return F.struct(F.get(pair, F.lit(0)).alias("x"), F.get(pair, F.lit(1)).alias("y"))


def rings(type_: Column, coordinates: Column) -> Column:
    """Rings from the JSON text of coordinates: a polygon's, or a line string as its only one; else null."""
    polygon = F.transform(F.from_json(coordinates, "array<array<array<double>>>"), lambda ring: F.transform(ring, xy))
    line = F.array(F.transform(F.from_json(coordinates, "array<array<double>>"), xy))
    return F.when(type_ == "Polygon", polygon).when(type_ == "LineString", line)


def point(type_: Column, coordinates: Column) -> Column:
    return F.when(type_ == "Point", xy(F.from_json(coordinates, "array<double>")))


def exterior(rings_: Column) -> Column:
    """The outline that is cut: holes are left out."""
    return F.get(rings_, F.lit(0))


def edges(rings_: Column) -> Column:
    """All sides of all rings, as structs a, b."""

    def of(ring: Column) -> Column:
        return F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return F.flatten(F.transform(rings_, of))


def turn(a: Column, b: Column, c: Column) -> Column:
    """Twice the signed area of a, b, c."""
    return (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)


def _between(a: Column, b: Column, p: Column) -> Column:
    return (p.x >= F.least(a.x, b.x)) & (p.x <= F.greatest(a.x, b.x)) & (p.y >= F.least(a.y, b.y)) & (p.y <= F.greatest(a.y, b.y))


def sides_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two segments cross or touch, collinear ones too."""
    s, t, u, v = turn(c, d, a), turn(c, d, b), turn(a, b, c), turn(a, b, d)
    cross = (((s > 0) & (t < 0)) | ((s < 0) & (t > 0))) & (((u > 0) & (v < 0)) | ((u < 0) & (v > 0)))
    return cross | ((s == 0) & _between(c, d, a)) | ((t == 0) & _between(c, d, b)) | ((u == 0) & _between(a, b, c)) | ((v == 0) & _between(a, b, d))


def in_triangle(p: Column, a: Column, b: Column, c: Column) -> Column:
    """Inside or on the border; a triangle without area holds nothing."""
    s, t, u = turn(a, b, p), turn(b, c, p), turn(c, a, p)
    return (turn(a, b, c) != 0) & (((s >= 0) & (t >= 0) & (u >= 0)) | ((s <= 0) & (t <= 0) & (u <= 0)))


def in_rings(p: Column, rings_: Column) -> Column:
    """Even-odd rule over all rings, so that holes count."""
    return within(p, edges(rings_))


def within(p: Column, edges_: Column) -> Column:
    """Even-odd rule over the sides of all rings, which are multiplied out, never divided."""

    def crossed(e: Column) -> Column:
        up = e.b.y > e.a.y
        left = (p.x - e.a.x) * (e.b.y - e.a.y)
        right = (e.b.x - e.a.x) * (p.y - e.a.y)
        return ((e.a.y > p.y) != (e.b.y > p.y)) & ((up & (left < right)) | (~up & (left > right)))

    return F.size(F.filter(edges_, crossed)) % 2 == 1


def meets_triangle(type_: Column, rings_: Column, a: Column, b: Column, c: Column, edges_: Column | None = None, box_: Column | None = None) -> Column:
    """Whether a polygon (holes respected) or line string has a point in common with a closed triangle; null for other types.

    edges_ and box_ are those of the rings, where they are columns already.
    """
    edges_, box_ = edges(rings_) if edges_ is None else edges_, box(rings_) if box_ is None else box_
    low, high = (lambda k: F.least(a[k], b[k], c[k])), (lambda k: F.greatest(a[k], b[k], c[k]))
    near = (box_.x0 <= high("x")) & (box_.x1 >= low("x")) & (box_.y0 <= high("y")) & (box_.y1 >= low("y"))
    border = lambda e: sides_meet(e.a, e.b, a, b) | sides_meet(e.a, e.b, b, c) | sides_meet(e.a, e.b, c, a)
    inside = F.exists(F.flatten(rings_), lambda p: in_triangle(p, a, b, c))
    around = (type_ == "Polygon") & (within(a, edges_) | within(b, edges_) | within(c, edges_))
    return F.when(type_.isin("Polygon", "LineString"), F.coalesce(near, F.lit(False)) & (inside | F.exists(edges_, border) | around))


def closed_triangle(points: Column) -> Column:
    return F.concat(points, F.slice(points, 1, 1))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it comes up."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def centroid(rings_: Column) -> Column:
    """Shoelace centroid of the exterior; the mean of its points where it has no area."""
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, e: Column) -> Column:
        w = e.a.x * e.b.y - e.b.x * e.a.y
        return F.struct((s.w + w).alias("w"), (s.x + (e.a.x + e.b.x) * w).alias("x"), (s.y + (e.a.y + e.b.y) * w).alias("y"))

    def of(ring: Column) -> Column:
        mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda t, p: t + p[c]) / F.size(ring)
        return once(F.aggregate(edges(F.array(ring)), start, add), lambda s: F.when(s.w != 0, F.struct((s.x / (s.w * 3)).alias("x"), (s.y / (s.w * 3)).alias("y"))).otherwise(F.struct(mean("x").alias("x"), mean("y").alias("y"))))

    return once(exterior(rings_), of)


def box(rings_: Column) -> Column:
    """Least and greatest x and y."""

    def of(flat: Column) -> Column:
        return once(F.struct(F.transform(flat, lambda p: p.x).alias("x"), F.transform(flat, lambda p: p.y).alias("y")), lambda v: F.struct(F.array_min(v.x).alias("x0"), F.array_min(v.y).alias("y0"), F.array_max(v.x).alias("x1"), F.array_max(v.y).alias("y1")))

    return once(F.flatten(rings_), of)


#: Axes of the instrument against those of the image.
FLIP = ((1.0, 0.0), (0.0, -1.0))


def oriented(p: Column, matrix: tuple[tuple[float, float], tuple[float, float]] = FLIP) -> Column:
    """A point under a 2 x 2 matrix; with FLIP, exactly (x, -y)."""
    if matrix == FLIP:
        return F.struct(p.x.alias("x"), (-p.y).alias("y"))
    (a, b), (c, d) = matrix
    return F.struct((p.x * a + p.y * b).alias("x"), (p.x * c + p.y * d).alias("y"))


def scaled(p: Column, factor: float = 100.0) -> Column:
    """Whole numbers: the floor of the double product."""
    return F.struct(F.floor(p.x * F.lit(factor)).cast("int").alias("x"), F.floor(p.y * F.lit(factor)).cast("int").alias("y"))


def kept_points(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices of the points of one ring or line that stay; see simplified()."""
    return np.flatnonzero(thinning.kept(thinning.Rings(x, y, np.array([0, len(x)]), np.zeros(1, np.int64)), tolerance))


def _read(shapes: pa.Array) -> tuple[pa.Array, pa.Array, thinning.Rings]:
    """An Arrow array of shapes, lists of rings: the rings, their points, and both in numpy."""
    rings_, of = shapes.flatten(), pc.list_parent_indices(shapes).to_numpy()
    sizes = pc.fill_null(pc.list_value_length(rings_), 0).to_numpy()
    points = rings_.flatten()
    x, y = (pc.fill_null(pc.struct_field(points, c), float("nan")).to_numpy(zero_copy_only=False).astype(float) for c in "xy")
    return rings_, points, thinning.Rings(x, y, np.concatenate([[0], np.cumsum(sizes)]), of)


def _thinned(shapes: pa.Array, tolerance: float) -> pa.Array:
    """An Arrow array of shapes, thinned all together."""
    rings_, points, rings = _read(shapes)
    of = rings.shapes
    keep = thinning.kept(rings, tolerance)
    left = np.bincount(rings.ring[keep], minlength=len(rings.sizes))

    def gathered(counts: np.ndarray, values: pa.Array, gone: pa.Array) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=gone)

    inner = gathered(left, points.filter(pa.array(keep)), rings_.is_null())
    return gathered(np.bincount(of, minlength=len(shapes)), inner, shapes.is_null())


def simplified(rings_: Column, tolerance: float = 1.0) -> Column:
    """Rings without the points that Douglas and Peucker's rule (1973) can spare; those that stay are the rings' own.

    Topology stays: sides of a shape, of one ring or of several, that don't meet
    before don't meet after, for which points within the tolerance may have to
    stay. A closed ring keeps four points at least if it has them. Sides that
    meet already may meet on. A hole is not kept from a side that jumps over it
    whole.
    """

    @F.arrow_udf("array<array<struct<x:double,y:double>>>")
    def thin(shapes: pa.Array) -> pa.Array:
        return _thinned(shapes, tolerance)

    return thin(rings_)


def meetings(rings_: Column) -> Column:
    """Pairs of a shape's sides that have a point in common, besides the one at which they follow each other: 0 for a simple outline. Sides without length, or without a coordinate, don't count.

    Pairs are looked for on a grid of the shape's own, for all shapes of an
    Arrow batch together. A shape that is null, or has a ring that is, has none.
    """

    @F.arrow_udf("int")
    def count(shapes: pa.Array) -> pa.Array:
        parts, _, read = _read(shapes)
        gone = shapes.is_null().to_numpy(zero_copy_only=False)
        gone[read.shapes[parts.is_null().to_numpy(zero_copy_only=False)]] = True
        return pa.array(thinning.meetings(read, len(shapes)), pa.int32(), mask=gone)

    return count(rings_)
