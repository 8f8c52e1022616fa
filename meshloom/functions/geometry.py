"""Vectors and centroids as column expressions over structs (x, y, z); all stay in code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
#: The five tetrahedra of a hexahedron (apex last).
HEXA_TETS = ((0, 5, 7, 4), (2, 5, 7, 6), (0, 2, 5, 1), (0, 2, 7, 3), (2, 5, 7, 0))


class Vec:
    """Three column expressions."""

    def __init__(self, x: Column, y: Column, z: Column):
        self.c = (x, y, z)

    @classmethod
    def of(cls, point: Column) -> Vec:
        return cls(*(point[a] for a in AXES))

    def __add__(self, o: Vec) -> Vec:
        return Vec(*(a + b for a, b in zip(self.c, o.c, strict=True)))

    def __sub__(self, o: Vec) -> Vec:
        return Vec(*(a - b for a, b in zip(self.c, o.c, strict=True)))

    def __mul__(self, s) -> Vec:
        return Vec(*(a * s for a in self.c))

    def __truediv__(self, s) -> Vec:
        return Vec(*(a / s for a in self.c))

    def cross(self, o: Vec) -> Vec:
        (a, b, c), (d, e, f) = self.c, o.c
        return Vec(b * f - c * e, c * d - a * f, a * e - b * d)

    def dot(self, o: Vec) -> Column:
        return self.c[0] * o.c[0] + self.c[1] * o.c[1] + self.c[2] * o.c[2]

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))

    def normalized(self) -> Vec:
        return self / self.norm()

    def text(self) -> Column:
        return F.concat(F.lit("["), F.concat_ws(", ", *[F.format_string("%g", c) for c in self.c]), F.lit("]"))

    def struct(self) -> Column:
        return F.struct(*[c.alias(a) for c, a in zip(self.c, AXES, strict=True)])


def mean(points: list[Vec]) -> Vec:
    return reduce(Vec.__add__, points) / F.lit(float(len(points)))


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    return (b - a).cross(c - a).norm() / 2.0


def tetra_volume(a: Vec, b: Vec, c: Vec, apex: Vec) -> Column:
    return F.abs((a - apex).dot((b - apex).cross(c - apex))) / 6.0


def add_centroid(cells: DataFrame) -> DataFrame:
    """cells(..., elem_type, points) -> the same with x, y, z of the centroid instead of points; the origin
    for unknown types.

    Triangles, tetrahedra: mean of the points.  Quadrilaterals: area-weighted mean of triangles (0, 1, 2)
    and (0, 2, 3).  Pyramids: base centre and a third of the way to the apex (the reference figure; the
    true one is a quarter).  Prisms: mean of the end triangles' centres.  Hexahedra: volume-weighted mean of
    five tetrahedra.  Areas, volumes and base centres are columns of their own, so that none is computed,
    or compiled, twice."""
    keep = [c for c in cells.columns if c != "points"]
    flat = cells.select(*keep, *[F.get("points", F.lit(i))[a].alias(f"{a}{i}") for i in range(8) for a in AXES])
    p = [Vec(*(F.col(f"{a}{i}") for a in AXES)) for i in range(8)]
    points = [c for c in flat.columns if c not in keep]
    weighed = flat.select(
        *keep, *points, triangle_area(p[0], p[1], p[2]).alias("s"), triangle_area(p[0], p[2], p[3]).alias("t"),
        *[tetra_volume(*(p[i] for i in tet)).alias(f"v{k}") for k, tet in enumerate(HEXA_TETS)],
    )
    s, t, v = F.col("s"), F.col("t"), [F.col(f"v{k}") for k in range(5)]
    quad = (mean([p[0], p[1], p[2]]) * s + mean([p[0], p[2], p[3]]) * t) / (s + t)
    based = weighed.select(*keep, *points, *[f"v{k}" for k in range(5)], reduce(lambda a, b: a + b, v).alias("v"), *[c.alias(f"q{a}") for c, a in zip(quad.c, AXES, strict=True)])
    base = Vec(*(F.col(f"q{a}") for a in AXES))
    hexa = reduce(Vec.__add__, [mean([p[i] for i in tet]) * v[k] for k, tet in enumerate(HEXA_TETS)]) / F.col("v")
    forms = {5: mean(p[:3]), 7: base, 10: mean(p[:4]), 12: base + (p[4] - base) / 3.0, 14: (mean(p[:3]) + mean(p[3:6])) / 2.0, 17: hexa}
    code = F.col("elem_type")
    out = [F.lit(0.0)] * 3
    for k, form in forms.items():
        out = [F.when(code == k, c).otherwise(o) for c, o in zip(form.c, out, strict=True)]
    return based.select(*keep, *[c.alias(a) for c, a in zip(out, AXES, strict=True)])
