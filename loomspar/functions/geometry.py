"""Vector geometry on arrays of three numbers, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspar.functions import dot


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def cross(a: Column, b: Column) -> Column:
    part = lambda i, j: a[i] * b[j] - a[j] * b[i]
    return F.array(part(1, 2), part(2, 0), part(0, 1))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def bond_angle(a: Column, b: Column, c: Column) -> Column:
    """Angle at ``b`` in radians; the cosine is kept within its range."""
    u, v = minus(a, b), minus(c, b)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / (norm(u) * norm(v)))))


def torsion(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Dihedral angle around ``b``-``c`` in radians."""
    p, q, r = minus(b, a), minus(c, b), minus(d, c)
    m, n = cross(p, q), cross(q, r)
    return F.atan2(norm(q) * dot(p, n), dot(m, n))


def plane_distance(point: Column, a: Column, b: Column, c: Column) -> Column:
    """Signed distance of a point from the plane through three others."""
    n = cross(minus(b, a), minus(c, a))
    return dot(minus(point, a), n) / norm(n)


def moved(x: Column, rotation: list[list[float]], shift: list[float]) -> Column:
    """``x . R + t`` for a fixed rotation matrix and shift."""
    at = lambda j: sum((x[i] * F.lit(rotation[i][j]) for i in range(3)), F.lit(shift[j]))
    return F.array(*[at(j) for j in range(3)])


def sinusoid(x: Column, pairs: int, longest: float = 10000.0) -> Column:
    """Sines, then cosines, of x at ``pairs`` falling frequencies."""
    rate = lambda i: F.lit(longest) ** (-i / F.lit(float(pairs)))
    steps = F.sequence(F.lit(0), F.lit(pairs - 1))
    return F.concat(F.transform(steps, lambda i: F.sin(x * rate(i))), F.transform(steps, lambda i: F.cos(x * rate(i))))


def covers_circle(arcs: Column) -> Column:
    """Whether arcs ``(lo, hi)`` with 0 <= lo < hi <= 2 pi cover the whole circle: sorted by their
    beginnings, none begins after the furthest end so far."""
    start = F.struct(F.lit(True).alias("ok"), F.lit(0.0).alias("end"))
    swept = F.aggregate(F.array_sort(arcs), start, lambda s, a: F.struct((s["ok"] & (a["lo"] <= s["end"])).alias("ok"), F.greatest(s["end"], a["hi"]).alias("end")))
    return swept["ok"] & (swept["end"] >= 2 * F.pi() - 1e-12)
