"""Vectors as struct<x, y, z> columns, transforms and planes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def point(x, y, z) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(lit(x).alias("x"), lit(y).alias("y"), lit(z).alias("z"))


def _each(f) -> Column:
    return point(*[f(i) for i in AXES])


def let(value: Column, f) -> Column:
    """f(value), with the value worked out once: long vector expressions would otherwise be copied into each use."""
    return F.transform(F.array(value), f)[0]


def rounded(x: Column, digits: int) -> Column:
    """round(x, digits), half away from zero, of finite numbers whose digits fit a long; without decimals, which take longer than
    all else where rows are many."""
    k = 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * k + 0.5) / k


def add(a: Column, b: Column) -> Column:
    return _each(lambda i: a[i] + b[i])


def sub(a: Column, b: Column) -> Column:
    return _each(lambda i: a[i] - b[i])


def scale(a: Column, k) -> Column:
    return _each(lambda i: a[i] * k)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return point(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return length(sub(a, b))


def unit(a: Column) -> Column:
    return scale(a, 1 / length(a))


def extend(a: Column, by) -> Column:
    """The same direction, longer by `by`."""
    return scale(a, (length(a) + by) / length(a))


def mid(*points: Column) -> Column:
    return _each(lambda i: sum((p[i] for p in points[1:]), points[0][i]) / len(points))


# A transform is struct<pre, rot: array of 9 by rows, post>: rot (v + pre) + post.


def transform(v: Column, t: Column) -> Column:
    return let(F.struct(add(v, t["pre"]).alias("p"), t.alias("t")), lambda x: add(_turned(x["t"]["rot"], x["p"]), x["t"]["post"]))


def _turned(rot: Column, p: Column) -> Column:
    row = lambda k: rot[3 * k] * p["x"] + rot[3 * k + 1] * p["y"] + rot[3 * k + 2] * p["z"]
    return point(row(0), row(1), row(2))


def compose(first: Column, second: Column) -> Column:
    """One transform that does `first`, then `second`, by the matrix product."""
    return let(F.struct(first.alias("a"), second.alias("b")), lambda x: _composed(x["a"], x["b"]))


def _composed(a: Column, b: Column) -> Column:
    cell = lambda i, j: b["rot"][3 * i] * a["rot"][j] + b["rot"][3 * i + 1] * a["rot"][3 + j] + b["rot"][3 * i + 2] * a["rot"][6 + j]
    rot = F.array(*[cell(i, j) for i in range(3) for j in range(3)])
    return F.struct(a["pre"].alias("pre"), rot.alias("rot"), add(_turned(b["rot"], add(a["post"], b["pre"])), b["post"]).alias("post"))


def translation(v: Column) -> Column:
    return F.struct(v.alias("pre"), F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)]).alias("rot"), point(0, 0, 0).alias("post"))


def rotation(rot: Column) -> Column:
    return F.struct(point(0, 0, 0).alias("pre"), rot.alias("rot"), point(0, 0, 0).alias("post"))


# A plane is struct<normal, d>, with normal . v + d = 0.


def plane(a: Column, b: Column, c: Column) -> Column:
    whole = let(cross(sub(a, b), sub(c, b)), unit)
    return let(F.struct(whole.alias("n"), a.alias("a")), lambda x: F.struct(x["n"].alias("normal"), (-dot(x["n"], x["a"])).alias("d")))


def project_on_plane(v: Column, p: Column) -> Column:
    return sub(v, scale(p["normal"], dot(p["normal"], v) + p["d"]))


def dihedral_cos(p: Column, q: Column) -> Column:
    return dot(p["normal"], q["normal"])


def dihedral_angle(p: Column, q: Column, towards: Column | None = None) -> Column:
    """From 0 to pi; with a direction, negative where the cross product of the normals points against it."""
    n = cross(p["normal"], q["normal"])
    angle = F.atan2(length(n), dihedral_cos(p, q))
    return angle if towards is None else F.when(dot(n, towards) < 0, -angle).otherwise(angle)


def bisection_plane(p: Column, q: Column) -> Column:
    """The plane halfway between two, the second turned over where their normals point apart."""

    def halfway(x: Column) -> Column:
        size = length(x["n"])
        return F.struct(scale(x["n"], 1 / size).alias("normal"), (x["d"] / size).alias("d"))

    side = F.when(dihedral_cos(p, q) < 0, -1.0).otherwise(1.0)
    return let(F.struct(add(p["normal"], scale(q["normal"], side)).alias("n"), (p["d"] + q["d"] * side).alias("d")), halfway)
