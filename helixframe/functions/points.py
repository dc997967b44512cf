"""Points derived from a mer's atoms (map of name -> struct<x, y, z>); null where an atom is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions import vec
from helixframe.functions.profiles import Profile

#: Atoms of a residue's backbone that don't count for its side chain.
MAIN_CHAIN = ("N", "CA", "C")
REACH = 2.53


def _mean(atoms: Column) -> Column:
    values = F.map_values(atoms)
    mean = lambda i: F.aggregate(values, F.lit(0.0), lambda s, v: s + v[i]) / F.size(values)
    return F.when(F.size(values) > 0, vec.point(mean("x"), mean("y"), mean("z")))


def gc(atoms: Column) -> Column:
    """Centre of all atoms."""
    return _mean(atoms)


def rc(atoms: Column, chainable: Column) -> Column:
    """Centre of the side chain (O counts for it); of all atoms for ligands and where nothing else is left."""
    side = F.map_filter(atoms, lambda k, _: ~k.isin(*MAIN_CHAIN))
    return F.when(chainable & (F.size(side) > 0), _mean(side)).otherwise(_mean(atoms))


def cbx(atoms: Column, name: Column) -> Column:
    """CB moved 1 Angstrom on from CA; for GLY a point off CA by the directions of N and C."""
    ca = atoms["CA"]
    gly = vec.let(vec.add(vec.sub(atoms["N"], ca), vec.sub(atoms["C"], ca)), lambda v: vec.scale(vec.unit(v), REACH))
    other = vec.let(vec.sub(atoms["CB"], ca), lambda v: vec.extend(v, 1.0))
    return vec.let(F.struct(ca.alias("ca"), F.when(name == "GLY", gly).otherwise(other).alias("by")), lambda x: F.when(x["by"]["x"].isNotNull(), vec.add(x["ca"], x["by"])))


def ring_center(atoms: Column) -> Column:
    return F.when(atoms["N1"].isNotNull() & atoms["C4"].isNotNull(), vec.mid(atoms["N1"], atoms["C4"]))


def prc(atoms: Column) -> Column:
    """Centre of the five-membered ring, else of the six-membered one."""
    five = [atoms[a] for a in ("C4", "C5", "N7", "C8", "N9")]
    there = five[0].isNotNull()
    for p in five[1:]:
        there = there & p.isNotNull()
    return F.coalesce(F.when(there, vec.mid(*five)), ring_center(atoms))


def nx(atoms: Column) -> Column:
    """The base's nitrogen, N9 or else N1, moved 1.4 Angstrom on from C1'."""
    n, c = F.coalesce(atoms["N9"], atoms["N1"]), atoms["C1'"]
    return F.when(n.isNotNull() & c.isNotNull(), vec.add(c, vec.let(vec.sub(n, c), lambda v: vec.extend(v, 1.4))))


def ring_plane(atoms: Column) -> Column:
    there = atoms["C2"].isNotNull() & atoms["C4"].isNotNull() & atoms["C6"].isNotNull()
    return F.when(there, vec.plane(atoms["C2"], atoms["C4"], atoms["C6"]))


def mpp(ca: Column, before: Column, after: Column) -> Column:
    """For CA traces: off CA, away from its neighbours; for one alone along x."""
    both = vec.add(vec.sub(ca, before), vec.sub(ca, after))
    one = F.coalesce(F.when(before.isNotNull(), vec.sub(ca, before)), F.when(after.isNotNull(), vec.sub(ca, after)), vec.point(1, 0, 0))
    away = vec.let(F.when(before.isNotNull() & after.isNotNull(), both).otherwise(one), lambda v: vec.scale(vec.unit(v), REACH))
    return vec.add(ca, away)


def last_sc(atoms: Column) -> Column:
    """The last side-chain bead, else BB."""
    n = F.size(F.map_filter(atoms, lambda k, _: k.startswith("SC")))
    return F.coalesce(atoms[F.concat(F.lit("SC"), n.cast("string"))], atoms["BB"])


def representation(points: Column, profile: Profile) -> Column:
    """The points that stand for a mer, in order."""
    return F.array(*[points[p] for p in profile.indicators])
