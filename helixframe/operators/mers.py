"""From atoms to numbered, classified and linked mers, and windows along their chains.

Every window is partitioned by (structure_id, chain) or finer; keys lead with structure_id, so one exchange serves all.
Columns `model` and `frame`, where present, are part of the key by the `also` arguments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import vec
from helixframe.functions.profiles import FULL_ATOM, LETTERS, MODIFIED, OTHER_RADIUS, RADII, SIMPLE_SS, SOLVENT, UNKNOWN_LETTER, Profile, code_map

S = "structure_id"


def drop_solvent(rows: DataFrame, name: str = "name", solvent: Sequence[str] = SOLVENT) -> DataFrame:
    return rows.where(~F.col(name).isin(*solvent))


def group_atoms(atoms: DataFrame, *also: str) -> DataFrame:
    """One row for each residue or other atom set: name, atoms by name, and its first place in the file."""
    point = vec.point(F.col("x"), F.col("y"), F.col("z"))
    entry = F.struct(F.col("atom_name"), point.alias("p"))
    return atoms.groupBy(S, *also, "chain", "num", "icode").agg(F.min_by("res_name", "pos").alias("name"), F.map_from_entries(F.collect_list(entry)).alias("atoms"), F.min("pos").alias("pos"))


def classify_mers(sets: DataFrame, profiles: Sequence[Profile] = FULL_ATOM, *also: str) -> DataFrame:
    """Adds type and chainable. A set can be of any profile whose backbone it has; the commonest of these in a chain
    wins (ties: the one listed first), and what isn't of that type is an ion if it has one atom, else a compound."""
    names = F.map_keys("atoms")
    fits = [F.size(F.array_except(F.array(*map(F.lit, p.backbone)), names)) == 0 for p in profiles]
    sets = sets.withColumn("_fits", F.array_compact(F.array(*[F.when(f, F.lit(k)) for k, f in enumerate(fits)])))
    votes = sets.select(S, *also, "chain", F.explode("_fits").alias("k")).groupBy(S, *also, "chain", "k").agg(F.count("*").alias("n"))
    best = votes.groupBy(S, *also, "chain").agg(F.max_by("k", F.struct("n", -F.col("k"))).alias("_best"))
    out = sets.join(best, [S, *also, "chain"], "left")
    won = F.coalesce(F.array_contains("_fits", F.col("_best")), F.lit(False))
    types = F.array(*[F.lit(p.type) for p in profiles])
    kind = F.when(won, F.element_at(types, F.col("_best") + 1)).when(F.size("atoms") == 1, "MonoatomicIon").otherwise("Compound")
    return out.select(*[c for c in sets.columns if c != "_fits"], kind.alias("type"), won.alias("chainable"))


def check_bond_distances(mers: DataFrame, bonds: Sequence[tuple[str, str, float, float]]) -> DataFrame:
    """Keeps mers whose given pairs of atoms are between the given distances."""
    ok = F.lit(True)
    for a, b, low, high in bonds:
        ok = ok & vec.distance(F.col("atoms")[a], F.col("atoms")[b]).between(low, high)
    return mers.where(ok)


def assign_inds(sets: DataFrame, *also: str) -> DataFrame:
    """Adds ind, from 0 in file order, and `duplicate` for ids that occur more than once in a structure."""
    w = Window.partitionBy(S, *also)
    same = Window.partitionBy(S, *also, "chain", "num", "icode")
    return sets.select("*", (F.row_number().over(w.orderBy("pos")) - 1).alias("ind"), (F.count("*").over(same) > 1).alias("duplicate"))


def sequence_letter(name: Column) -> Column:
    return F.coalesce(code_map(LETTERS)[name], code_map(MODIFIED)[name], F.lit(UNKNOWN_LETTER))


def simple_ss(ss: Column) -> Column:
    return F.coalesce(code_map(SIMPLE_SS)[ss], F.lit("C"))


def ion_radius(atom: Column) -> Column:
    return F.coalesce(code_map(RADII)[atom], F.lit(OTHER_RADIUS))


def sequence(mers: DataFrame, letter: Column, *by: str) -> DataFrame:
    """The letters of chainable mers in order, one string for each structure, chain or other group."""
    ordered = F.array_sort(F.collect_list(F.struct("ind", letter.alias("letter"))))
    return mers.where("chainable").groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["letter"]), "").alias("sequence"))


def link_mers(mers: DataFrame, first: str, last: str, threshold: float, *also: str) -> DataFrame:
    """Adds next_ind and prev_ind: neighbours of one type in a chain, the last backbone atom of one near the first of
    the next."""
    w = Window.partitionBy(S, *also, "chain").orderBy("ind")
    near = lambda a, b: vec.distance(a, b) <= threshold
    atoms = F.col("atoms")
    ahead = (F.lead("type").over(w) == F.col("type")) & near(atoms[last], F.lead(atoms[first]).over(w))
    behind = (F.lag("type").over(w) == F.col("type")) & near(F.lag(atoms[last]).over(w), atoms[first])
    return mers.select("*", F.when(F.col("chainable") & ahead, F.lead("ind").over(w)).alias("next_ind"), F.when(F.col("chainable") & behind, F.lag("ind").over(w)).alias("prev_ind"))


def backbone_average(linked: DataFrame, size: int = 3, *also: str) -> DataFrame:
    """Adds `average`: the mean CA of `size` mers around each one, growing outwards only while both sides are bonded."""
    w = Window.partitionBy(S, *also, "chain").orderBy("ind")
    ca = F.col("atoms")["CA"]
    ok, points = F.lit(True), [ca]
    ways = []
    for k in range(1, size // 2 + 1):
        step_on = F.lead("prev_ind", k).over(w).isNotNull()
        step_back = F.lag("next_ind", k).over(w).isNotNull()
        ok = ok & step_on & step_back
        points = [F.lag(ca, k).over(w), *points, F.lead(ca, k).over(w)]
        ways.append((ok, vec.mid(*points)))
    out = ca
    for ok, mean in ways:
        out = F.when(ok, mean).otherwise(out)
    return linked.withColumn("average", F.when(F.col("chainable"), out))


def adjusted_length(averaged: DataFrame, *also: str) -> DataFrame:
    """Adds the distance between a mer's backbone average and the next one's; null at the ends of bonded runs."""
    w = Window.partitionBy(S, *also, "chain").orderBy("ind")
    return averaged.withColumn("adjusted_length", F.when(F.col("next_ind").isNotNull(), vec.distance(F.col("average"), F.lead("average").over(w))))


def torsion_angles(linked: DataFrame, *also: str) -> DataFrame:
    """Adds psi and phi, 0 where the neighbour is missing."""
    w = Window.partitionBy(S, *also, "chain").orderBy("ind")
    a = F.col("atoms")
    n, ca, c = a["N"], a["CA"], a["C"]

    def angle(p1, p2, p3, p4):
        first, second = vec.cross(vec.sub(p2, p1), vec.sub(p3, p2)), vec.cross(vec.sub(p3, p2), vec.sub(p4, p3))
        return F.atan2(vec.dot(vec.cross(first, second), vec.unit(vec.sub(p3, p2))), vec.dot(first, second))

    rows = linked.select("*", F.lead(n).over(w).alias("_n1"), F.lag(c).over(w).alias("_c1"))
    psi = F.when(F.col("next_ind").isNotNull(), angle(n, ca, c, F.col("_n1"))).otherwise(0.0)
    phi = F.when(F.col("prev_ind").isNotNull(), angle(F.col("_c1"), n, ca, c)).otherwise(0.0)
    return rows.select("*", psi.alias("psi"), phi.alias("phi")).drop("_n1", "_c1")


def segments(linked: DataFrame, *also: str) -> DataFrame:
    """Adds seg, the number of a mer's bonded run in its structure, over the chainable mers that are given."""
    w = Window.partitionBy(S, *also).orderBy("ind")
    follows = F.coalesce(F.lag("next_ind").over(w) == F.col("ind"), F.lit(False))
    rows = linked.where("chainable").withColumn("_cut", F.when(follows, 0).otherwise(1))
    return rows.withColumn("seg", (F.sum("_cut").over(w) - 1).cast("int")).drop("_cut")


def segment_table(with_seg: DataFrame, *also: str) -> DataFrame:
    return with_seg.groupBy(S, *also, "seg").agg(F.min("ind").alias("start_ind"), F.max("ind").alias("end_ind"), F.count("*").cast("int").alias("len"))


def elements(with_seg: DataFrame, ligands: DataFrame | None = None, length: int = 5, *also: str) -> DataFrame:
    """(centre, inds) of windows of `length` bonded mers; a ligand is an element alone. An even length is an error."""
    if length % 2 == 0:
        raise ValueError("an element has an odd number of mers")
    w = Window.partitionBy(S, *also, "seg").orderBy("ind").rowsBetween(-(length // 2), length // 2)
    rows = with_seg.select(S, *also, F.col("ind").alias("centre"), F.collect_list("ind").over(w).alias("inds")).where(F.size("inds") == length)
    if ligands is not None:
        rows = rows.unionByName(ligands.where("NOT chainable").select(S, *also, F.col("ind").alias("centre"), F.array("ind").alias("inds")))
    return rows


def next_in_subset(subset: DataFrame, *also: str) -> DataFrame:
    """Adds next_in_subset: the bonded next mer, if it is in the subset."""
    w = Window.partitionBy(S, *also).orderBy("ind")
    return subset.withColumn("next_in_subset", F.when(F.lead("ind").over(w) == F.col("next_ind"), F.col("next_ind")))


def adjusted_number(with_seg: DataFrame, *also: str) -> DataFrame:
    """(seg, adjusted_number): a segment's summed adjusted lengths, without two mers at either end, over 18 Angstrom and
    rounded up; 1 where that is nothing."""
    w = Window.partitionBy(S, *also, "seg")
    rows = with_seg.select("*", F.row_number().over(w.orderBy("ind")).alias("_k"), F.count("*").over(w).alias("_n"))
    inner = F.when((F.col("_k") > 2) & (F.col("_k") <= F.col("_n") - 2), F.col("adjusted_length"))
    return rows.groupBy(S, *also, "seg").agg(F.greatest(F.lit(1), F.coalesce(F.ceil(F.sum(inner) / 18.0), F.lit(1))).cast("int").alias("adjusted_number"))
