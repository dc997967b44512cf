"""Queries that use the library's hooks: own criteria, points, representations and selections."""

from pyspark.sql import functions as F

from helixframe.functions import points as P
from helixframe.functions import vec
from helixframe.functions.profiles import Profile
from helixframe.jobs import views as W
from helixframe.jobs.contact_queries import ALL, mers, pairs_sql
from helixframe.jobs.mer_queries import CB, CLASSES, IDS, O, rounded
from helixframe.jobs.registry import query
from helixframe.operators import contacts as K
from helixframe.operators import mers as M
from helixframe.operators import selection as sel

LEVEL = K.Criterion(lambda: F.when(F.abs(F.col("a_ca")["z"] - F.col("b_ca")["z"]) <= 1.5, 2).otherwise(0), ("ca",))
TIP = Profile("Tip", ("CB", "O"), ("CB", "tip"), 3.0, {"CB": lambda atoms: atoms["CB"], "tip": lambda atoms: vec.mid(atoms["CB"], atoms["O"])})


@query("x1_custom_criterion", f"WITH {pairs_sql('CASE WHEN abs(a.ca_z - b.ca_z) <= 1.5 THEN 2 ELSE 0 END')} {ALL}")
def x1(spark, d):
    return K.contact_map(mers(spark, d), LEVEL)


@query("x2_custom_points", f"WITH {W.MERS} SELECT structure_id, ind, {W.select((CB + O) * '1 / 2.0', 'tip')} FROM mers")
def x2(spark, d):
    return W.mers(spark, d).select(*IDS, *rounded(TIP.points["tip"](F.col("atoms")), "tip"))


@query("x3_custom_representation", f"""WITH {CLASSES}, r AS (SELECT structure_id, chain, num, CASE WHEN list_has_all(ats, ['CB', 'O']) THEN 'Tip' WHEN len(ats) = 1 THEN 'MonoatomicIon' ELSE 'Compound' END AS type FROM t) SELECT * FROM r""")
def x3(spark, d):
    """Own classes of mers by their own backbone; their representation comes from the profile's points."""
    rows = M.classify_mers(M.group_atoms(W.atoms(spark, d)), [TIP])
    named = F.create_map(*[x for name, f in TIP.points.items() for x in (F.lit(name), f(F.col("atoms")))])
    rows = rows.withColumn("shape", P.representation(named, TIP))
    return rows.where(F.size("shape") == len(TIP.indicators)).select("structure_id", "chain", "num", "type")


@query("x4_custom_attribute", f"WITH {W.MERS} SELECT structure_id, ind FROM mers WHERE ss IN ('H', 'G')")
def x4(spark, d):
    return W.mers(spark, d).where(sel.sel_attribute("ss", "H", "G")).select(*IDS)
