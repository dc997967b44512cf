"""Queries over mers: filters, classes, numbering, windows, points and geometry."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from helixframe.functions import points as P
from helixframe.functions import vec
from helixframe.functions.profiles import CA_TRACE, FULL_ATOM, MARTINI, P_TRACE
from helixframe.jobs import views as W
from helixframe.jobs.registry import query
from helixframe.operators import mers as M
from helixframe.operators import selection as sel

R = 6
CA, N, C, CB, O = (W.v(x) for x in ("ca", "n", "c", "cb", "o"))


def rounded(p, name):
    return [(F.round(p[i], R) + 0.0).alias(f"{name}_{i}") for i in vec.AXES]


def num(c):
    return F.round(c, R) + 0.0


def sql_map(codes, key):
    return f"(MAP {{{', '.join(f"'{a}': '{b}'" for a, b in codes.items())}}})[{key}]".replace("''", "'")


def case_map(codes, key, other):
    quote = lambda x: f"'{str(x).replace(chr(39), chr(39) * 2)}'" if isinstance(x, str) else str(x)
    return f"CASE {key} " + " ".join(f"WHEN {quote(a)} THEN {quote(b)}" for a, b in codes.items()) + f" ELSE {quote(other)} END"


IDS = ("structure_id", "ind")


def A():
    return F.col("atoms")


@query("p1_drop_solvent", f"WITH {W.ATOM_ROWS} SELECT structure_id, chain, num, atom_name FROM atoms WHERE res_name <> 'HOH'")
def p1(spark, d):
    return M.drop_solvent(W.atoms(spark, d), "res_name").select("structure_id", "chain", "num", "atom_name")


CLASSES = f"""{W.ATOM_ROWS}, g AS (SELECT structure_id, chain, num, min(pos) AS pos, arg_min(res_name, pos) AS name, list(atom_name) AS ats FROM atoms GROUP BY ALL),
t AS (SELECT *, CASE WHEN list_has_all(ats, ['N', 'CA', 'C']) THEN 'Residue' WHEN len(ats) = 1 THEN 'MonoatomicIon' ELSE 'Compound' END AS type,
  list_has_all(ats, ['N', 'CA', 'C']) AS chainable FROM g)"""


def classified(spark, d):
    return M.classify_mers(M.group_atoms(W.atoms(spark, d)))


@query("p2_classify_mers", f"WITH {CLASSES} SELECT structure_id, chain, num, name, type, chainable FROM t")
def p2(spark, d):
    return classified(spark, d).select("structure_id", "chain", "num", "name", "type", "chainable")


@query("p3_check_bond_distances", f"WITH {W.MERS} SELECT structure_id, ind FROM mers WHERE {W.slen(CA - N)} BETWEEN 0.5 AND 1.5 AND {W.slen(C - CA)} BETWEEN 0.5 AND 1.5")
def p3(spark, d):
    return M.check_bond_distances(W.mers(spark, d), [("N", "CA", 0.5, 1.5), ("CA", "C", 0.5, 1.5)]).select(*IDS)


@query("p4_coarse_representation", f"""WITH {W.ATOM_ROWS}, g AS (SELECT structure_id, chain, num, list(atom_name) AS ats FROM atoms GROUP BY ALL)
SELECT structure_id, chain, num, CASE WHEN list_contains(ats, 'CA') THEN 'CATrace' WHEN len(ats) = 1 THEN 'MonoatomicIon' ELSE 'Compound' END AS type FROM g""")
def p4(spark, d):
    return M.classify_mers(M.group_atoms(W.atoms(spark, d)), [CA_TRACE]).select("structure_id", "chain", "num", "type")


def renamed(spark, d, names):
    """The view's atoms under the names of another representation, those of bonded mers only."""
    name = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("atom_name"))
    return W.atoms(spark, d).withColumn("atom_name", name).where("atom_name IS NOT NULL")


def coarse_sql(names, type_, backbone):
    """Classes, and links of the chainable ones: the next mer of a chain, with its backbone atom within the bond's reach."""
    own = ", ".join(f"'{a}'" for a in names)
    return f"""WITH {W.ATOM_ROWS}, g AS (SELECT structure_id, chain, num, ind, list(atom_name) AS ats FROM atoms WHERE atom_name IN ({own}) GROUP BY ALL),
    c AS (SELECT structure_id, chain, num, ind, CASE WHEN list_contains(ats, '{backbone}') THEN '{type_}' WHEN len(ats) = 1 THEN 'MonoatomicIon' ELSE 'Compound' END AS type FROM g)"""


@query("p4_p_trace", f"{coarse_sql(('N', 'CA', 'O'), 'PTrace', 'CA')} SELECT structure_id, chain, num, type FROM c")
def p4b(spark, d):
    return M.classify_mers(M.group_atoms(renamed(spark, d, {"CA": "P", "N": "OP1", "O": "OP2"})), [P_TRACE]).select("structure_id", "chain", "num", "type")


_LINKED = f"{coarse_sql(('CA', 'CB', 'O'), 'MartiniResidue', 'CA')}, w AS (SELECT c.*, {', '.join(f'm.ca_{i}' for i in 'xyz')} FROM c JOIN mers m USING (structure_id, ind)), x AS (SELECT *, {', '.join(f'lead(ca_{i}) OVER n AS n_{i}' for i in 'xyz')}, lead(type) OVER n AS next_type, lead(num) OVER n AS next_num FROM w WINDOW n AS (PARTITION BY structure_id, chain ORDER BY ind))"


@query("p4_martini", f"{_LINKED} SELECT structure_id, chain, num, type, CASE WHEN type = 'MartiniResidue' AND next_type = type AND sqrt((ca_x - n_x) * (ca_x - n_x) + (ca_y - n_y) * (ca_y - n_y) + (ca_z - n_z) * (ca_z - n_z)) <= 20.0 THEN next_num END AS next_num FROM x")
def p4c(spark, d):
    """Beads BB, SC1 and SC2; linked by the profile's backbone bead, with the view's wide bonds."""
    sets = M.classify_mers(M.group_atoms(renamed(spark, d, {"CA": "BB", "CB": "SC1", "O": "SC2"})), [MARTINI]).withColumn("ind", F.col("pos"))
    linked_ = M.link_mers(sets, MARTINI.backbone[0], MARTINI.backbone[-1], W.BOND)
    ids = linked_.select("structure_id", F.col("ind").alias("next_ind"), F.col("num").alias("next_num"))
    return linked_.join(ids, ["structure_id", "next_ind"], "left").select("structure_id", "chain", "num", "type", "next_num")


@query("p5_sel_set", f"WITH {W.MERS} SELECT structure_id, ind FROM mers WHERE vec_id % 7 = 0")
def p5(spark, d):
    m = W.mers(spark, d)
    return sel.sel_set(m, m.where("vec_id % 7 = 0").select("structure_id", "chain", "num", "icode")).select(*IDS)


@query("p6_sel_range", f"WITH {W.MERS} SELECT structure_id, ind FROM mers WHERE ind BETWEEN 4 AND 27")
def p6(spark, d):
    return sel.sel_range(W.mers(spark, d), "A:5", "B:8").select(*IDS)


@query("p7_sel_chain_name", f"WITH {W.MERS} SELECT structure_id, ind FROM mers WHERE chain IN ('A', 'C') AND name IN ('GLY', 'ALA')")
def p7(spark, d):
    return W.mers(spark, d).where(sel.sel_chain("A", "C") & sel.sel_name("GLY", "ALA")).select(*IDS)


@query("p8_sel_type", f"WITH {W.MERS} SELECT structure_id, ind, type FROM mers")
def p8(spark, d):
    m = W.mers(spark, d)
    return m.where(sel.sel_exact_type("Residue") & sel.sel_subclass("Mer")).unionByName(m.where(sel.sel_subclass("Ligand"))).select(*IDS, "type")


@query("p9_sel_all_none", f"WITH {W.MERS} SELECT structure_id, count(*) AS n FROM mers GROUP BY 1")
def p9(spark, d):
    m = W.mers(spark, d)
    return m.where(sel.sel_all() | sel.sel_none()).groupBy("structure_id").agg(F.count("*").alias("n"))


@query("p10_slice_mers", f"WITH {W.MERS} SELECT structure_id, ind FROM mers WHERE ind <= 10 OR ind BETWEEN 15 AND 20 OR ind IN (22, 25)")
def p10(spark, d):
    m = W.mers(spark, d)
    return sel.slice_mers(m, stop=10).unionByName(sel.slice_mers(m, 15, 20)).unionByName(sel.slice_mers(m, inds=[25, 22, 25])).select(*IDS)


@query("p11_lookup_pdb_ids", f"WITH {W.MERS} SELECT structure_id, ind FROM mers WHERE chain = 'B' OR num = 7 OR ind BETWEEN 2 AND 4")
def p11(spark, d):
    m = W.mers(spark, d)
    parts = [sel.lookup_pdb_ids(m, t) for t in ("B:", "7", "A:3-A:5", "A:7")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).dropDuplicates(list(IDS)).select(*IDS)


@query("p12_pdb_id_text", f"WITH {W.MERS} SELECT structure_id, ind, chain, num, chain || ':' || num AS text FROM mers")
def p12(spark, d):
    m = W.mers(spark, d).withColumn("text", sel.format_pdb_id(F.col("chain"), F.col("num"), F.col("icode")))
    p = sel.parse_pdb_id(F.col("text"))
    return m.select(*IDS, p["chain"].alias("chain"), p["num"].alias("num"), "text")


# Expected values as plain text, apart from the library's tables.
EXPECTED_LETTERS = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V", "MSE": "M"}
MODIFIED_CASES = "GLX=Z ASX=B A=A C=C G=G U=U DA=A DC=C DG=G DT=T DNP=A DAL=A CSD=A SEG=A DVA=V MVA=V NLE=L BUG=L DIL=I HYP=P DPR=P FME=M CXM=M DPN=F PHL=F HTR=W SAR=G GL3=G SEP=S OAS=S TPO=T BMT=T CSO=C C5C=C 2AS=D 5HP=E KCX=K LLP=K DAR=R AGM=R HIP=H 3AH=H MEN=N MGN=Q PTR=Y TYI=Y XYZ=? HOH=? MLY=?"
SS_CASES = "H:H B:E E:E G:H I:H T:C S:C -:C =:="
ION_CASES = "BE=0.59 BA=1.49 RH=0.805 P=0.58 GD=1.078 C=0.3 HG=1.33 ZN=0.88 K=1.52 O=1.26 MG=0.86 MN=0.97 FE=0.92 NA=1.16 ES=0.928 CO=0.885 CL=1.67 CA=1.14 CU=0.91 LA=1.172 LU=1.001 TE=2.07 AL=0.675 U=1.165 XE=0.62 XX=2.5"


def cases(text):
    return [tuple(c.split(":" if ":" in c else "=")) for c in text.split()]


def case_name(pairs):
    """A name for each part, one after the other."""
    return F.element_at(F.array(*[F.lit(a) for a, _ in pairs]), (F.col("p_partkey") % len(pairs) + 1).cast("int"))


def case_sql(pairs, column, kind):
    at = f"[CAST(p_partkey % {len(pairs)} + 1 AS INTEGER)]"
    return f"SELECT p_partkey, (['{"', '".join(a for a, _ in pairs)}']){at} AS name, CAST((['{"', '".join(b for _, b in pairs)}']){at} AS {kind}) AS {column} FROM part"


@query("p13_sequence_letter", f"WITH {CLASSES} SELECT structure_id, chain, num, {case_map(EXPECTED_LETTERS, 'name', '?')} AS letter FROM t")
def p13(spark, d):
    return M.group_atoms(W.atoms(spark, d)).select("structure_id", "chain", "num", M.sequence_letter(F.col("name")).alias("letter"))


@query("p13_modified_letters", case_sql(cases(MODIFIED_CASES), "letter", "VARCHAR"))
def p13b(spark, d):
    return W.table(spark, d, "part").select("p_partkey", case_name(cases(MODIFIED_CASES)).alias("name")).withColumn("letter", M.sequence_letter(F.col("name")))


@query("p14_simple_ss", case_sql(cases(SS_CASES), "simple", "VARCHAR"))
def p14(spark, d):
    return W.table(spark, d, "part").select("p_partkey", case_name(cases(SS_CASES)).alias("name")).withColumn("simple", M.simple_ss(F.col("name")))


@query("p15_ion_radius", f"WITH {CLASSES} SELECT structure_id, chain, num, CAST(CASE name WHEN 'MG' THEN 0.86 ELSE 2.5 END AS DOUBLE) AS radius FROM t WHERE type = 'MonoatomicIon'")
def p15(spark, d):
    ions = classified(spark, d).where(sel.sel_exact_type("MonoatomicIon"))
    return ions.select("structure_id", "chain", "num", M.ion_radius(F.col("name")).alias("radius"))


@query("p15_ion_radii", case_sql(cases(ION_CASES), "radius", "DOUBLE"))
def p15b(spark, d):
    return W.table(spark, d, "part").select("p_partkey", case_name(cases(ION_CASES)).alias("name")).withColumn("radius", M.ion_radius(F.col("name")))


@query("a1_assign_inds", f"WITH {CLASSES} SELECT structure_id, chain, num, CAST(row_number() OVER (PARTITION BY structure_id ORDER BY pos) - 1 AS INTEGER) AS ind, false AS duplicate FROM t WHERE name <> 'HOH'")
def a1(spark, d):
    return M.assign_inds(M.drop_solvent(M.group_atoms(W.atoms(spark, d)))).select("structure_id", "chain", "num", "ind", "duplicate")


@query("a3_sequence", f"WITH {W.MERS} SELECT structure_id, chain, string_agg({case_map(EXPECTED_LETTERS, 'name', '?')}, '' ORDER BY ind) AS sequence FROM mers WHERE chainable GROUP BY 1, 2")
def a3(spark, d):
    return M.sequence(W.mers(spark, d), M.sequence_letter(F.col("name")), "structure_id", "chain")


@query("a4_ss_sequence", f"WITH {W.MERS} SELECT structure_id, string_agg({case_map({'H': 'H', 'B': 'E', 'E': 'E', 'G': 'H', 'I': 'H', 'T': 'C', 'S': 'C', '-': 'C'}, 'ss', 'C')}, '' ORDER BY ind) AS sequence FROM mers WHERE chainable GROUP BY 1")
def a4(spark, d):
    return M.sequence(W.mers(spark, d), M.simple_ss(F.col("ss")), "structure_id")


# Windows along chains.

LINKED = f"""{W.MERS}, near AS (SELECT *, lead(type) OVER w AS t1, lag(type) OVER w AS t0, lead(ind) OVER w AS i1, lag(ind) OVER w AS i0,
  {", ".join(f"lead(n_{i}) OVER w AS n1_{i}, lag(c_{i}) OVER w AS c0_{i}" for i in "xyz")} FROM mers WINDOW w AS (PARTITION BY structure_id, chain ORDER BY ind)),
linked AS (SELECT *, CASE WHEN chainable AND t1 = type AND {W.slen(C - W.v("n1"))} <= {W.BOND} THEN i1 END AS next_ind,
  CASE WHEN chainable AND t0 = type AND {W.slen(W.v("c0") - N)} <= {W.BOND} THEN i0 END AS prev_ind FROM near)"""


def linked(spark, d):
    return M.link_mers(W.mers(spark, d), "N", "C", W.BOND)


@query("w1_link_mers", f"WITH {LINKED} SELECT structure_id, ind, next_ind, prev_ind FROM linked")
def w1(spark, d):
    return linked(spark, d).select(*IDS, "next_ind", "prev_ind")


AVERAGED = f"""{LINKED}, av AS (SELECT *, {", ".join(f"CASE WHEN chainable AND next_ind IS NOT NULL AND prev_ind IS NOT NULL THEN (lag(ca_{i}) OVER w + ca_{i} + lead(ca_{i}) OVER w) / 3 WHEN chainable THEN ca_{i} END AS av_{i}" for i in "xyz")}
  FROM linked WINDOW w AS (PARTITION BY structure_id, chain ORDER BY ind)),
al AS (SELECT *, CASE WHEN next_ind IS NOT NULL THEN {W.slen(W.V(f"(av_{i} - lead(av_{i}) OVER w)" for i in "xyz"))} END AS adjusted_length FROM av WINDOW w AS (PARTITION BY structure_id, chain ORDER BY ind))"""


@query("w2_backbone_average", f"WITH {AVERAGED} SELECT structure_id, ind, {W.select(W.v('av'), 'average')} FROM al WHERE chainable")
def w2(spark, d):
    return M.backbone_average(linked(spark, d)).where("chainable").select(*IDS, *rounded(F.col("average"), "average"))


@query("w3_adjusted_length", f"WITH {AVERAGED} SELECT structure_id, ind, round(adjusted_length, 6) AS adjusted_length FROM al")
def w3(spark, d):
    return M.adjusted_length(M.backbone_average(linked(spark, d))).select(*IDS, F.round("adjusted_length", R).alias("adjusted_length"))


def _torsion(p1, p2, p3, p4):
    f, s = W.scross(p2 - p1, p3 - p2), W.scross(p3 - p2, p4 - p3)
    return f"atan2({W.sdot(W.scross(f, s), W.sunit(p3 - p2))}, {W.sdot(f, s)})"


@query("w4_torsion_angles", f"""WITH {LINKED} SELECT structure_id, ind, round(CASE WHEN next_ind IS NOT NULL THEN {_torsion(N, CA, C, W.v("n1"))} ELSE 0.0 END, 6) + 0.0 AS psi,
round(CASE WHEN prev_ind IS NOT NULL THEN {_torsion(W.v("c0"), N, CA, C)} ELSE 0.0 END, 6) + 0.0 AS phi FROM linked""")
def w4(spark, d):
    return M.torsion_angles(linked(spark, d)).select(*IDS, num(F.col("psi")).alias("psi"), num(F.col("phi")).alias("phi"))


SEGS = f"""{AVERAGED}, sg AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY structure_id ORDER BY ind) - 1 AS INTEGER) AS seg FROM
  (SELECT *, CASE WHEN lag(next_ind) OVER (PARTITION BY structure_id ORDER BY ind) = ind THEN 0 ELSE 1 END AS cut FROM al WHERE chainable))"""


@query("w5_segments", f"WITH {SEGS} SELECT structure_id, seg, min(ind) AS start_ind, max(ind) AS end_ind, CAST(count(*) AS INTEGER) AS len FROM sg GROUP BY 1, 2")
def w5(spark, d):
    return M.segment_table(M.segments(linked(spark, d)))


@query("w6_elements", f"""WITH {SEGS} SELECT structure_id, centre, CAST(unnest(inds) AS INTEGER) AS ind FROM (SELECT structure_id, ind AS centre, list(ind) OVER (PARTITION BY structure_id, seg ORDER BY ind ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS inds FROM sg)
WHERE len(inds) = 5 UNION ALL SELECT structure_id, ind, ind FROM mers WHERE NOT chainable""")
def w6(spark, d):
    k = linked(spark, d)
    return M.elements(M.segments(k), k).select("structure_id", "centre", F.explode("inds").alias("ind"))


@query("w8_next_mer_in_subset", f"""WITH {LINKED}, s AS (SELECT * FROM linked WHERE vec_id % 3 <> 0)
SELECT structure_id, ind, CASE WHEN lead(ind) OVER (PARTITION BY structure_id ORDER BY ind) = next_ind THEN next_ind END AS next_in_subset FROM s""")
def w8(spark, d):
    return M.next_in_subset(linked(spark, d).where("vec_id % 3 <> 0")).select(*IDS, "next_in_subset")


@query("a8_adjusted_number", f"""WITH {SEGS}, r AS (SELECT *, row_number() OVER (PARTITION BY structure_id, seg ORDER BY ind) AS k, count(*) OVER (PARTITION BY structure_id, seg) AS n FROM sg)
SELECT structure_id, seg, CAST(greatest(1, coalesce(ceil(sum(CASE WHEN k > 2 AND k <= n - 2 THEN adjusted_length END) / 18.0), 1)) AS INTEGER) AS adjusted_number FROM r GROUP BY 1, 2""")
def a8(spark, d):
    return M.adjusted_number(M.segments(M.adjusted_length(M.backbone_average(linked(spark, d)))))


# Geometry.

def p_():
    return A()["N"]


def q_():
    return A()["CA"]


def r_():
    return A()["C"]


@query("g1_vector_algebra", f"""WITH {W.MERS} SELECT structure_id, ind, {W.select(N + CA, "sum")}, {W.select(N - CA, "diff")}, {W.select(N * 2.5, "scaled")}, round({W.slen(N)}, 6) AS size,
{W.select(W.sunit(N), "unit")}, {W.select(N * f"({W.slen(N)} + 2.0) / {W.slen(N)}", "longer")} FROM mers""")
def g1(spark, d):
    m = W.mers(spark, d)
    return m.select(*IDS, *rounded(vec.add(p_(), q_()), "sum"), *rounded(vec.sub(p_(), q_()), "diff"), *rounded(vec.scale(p_(), 2.5), "scaled"), F.round(vec.length(p_()), R).alias("size"), *rounded(vec.unit(p_()), "unit"), *rounded(vec.extend(p_(), 2.0), "longer"))


def _turn(spark_side: bool):
    rot = (0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)
    if spark_side:
        return F.struct(vec.point(1, 2, 3).alias("pre"), F.array(*map(F.lit, rot)).alias("rot"), vec.point(-1, 0, 0.5).alias("post"))
    x, y, z = (f"({c} + {k})" for c, k in zip(CA, (1.0, 2.0, 3.0), strict=True))
    return W.V((f"(0.0 - {y} - 1.0)", f"({x})", f"({z} + 0.5)"))


@query("g2_transform_coords", f"WITH {W.MERS} SELECT structure_id, ind, {W.select(_turn(False), 'moved')} FROM mers")
def g2(spark, d):
    return W.mers(spark, d).select(*IDS, *rounded(vec.transform(q_(), _turn(True)), "moved"))


@query("g3_compose_transforms", f"WITH {W.MERS} SELECT structure_id, ind, {W.select(_turn(False) + W.V(('2.0', '0.0', '0.0')), 'moved')} FROM mers")
def g3(spark, d):
    both = vec.compose(_turn(True), vec.translation(vec.point(2, 0, 0)))
    return W.mers(spark, d).select(*IDS, *rounded(vec.transform(q_(), both), "moved"))


def _plane(a, b, c):
    n = W.sunit(W.scross(a - b, c - b))
    return n, f"(-{W.sdot(n, a)})"


_N1, _D1 = _plane(N, CA, C)
PLANES = f"{W.MERS}, pl AS (SELECT *, {', '.join(f'{e} AS p_{i}' for e, i in zip(_N1, 'xyz', strict=True))}, {_D1} AS p_d, {', '.join(f'{e} AS q_{i}' for e, i in zip(_plane(CA, C, O)[0], 'xyz', strict=True))}, {_plane(CA, C, O)[1]} AS q_d FROM mers)"
PN, QN = W.v("p"), W.v("q")


@query("g4_planes", f"WITH {PLANES} SELECT structure_id, ind, {W.select(PN, 'normal')}, round(p_d, 6) + 0.0 AS d, {W.select(CB - PN * f'{W.sdot(PN, CB)} + p_d', 'foot')} FROM pl")
def g4(spark, d):
    m = W.mers(spark, d).withColumn("pl", vec.plane(p_(), q_(), r_()))
    return m.select(*IDS, *rounded(F.col("pl")["normal"], "normal"), num(F.col("pl")["d"]).alias("d"), *rounded(vec.project_on_plane(A()["CB"], F.col("pl")), "foot"))


_X = W.scross(PN, QN)
_SIDE = f"CASE WHEN {W.sdot(PN, QN)} < 0 THEN -1.0 ELSE 1.0 END"


@query("g5_dihedral", f"""WITH {PLANES} SELECT structure_id, ind, round(CASE WHEN {W.sdot(_X, C - CA)} < 0 THEN -1 ELSE 1 END * atan2({W.slen(_X)}, {W.sdot(PN, QN)}), 6) + 0.0 AS angle,
round({W.sdot(PN, QN)}, 6) + 0.0 AS cosine, {W.select(W.sunit(PN + QN * _SIDE), "halfway")} FROM pl""")
def g5(spark, d):
    m = W.mers(spark, d).withColumns({"p": vec.plane(p_(), q_(), r_()), "q": vec.plane(q_(), r_(), A()["O"])})
    p, q = F.col("p"), F.col("q")
    return m.select(*IDS, num(vec.dihedral_angle(p, q, vec.sub(r_(), q_()))).alias("angle"), num(vec.dihedral_cos(p, q)).alias("cosine"), *rounded(vec.bisection_plane(p, q)["normal"], "halfway"))


@query("g6_gc", f"WITH {W.MERS} SELECT structure_id, ind, {W.select((CA + N + C + CB + O) * '1 / 5.0', 'gc', 5)} FROM mers")
def g6(spark, d):
    return W.mers(spark, d).select(*IDS, *[(F.round(P.gc(A())[i], 5) + 0.0).alias(f"gc_{i}") for i in vec.AXES])


@query("g7_rc", f"WITH {W.MERS} SELECT structure_id, ind, {', '.join(f'round(CASE WHEN chainable THEN {a} ELSE {b} END, 5) + 0.0 AS rc_{i}' for a, b, i in zip((CB + O) * '0.5', (CA + N + C + CB + O) * '0.2', 'xyz', strict=True))} FROM mers")
def g7(spark, d):
    return W.mers(spark, d).select(*IDS, *[(F.round(P.rc(A(), F.col("chainable"))[i], 5) + 0.0).alias(f"rc_{i}") for i in vec.AXES])


_GLY = CA + W.sunit((N - CA) + (C - CA)) * 2.53
_CBX = CA + (CB - CA) * f"({W.slen(CB - CA)} + 1.0) / {W.slen(CB - CA)}"
CBX = W.V(f"CASE WHEN name = 'GLY' THEN {a} ELSE {b} END" for a, b in zip(_GLY, _CBX, strict=True))


@query("g8_cbx", f"WITH {W.MERS} SELECT structure_id, ind, {W.select(CBX, 'cbx')} FROM mers")
def g8(spark, d):
    return W.mers(spark, d).select(*IDS, *rounded(P.cbx(A(), F.col("name")), "cbx"))


def _as_nucleotide(m):
    """The view's atoms under a nucleotide's names."""
    names = {"N1": "N", "C4": "C", "C1'": "CA", "C2": "CB", "C6": "O"}
    return m.withColumn("atoms", F.create_map(*[x for a, b in names.items() for x in (F.lit(a), A()[b])]))


@query("g9_nucleotide_points", f"""WITH {W.MERS} SELECT structure_id, ind, {W.select((N + C) * "0.5", "ring")}, {W.select((N + C) * "0.5", "prc")}, {W.select(CA + (N - CA) * f"({W.slen(N - CA)} + 1.4) / {W.slen(N - CA)}", "nx")},
{W.select(_plane(CB, C, O)[0], "normal")} FROM mers""")
def g9(spark, d):
    m = _as_nucleotide(W.mers(spark, d))
    return m.select(*IDS, *rounded(P.ring_center(A()), "ring"), *rounded(P.prc(A()), "prc"), *rounded(P.nx(A()), "nx"), *rounded(P.ring_plane(A())["normal"], "normal"))


_B, _N = W.v("b"), W.v("f")
_MPP = W.V(f"CASE WHEN b_x IS NOT NULL AND f_x IS NOT NULL THEN {a} WHEN b_x IS NOT NULL THEN {b} WHEN f_x IS NOT NULL THEN {c} ELSE {e} END" for a, b, c, e in zip(W.sunit((CA - _B) + (CA - _N)), W.sunit(CA - _B), W.sunit(CA - _N), ("1.0", "0.0", "0.0"), strict=True))


@query("g10_mpp", f"""WITH {W.MERS}, nb AS (SELECT *, {", ".join(f"lag(ca_{i}) OVER w AS b_{i}, lead(ca_{i}) OVER w AS f_{i}" for i in "xyz")} FROM mers WINDOW w AS (PARTITION BY structure_id, chain ORDER BY ind))
SELECT structure_id, ind, {W.select(CA + _MPP * 2.53, "mpp")} FROM nb""")
def g10(spark, d):
    w = Window.partitionBy("structure_id", "chain").orderBy("ind")
    m = W.mers(spark, d).select(*IDS, q_().alias("ca"), F.lag(q_()).over(w).alias("before"), F.lead(q_()).over(w).alias("after"))
    return m.select(*IDS, *rounded(P.mpp(F.col("ca"), F.col("before"), F.col("after")), "mpp"))


@query("g11_last_sc", f"WITH {W.MERS} SELECT structure_id, ind, {W.select(W.V(f'CASE WHEN vec_id % 3 = 0 THEN {a} ELSE {b} END' for a, b in zip(CA, CB, strict=True)), 'last')} FROM mers")
def g11(spark, d):
    beads = F.when(F.col("vec_id") % 3 == 0, F.create_map(F.lit("BB"), q_())).otherwise(F.create_map(F.lit("BB"), q_(), F.lit("SC1"), p_(), F.lit("SC2"), A()["CB"]))
    m = W.mers(spark, d).withColumn("atoms", beads)
    return m.select(*IDS, *rounded(P.last_sc(A()), "last"))


@query("g12_representation", f"""WITH {W.MERS}, r AS (SELECT structure_id, ind, 0 AS k, {W.select(CA, "p")} FROM mers UNION ALL SELECT structure_id, ind, 1, {W.select(CBX, "p")} FROM mers) SELECT * FROM r""")
def g12(spark, d):
    pts = F.create_map(F.lit("CA"), q_(), F.lit("cbx"), P.cbx(A(), F.col("name")))
    m = W.mers(spark, d).withColumn("points", pts).select(*IDS, F.posexplode(P.representation(F.col("points"), FULL_ATOM[0])).alias("k", "p"))
    return m.select(*IDS, "k", *rounded(F.col("p"), "p"))
