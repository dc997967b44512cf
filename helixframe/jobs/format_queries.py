"""Queries over formats: what is written from a view is read again and compared with the view."""

import uuid

from pyspark.sql import functions as F

from helixframe.jobs import views as W
from helixframe.jobs.contact_queries import NEAR, V_CA, mers, pairs_sql
from helixframe.jobs.registry import query
from helixframe.operators import contacts as K
from helixframe.operators.mers import sequence_letter
from helixframe.sources import alignments as Al
from helixframe.sources import structures as St
from helixframe.sources.shared import shared_dir

# Atoms with coordinates of three decimals, as the format has them.
_P = {a: W.v(a.lower()) for a in ("N", "CA", "C", "CB", "O")}
_XYZ = ", ".join("round(CASE atom_name " + " ".join(f"WHEN '{a}' THEN {p[i]}" for a, p in _P.items()) + f" END, 3) + 0.0 AS {'xyz'[i]}" for i in range(3))
WITH_XYZ = f"""{W.ATOM_ROWS}, full_atoms AS (SELECT atoms.structure_id, atoms.chain, atoms.num, res_name, atom_name, pos, {_XYZ} FROM atoms JOIN mers USING (vec_id))"""
ATOM = "structure_id, chain, num, res_name, atom_name, x, y, z"


def shown(atoms):
    return atoms.select("structure_id", "chain", "num", "res_name", "atom_name", *[(F.round(i, 3) + 0.0).alias(i) for i in "xyz"])


# The format holds 26 chains of one letter, so the view's further chains, A1 and on, are chain A and on of further models.


def folded_lines(spark, d):
    """The view's atoms as lines; chain B3 is chain B of the fourth model."""
    number = F.coalesce(F.nullif(F.substring("chain", 2, 10), F.lit("")).cast("int"), F.lit(0))
    return St.pdb_lines(W.atoms(spark, d).withColumn("model", number + 1).withColumn("chain", F.substring("chain", 1, 1)), models=True)


def unfolded(atoms):
    return atoms.withColumn("chain", F.concat("chain", F.when(F.col("model") > 1, (F.col("model") - 1).cast("string")).otherwise("")))


@query("s1_parse_pdb", f"WITH {WITH_XYZ} SELECT {ATOM} FROM full_atoms")
def s1(spark, d):
    return shown(unfolded(St.parse_pdb(folded_lines(spark, d))))


def mmcif_lines(atoms):
    names = ["group_PDB", "id", "type_symbol", "label_atom_id", "label_comp_id", "auth_asym_id", "auth_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "B_iso_or_equiv", "pdbx_PDB_model_num"]
    heads = atoms.select("structure_id").distinct().select("structure_id", F.posexplode(F.array(*[F.lit(f"_atom_site.{n}") for n in names])).alias("pos", "line"))
    # Names with a prime are quoted in such files; some of the view's get one and lose it again.
    line = F.format_string("ATOM %d %s \"%s'\" %s %s %d ? %.3f %.3f %.3f 1.00 0.00 %d", "serial", "element", "atom_name", "res_name", "chain", "num", "x", "y", "z", "model")
    return heads.unionByName(atoms.select("structure_id", (F.col("pos") + 100).alias("pos"), line.alias("line")))


@query("s2_parse_mmcif", f"WITH {WITH_XYZ} SELECT {ATOM} FROM full_atoms")
def s2(spark, d):
    read = St.parse_mmcif(mmcif_lines(W.atoms(spark, d)))
    return shown(read.where("atom_name LIKE '%\\'' AND atom_name NOT LIKE '%\"%'").withColumn("atom_name", F.expr("substring(atom_name, 1, length(atom_name) - 1)")))


# Entries for each part, good and bad ones, and the paths that they should have, as plain text.
ENTRY_CASES = (
    ("pdb://1abc", "pdb/ab/1abc.pdb"), ("PDB://1ABC", "pdb/ab/1abc.pdb"), ("mmCIF://2x0y", "mmcif/x0/2x0y.cif"), ("scop://d1abca_", "scop/ab/d1abca_.ent"),
    ("scop://d2xyz_1", "scop/xy/d2xyz_1.ent"), ("unit://1abc/2", "unit/bc/1abc.pdb2.gz"), ("unit://3pi2", "unit/i2/3pi2.pdb*.gz"), ("cath://1abc", "cath/bc/1abc.pdb"),
    ("cath://x", None), ("pdb://abcd", None), ("pdb://1abcd", None), ("scop://xxxxxxx", None), ("scop://dxabca_", None), ("scop://d1abca-", None), ("other://1abc", None), ("1abc", None),
)
_AT = f"[CAST(p_partkey % {len(ENTRY_CASES)} + 1 AS INTEGER)]"
_LISTED = lambda k: "[" + ", ".join("NULL" if c[k] is None else f"'{c[k]}'" for c in ENTRY_CASES) + "]"


@query("s3_resolve_entries", f"SELECT p_partkey, ({_LISTED(0)}){_AT} AS entry, ({_LISTED(1)}){_AT} AS path, ({_LISTED(1)}){_AT} IS NOT NULL AS valid FROM part")
def s3(spark, d):
    entry = F.element_at(F.array(*[F.lit(e) for e, _ in ENTRY_CASES]), (F.col("p_partkey") % len(ENTRY_CASES) + 1).cast("int"))
    parts = W.table(spark, d, "part").select("p_partkey", entry.alias("entry"))
    return parts.join(St.resolve_entries(parts.select("entry").distinct()), "entry").select("p_partkey", "entry", "path", "valid")


@query("s4_read_entries", f"WITH {WITH_XYZ}, s AS (SELECT structure_id, row_number() OVER (ORDER BY structure_id) % 10 || 'abc' AS entry_id FROM (SELECT DISTINCT structure_id FROM atoms)), u AS (SELECT f.*, entry_id, unnest(CASE WHEN entry_id < '5' THEN [0] ELSE [1, 2] END) AS unit FROM full_atoms f JOIN s USING (structure_id)) SELECT entry_id AS structure_id, unit, chain, num, res_name, atom_name, x, y, z FROM u")
def s4(spark, d):
    """A mirror is written, plain files for some entries and gzipped units for others, then read by its entries."""
    root = f"{shared_dir(spark)}/mirror-{uuid.uuid4().hex}"
    known = W.table(spark, d, "embeddings").select(F.col("label").cast("string").alias("structure_id")).distinct()
    place = F.row_number().over(W.Window.orderBy("structure_id")) % 10
    known = known.withColumn("id", F.concat(place.cast("string"), F.lit("abc")))
    lines = folded_lines(spark, d).join(known, "structure_id")
    text = lines.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    plain, units = F.col("id") < "5", F.explode(F.array(F.lit(1), F.lit(2)))
    files = text.where(plain).select("text", F.concat(F.lit("pdb/ab/"), "id", F.lit(".pdb")).alias("path"))
    zipped = text.where(~plain).select("text", "id", units.alias("unit")).select("text", F.concat(F.lit("unit/bc/"), "id", F.lit(".pdb"), F.col("unit").cast("string"), F.lit(".gz")).alias("path"))
    St.write_files(files.unionByName(zipped), root)
    entries = known.select(F.when(plain, F.concat(F.lit("pdb://"), "id")).otherwise(F.concat(F.lit("unit://"), "id")).alias("entry"))
    read = St.read_entries(spark, St.resolve_entries(entries), root)
    atoms = St.parse_pdb(read.withColumn("structure_id", F.concat_ws("/", "structure_id", F.coalesce("unit", F.lit(0)).cast("string"))).select("structure_id", "pos", "line"))
    part = F.split("structure_id", "/")
    return shown(unfolded(atoms)).select(part[0].alias("structure_id"), part[1].cast("int").alias("unit"), "chain", "num", "res_name", "atom_name", "x", "y", "z")


@query("s4_s7_write_and_read", f"WITH {WITH_XYZ} SELECT {ATOM} FROM full_atoms")
def s47(spark, d):
    path = f"{shared_dir(spark)}/pdb-{uuid.uuid4().hex}"
    St.write_lines(folded_lines(spark, d), path)
    return shown(unfolded(St.parse_pdb(St.read_written(spark, path))))


@query("s5_frames_from_models", f"WITH {WITH_XYZ} SELECT structure_id, m - 1 AS frame, CAST(pos + 1 AS INTEGER) AS serial, x + m AS x, true AS whole FROM full_atoms, (VALUES (1), (2), (3)) t(m)")
def s5(spark, d):
    atoms = W.atoms(spark, d).drop("model").withColumn("model", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    atoms = atoms.withColumn("x", F.round("x", 3) + F.col("model"))
    return St.frames_from_models(atoms).select("structure_id", "frame", F.col("serial").cast("int").alias("serial"), F.col("x"), "whole")


@query("s6_bind_frames", f"WITH {W.FRAME_ROWS} SELECT structure_id AS traj_id, frame, ind AS serial, 'CA' AS atom_name, round(p_x, 5) + 0.0 AS x FROM frames")
def s6(spark, d):
    f = W.frames(spark, d).select(F.col("structure_id").alias("traj_id"), "frame", F.col("ind").alias("serial"), *[(F.col("p")[i] / 10).alias(i) for i in "xyz"])
    topology = f.select("traj_id", "serial").distinct().withColumn("atom_name", F.lit("CA"))
    return St.bind_frames(f, topology).select("traj_id", "frame", "serial", "atom_name", (F.round("x", 5) + 0.0).alias("x"))


@query("s8_contact_tsv", f"WITH {pairs_sql(V_CA)} SELECT cm.structure_id, a.chain || ':' || a.num || chr(9) || b.chain || ':' || b.num || chr(9) || value AS line FROM cm JOIN m a ON a.structure_id = cm.structure_id AND a.ind = ind1 JOIN m b ON b.structure_id = cm.structure_id AND b.ind = ind2")
def s8(spark, d):
    m = mers(spark, d)
    return St.contact_tsv(K.contact_map(m, NEAR), m)


# Alignments of all structures, mer by mer, with gaps.

ALIGNED = f"{W.MERS}, al AS (SELECT ind AS row, structure_id, ind FROM mers WHERE vec_id % 5 <> 0), ok AS (SELECT * FROM al WHERE row IN (SELECT row FROM al GROUP BY row HAVING count(*) > 1 AND count(*) <> (SELECT count(DISTINCT label) FROM embeddings) - 1))"


def numbering(spark, d):
    return W.mers(spark, d).select("structure_id", "ind", "chain", "num", "icode", sequence_letter(F.col("name")).alias("letter"))


def aligned(spark, d):
    return W.mers(spark, d).where("vec_id % 5 <> 0").select(F.lit("x").alias("alignment_id"), F.col("ind").cast("long").alias("row"), "structure_id", "ind")


def names(spark, d):
    """Labels of the view: the columns of one file, so more than a hundred are an error."""
    found = [r[0] for r in W.table(spark, d, "embeddings").select(F.col("label").cast("string").alias("s")).distinct().orderBy("s").limit(101).collect()]
    if len(found) > 100:
        raise ValueError("too many labels for the columns of one file")
    return found


@query("s9_s15_alignment_csv", f"WITH {ALIGNED} SELECT structure_id, ind FROM al")
def s9(spark, d):
    n = numbering(spark, d)
    return Al.parse_alignment("x.csv", Al.csv_lines(aligned(spark, d), n, names(spark, d)), n).select("structure_id", "ind")


# A row with exactly one dash is written in lower case, which a reader takes for dashes: `ok` leaves such rows out.
@query("s11_s16_alignment_fasta", f"WITH {ALIGNED} SELECT structure_id, ind FROM ok")
def s11(spark, d):
    n = numbering(spark, d)
    return Al.parse_fasta(Al.fasta_lines(aligned(spark, d), n, names(spark, d), 30), n).select("structure_id", "ind")


@query("s10_s17_alignment_pal", f"WITH {ALIGNED} SELECT a.structure_id AS s1, b.structure_id AS s2, a.ind AS i1, b.ind AS i2 FROM al a JOIN al b ON a.row = b.row AND a.structure_id < b.structure_id")
def s10(spark, d):
    from helixframe.operators.alignments import to_pairs

    n = numbering(spark, d)
    lines = Al.pal_lines(aligned(spark, d), n)
    return to_pairs(Al.parse_pal(lines, n)).select("s1", "s2", "i1", "i2")


@query("s12_alignment_xml", f"WITH {ALIGNED} SELECT structure_id, ind FROM al")
def s12(spark, d):
    n, own = numbering(spark, d), names(spark, d)
    rows = aligned(spark, d).join(n, ["structure_id", "ind"]).select("row", "structure_id", F.concat(F.col("num").cast("string"), F.lit(":_:"), "chain").alias("cell"))
    wide = rows.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("structure_id", "cell"))).alias("m"))
    text = F.concat(F.lit("<row>"), *[F.concat(F.lit("<meq>"), F.coalesce(F.col("m")[s], F.lit("-")), F.lit("</meq>")) for s in own], F.lit("</row>"))
    head = "<a>" + "".join(f"<member>{s}</member>" for s in own)
    # One small document for every row: an alignment file is read whole.
    docs = wide.select(F.col("row").cast("string").alias("alignment_id"), F.concat(F.lit(head), text, F.lit("</a>")).alias("value"))
    return Al.parse_xml(docs, n).select("structure_id", "ind")


@query("s13_read_alignment", f"WITH {ALIGNED} SELECT CAST(k AS VARCHAR) AS alignment_id, structure_id, ind FROM al, (VALUES ('csv'), ('tsv')) t(k) UNION ALL SELECT 'fasta', structure_id, ind FROM ok UNION ALL SELECT 'pal', structure_id, ind FROM al WHERE row IN (SELECT row FROM al WHERE structure_id = '0') AND row IN (SELECT row FROM al WHERE structure_id = '1') AND structure_id IN ('0', '1')")
def s13(spark, d):
    """The view written in each format to a folder, and read again by the files' suffixes."""
    n, own, cells = numbering(spark, d), names(spark, d), aligned(spark, d)
    root = f"{shared_dir(spark)}/alignments-{uuid.uuid4().hex}"
    written = {"csv": Al.csv_lines(cells, n, own), "tsv": Al.csv_lines(cells, n, own, "\t"), "fasta": Al.fasta_lines(cells, n, own, 30), "pal": Al.pal_lines(cells.where("structure_id IN ('0', '1')"), n)}
    out = None
    for suffix, lines in written.items():
        text = lines.groupBy("alignment_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
        St.write_files(text.select(F.lit(f"{suffix}/{suffix}.{suffix}").alias("path"), "text"), root)
        rows = Al.read_alignment(spark, f"{root}/{suffix}/{suffix}.{suffix}", n).select("alignment_id", "structure_id", "ind")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("s14_alignment_metadata", f"WITH {ALIGNED}, r AS (SELECT structure_id, chain, CAST(num AS VARCHAR) AS num, row, ind, CASE WHEN ind = lag(ind) OVER w + 1 AND chain = lag(chain) OVER w THEN 0 ELSE 1 END AS opens FROM al JOIN mers USING (structure_id, ind) WINDOW w AS (PARTITION BY structure_id ORDER BY row)), g AS (SELECT *, sum(opens) OVER (PARTITION BY structure_id ORDER BY row) AS run FROM r), t AS (SELECT structure_id, run, any_value(chain) || ':' || arg_min(num, ind) || '-' || arg_max(num, ind) AS part FROM g GROUP BY 1, 2) SELECT structure_id, CAST(NULL AS VARCHAR) AS comment, string_agg(part, ', ' ORDER BY run) AS ranges FROM t GROUP BY 1")
def s14(spark, d):
    return Al.alignment_metadata(Al.fasta_lines(aligned(spark, d), numbering(spark, d), names(spark, d))).select("structure_id", "comment", "ranges")


@query("s14_table_metadata", f"WITH {ALIGNED} SELECT DISTINCT structure_id, k AS kind FROM al, (VALUES ('csv'), ('pal')) t(k)")
def s14b(spark, d):
    n, own, cells = numbering(spark, d), names(spark, d), aligned(spark, d)
    csv = Al.table_metadata(Al.csv_lines(cells, n, own)).select("structure_id", F.lit("csv").alias("kind"))
    return csv.unionByName(Al.pal_metadata(Al.pal_lines(cells, n)).select("structure_id", F.lit("pal").alias("kind")))
