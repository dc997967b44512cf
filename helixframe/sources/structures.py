"""Structure files as lines, and lines as atoms.

Lines are (structure_id, pos, line). Parsing works on lines, so text from files, mirrors or columns goes the same way.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import vec
from helixframe.operators.selection import format_pdb_id
from helixframe.sources.shared import if_small, keep

S = "structure_id"
STEM = r"([^/]+?)(\.[A-Za-z0-9]+)?(\.gz)?$"
#: Lines that are looked at together for the model they are in, ranges of bytes (or folders) whose table is broadcast,
#: entries that a task opens, and lines that it gives at once.
STRETCH, MAX_RANGES, ENTRIES_A_TASK, LINES = 1 << 16, 200_000, 256, 1 << 13


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files, gzipped ones too; a file's stem is its structure_id, pos counts its lines from 0. Spark splits
    large files (not gzipped ones) over tasks by ranges of bytes; a table of how many lines each range has, counted first,
    tells where its lines stand. Files mustn't change meanwhile."""
    ranges = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from")]
    raw = spark.read.text(path, lineSep="\n").select(*ranges, F.monotonically_increasing_id().alias("_k"), "value")
    counts = raw.groupBy("_file", "_from").agg(F.min("_k").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = if_small(keep(counts.select("_file", "_from", (before - F.col("_first")).alias("_shift"))), MAX_RANGES)
    line = F.regexp_replace("value", "\r$", "").alias("line")
    return raw.join(counts, ["_file", "_from"]).select(F.regexp_extract("_file", STEM, 1).alias(S), (F.col("_k") + F.col("_shift")).alias("pos"), line)


def parse_pdb(lines: DataFrame) -> DataFrame:
    """Atoms of all models; of alternates the one with the highest occupancy (ties: the first)."""
    part = lambda a, n: F.trim(F.substring("line", a, n))
    rows = with_models(lines.where("line LIKE 'ATOM%' OR line LIKE 'HETATM%' OR line LIKE 'MODEL%'"))
    atoms = rows.where("line NOT LIKE 'MODEL%'").select(
        S, "model", F.nullif(part(22, 1), F.lit("")).alias("chain"), part(23, 4).cast("int").alias("num"), F.nullif(part(27, 1), F.lit("")).alias("icode"), part(18, 3).alias("res_name"), part(13, 4).alias("atom_name"),
        part(7, 5).cast("int").alias("serial"), part(77, 2).alias("element"), *[part(31 + 8 * k, 8).cast("double").alias(i) for k, i in enumerate(vec.AXES)],
        F.coalesce(F.nullif(part(55, 6), F.lit("")).cast("double"), F.lit(0.0)).alias("occupancy"), F.coalesce(F.nullif(part(61, 6), F.lit("")).cast("double"), F.lit(0.0)).alias("b_factor"),
        F.col("line").startswith("HETATM").alias("hetero"), F.col("pos").cast("long").alias("pos"),
    )
    return _one_alternate(atoms)


def with_models(lines: DataFrame) -> DataFrame:
    """Adds model, the number of the last MODEL line before or at each line, else 1. Lines are looked at in stretches of
    STRETCH; a small table has the number that each stretch begins with, so no task needs a whole structure."""
    number = F.when(F.col("line").startswith("MODEL"), F.trim(F.substring("line", 7, 20)).cast("int"))
    rows = lines.withColumns({"_number": number, "_stretch": F.floor(F.col("pos") / STRETCH)})
    last = F.max_by("_number", F.when(F.col("_number").isNotNull(), F.col("pos")))
    begins = rows.groupBy(S, "_stretch").agg(last.alias("_last"))
    earlier = Window.partitionBy(S).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    begins = begins.select(S, "_stretch", F.last("_last", ignorenulls=True).over(earlier).alias("_begin"))
    own = F.last("_number", ignorenulls=True).over(Window.partitionBy(S, "_stretch").orderBy("pos"))
    return rows.join(begins, [S, "_stretch"]).withColumn("model", F.coalesce(own, "_begin", F.lit(1))).drop("_number", "_stretch", "_begin")


def _one_alternate(atoms: DataFrame) -> DataFrame:
    w = Window.partitionBy(S, "model", "chain", "num", "icode", "atom_name").orderBy(F.desc("occupancy"), "pos")
    return atoms.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


#: Columns of an _atom_site loop and what they become.
MMCIF = {"label_atom_id": "atom_name", "label_comp_id": "res_name", "auth_asym_id": "chain", "auth_seq_id": "num", "pdbx_PDB_ins_code": "icode", "id": "serial", "type_symbol": "element", "Cartn_x": "x", "Cartn_y": "y", "Cartn_z": "z", "occupancy": "occupancy", "B_iso_or_equiv": "b_factor", "group_PDB": "hetero", "pdbx_PDB_model_num": "model"}


#: A value of a loop's line: in double or single quotes, which may stand within a value, or up to the next white space.
CIF_VALUE = r"""("(?:[^"]|"(?=\S))*"(?=\s|$)|'(?:[^']|'(?=\S))*'(?=\s|$)|\S+)"""


def parse_mmcif(lines: DataFrame) -> DataFrame:
    """Atoms from _atom_site loops, by the order of columns that each file's header gives. Quotes around a value go."""
    name = F.regexp_extract("line", r"^_atom_site\.(\S+)", 1)
    heads = lines.where("line LIKE '\\_atom\\_site.%'").select(S, name.alias("name"), (F.row_number().over(Window.partitionBy(S).orderBy("pos"))).alias("k"))
    heads = heads.groupBy(S).agg(F.map_from_entries(F.collect_list(F.struct("name", "k"))).alias("at"))
    bare = lambda x: F.regexp_replace(x, r"""^(["'])(.*)\1$""", "$2")
    parts = F.when(F.col("line").rlike("[\"']"), F.transform(F.regexp_extract_all("line", F.lit(CIF_VALUE), 1), bare)).otherwise(F.split(F.trim("line"), r"\s+"))
    rows = lines.where("line LIKE 'ATOM%' OR line LIKE 'HETATM%'").withColumn("parts", parts).join(heads, S)
    value = lambda c: F.nullif(F.nullif(F.element_at("parts", F.col("at")[c]), F.lit(".")), F.lit("?"))
    kinds = {"num": "int", "serial": "int", "model": "int", "x": "double", "y": "double", "z": "double", "occupancy": "double", "b_factor": "double"}
    cols = [(value(a) == "HETATM").alias(b) if b == "hetero" else value(a).cast(kinds.get(b, "string")).alias(b) for a, b in MMCIF.items()]
    return _one_alternate(rows.select(S, *cols, F.col("pos").cast("long").alias("pos")))


def read_pdb(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_pdb(read_lines(spark, path))


def read_mmcif(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_mmcif(read_lines(spark, path))


def pdb_lines(atoms: DataFrame, transform: Column | None = None, models: bool = False) -> DataFrame:
    """Fixed-width ATOM lines numbered from 0, then END, of each structure. A chain's name has one column: a longer one is an
    error, as it would shift the rest. With `models`, atoms stand by their models, each after a MODEL line."""
    long_name = F.raise_error(F.concat(F.lit("the format holds chains of one letter, not "), "chain")).cast("string")
    p = vec.point(F.col("x"), F.col("y"), F.col("z"))
    p = p if transform is None else vec.transform(p, transform)
    name = F.when(F.length("atom_name") < 4, F.concat(F.lit(" "), "atom_name")).otherwise(F.col("atom_name"))
    order = Window.partitionBy(S).orderBy(*(["model"] if models else []), "pos")
    n = F.row_number().over(order) - 1
    heads = F.dense_rank().over(Window.partitionBy(S).orderBy("model")) if models else F.lit(0)
    rows = atoms.select(S, "model" if models else F.lit(1).alias("model"), (n + heads).alias("pos"), p.alias("p"), name.alias("name"), "res_name", F.when(F.length("chain") > 1, long_name).otherwise(F.coalesce("chain", F.lit(" "))).alias("chain"), "num", F.coalesce("icode", F.lit(" ")).alias("icode"), "element")
    line = F.format_string("ATOM  %5d %-4s %3s %1s%4d%1s   %8.3f%8.3f%8.3f  1.00  0.00          %2s", F.col("pos") % 100000, "name", "res_name", "chain", "num", "icode", F.col("p")["x"], F.col("p")["y"], F.col("p")["z"], "element")
    ends = rows.groupBy(S).agg((F.max("pos") + 1).alias("pos")).select(S, "pos", F.lit("END").alias("line"))
    out = rows.select(S, "pos", line.alias("line")).unionByName(ends)
    if not models:
        return out
    return out.unionByName(rows.groupBy(S, "model").agg((F.min("pos") - 1).alias("pos")).select(S, "pos", F.format_string("MODEL     %4d", "model").alias("line")))


def write_lines(lines: DataFrame, path: str) -> None:
    """One folder of text for each structure_id, with its lines in order in one file. Lines are put in order as text, by
    stretches first: rows that are sorted before a partitioned write are sorted anew by structure_id alone."""
    text = lambda at: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "line"))), lambda x: x["line"]), "\n").alias("line")
    stretches = lines.groupBy(S, F.floor(F.col("pos") / STRETCH).alias("_stretch")).agg(text("pos"))
    stretches.groupBy(S).agg(text("_stretch")).write.partitionBy(S).text(path)


def write_files(files: DataFrame, root: str) -> None:
    """One text file for each (path, text) under a root, by whatever file system the root's name says; gzipped where the
    path ends in .gz. Each task writes its rows' files through a temporary name, so a task that is run again replaces
    what it had written."""

    def run(batches):
        store, base = _store(root)
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder, name = path.rsplit("/", 1)
                store.create_dir(f"{base}/{folder}", recursive=True)
                raw = text.encode()
                with store.open_output_stream(f"{base}/{folder}/.{name}", compression=None) as out:
                    out.write(gzip.compress(raw, mtime=0) if path.endswith(".gz") else raw)
                store.move(f"{base}/{folder}/.{name}", f"{base}/{path}")
            yield batch.slice(0, 0)

    files.select("path", "text").mapInArrow(run, "path string, text string").count()


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """Lines that write_lines has written."""
    files = spark.read.text(f"{path}/*/*.txt", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"structure_id=([^/]+)/", 1).alias(S), "value")
    return files.select(S, F.posexplode(F.split("value", "\n")).alias("pos", "line")).where("line <> ''")


def contact_tsv(contacts: DataFrame, numbering: DataFrame) -> DataFrame:
    """Lines `id1 <tab> id2 <tab> value`, with structure_id."""
    ids = numbering.select(S, "ind", format_pdb_id(F.col("chain"), F.col("num"), F.col("icode")).alias("id"))
    one = contacts.join(ids.select(S, F.col("ind").alias("ind1"), F.col("id").alias("id1")), [S, "ind1"])
    two = one.join(ids.select(S, F.col("ind").alias("ind2"), F.col("id").alias("id2")), [S, "ind2"])
    return two.select(S, F.concat_ws("\t", "id1", "id2", F.col("value").cast("string")).alias("line"))


def frames_from_models(atoms: DataFrame) -> DataFrame:
    """Models as frames from 0, atoms matched by serial to the first one; `whole` tells frames that have all of them. Frames
    are numbered in the table of distinct models; atoms are only joined and counted."""
    models = atoms.groupBy(S, "model").agg(F.count("*").alias("_n"))
    models = models.select(S, "model", (F.dense_rank().over(Window.partitionBy(S).orderBy("model")) - 1).alias("frame"))
    first = models.where("frame = 0").select(S, "model")
    topology = atoms.join(first, [S, "model"]).select(S, "serial").distinct()
    known = atoms.join(topology, [S, "serial"], "left_semi")
    counts = known.groupBy(S, "model").agg(F.count("*").alias("_n"))
    sizes = models.join(counts, [S, "model"]).join(topology.groupBy(S).agg(F.count("*").alias("_all")), S)
    whole = (F.col("_n") == F.col("_all")).alias("whole")
    return known.join(sizes.select(S, "model", "frame", whole), [S, "model"]).select(S, "frame", "serial", "x", "y", "z", "whole")


def bind_frames(frames: DataFrame, topology: DataFrame, factor: float = 10.0) -> DataFrame:
    """Frame coordinates (traj_id, frame, serial, x, y, z in nm) with the atoms of their own topology (traj_id, serial), in
    Angstrom."""
    scaled = frames.select("traj_id", "frame", "serial", *[(F.col(i) * factor).alias(i) for i in vec.AXES])
    return scaled.join(topology.drop(*vec.AXES), ["traj_id", "serial"])


# For each database, the pattern of an id, where the two letters of its folder begin, and the file's end.
_LETTER = r"[\p{L}\p{N}]"
_FOUR = rf"^[0-9]{_LETTER}{{2}}.$"
DATABASES = {
    "pdb": (_FOUR, 2, ".pdb"),
    "mmcif": (_FOUR, 2, ".cif"),
    "scop": (rf"^d[0-9]{_LETTER}{{2}}.(?:{_LETTER}|[_.])(?:{_LETTER}|_)$", 3, ".ent"),
    "cath": (_FOUR, 3, ".pdb"),
    "unit": (_FOUR, 3, ".pdb"),
}


def resolve_entries(ids: DataFrame) -> DataFrame:
    """(entry, db, id, unit, path, valid) of entries like `pdb://1abc`, `scop://d1abca_`, `unit://1abc/2`; bad ids stay,
    marked invalid. `unit://1abc` stands for all units, by a * in the path; `pdb+mmcif://1abc` gives a row for either."""
    e = F.col("entry")
    named, rest = F.lower(F.regexp_extract(e, r"^([\w+]+)://", 1)), F.regexp_extract(e, r"^[\w+]+://([^/]+)", 1)
    unit = F.regexp_extract(e, r"^\w+://[^/]+/(\d+)$", 1)
    either = F.when(named == "pdb+mmcif", F.array(F.lit("pdb"), F.lit("mmcif"))).otherwise(F.array(named))
    rows = ids.select(e, F.explode(either).alias("db"), rest.alias("id"), F.nullif(unit, F.lit("")).cast("int").alias("unit"))
    rows = rows.withColumn("id", F.when(F.col("db").isin("pdb", "mmcif"), F.lower("id")).otherwise(F.col("id")))
    valid, path = F.lit(False), F.lit(None).cast("string")
    for db, (pattern, at, end) in DATABASES.items():
        own = F.col("db") == db
        file = F.concat("id", F.lit(end)) if db != "unit" else F.concat("id", F.lit(end), F.coalesce(F.col("unit").cast("string"), F.lit("*")), F.lit(".gz"))
        valid = F.when(own, F.col("id").rlike(pattern)).otherwise(valid)
        path = F.when(own, F.concat_ws("/", "db", F.substring("id", at, 2), file)).otherwise(path)
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    return rows.select("entry", "db", "id", "unit", F.when(F.col("valid"), path).alias("path"), "valid")


def read_entries(spark: SparkSession, resolved: DataFrame, root: str) -> DataFrame:
    """Lines (structure_id, db, unit, pos, line) of the valid entries under a mirror's root, gzipped files too. Only their
    files are opened: paths are dealt to tasks, which open them by the file system that the root's name says, and list a
    folder where a path has * for every unit. Entries without a file give no lines. A store that only Spark's readers
    can open is read by whole folders instead, those of the entries."""
    wanted = resolved.where("valid").select("path", "db", F.col("id").alias(S)).distinct()
    try:
        _store(root)
    except (OSError, ValueError, NotImplementedError):  # unknown, or without its library here
        return _read_folders(spark, wanted, root)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-wanted.count() // ENTRIES_A_TASK))
    return wanted.repartition(tasks, "path").sortWithinPartitions("path").mapInArrow(lambda batches: _open_entries(batches, root), f"{S} string, db string, unit int, pos long, line string")


def _store(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def _open_entries(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    store, base = _store(root)
    listed: tuple[str, list[str]] = "", []
    for batch in batches:
        for path, db, entry in zip(*(batch.column(c).to_pylist() for c in ("path", "db", S)), strict=True):
            names = [path]
            if "*" in path:
                folder = path.rsplit("/", 1)[0]
                if listed[0] != folder:
                    listed = folder, sorted(f"{folder}/{f.base_name}" for f in store.get_file_info(fs.FileSelector(f"{base}/{folder}", allow_not_found=True)) if f.is_file)
                start, end = path.split("*")
                names = [f for f in listed[1] if f.startswith(start) and f.endswith(end) and f[len(start) : len(f) - len(end)].isdigit()]
            for name in names:
                number = re.search(r"\.pdb(\d+)\.gz$", name)
                try:
                    raw = store.open_input_stream(f"{base}/{name}", compression=None)
                except FileNotFoundError:
                    continue
                with raw, gzip.open(raw) if name.endswith(".gz") else raw as data:
                    lines = io.TextIOWrapper(data, "utf-8", "replace", newline="\n")
                    at = 0
                    while some := [x.removesuffix("\n").removesuffix("\r") for x in islice(lines, LINES)]:
                        n = len(some)
                        cell = lambda v, kind, n=n: pa.array([v] * n, kind)
                        unit = cell(int(number[1]) if number else None, pa.int32())
                        yield pa.RecordBatch.from_arrays([cell(entry, pa.string()), cell(db, pa.string()), unit, pa.array(range(at, at + n), pa.int64()), pa.array(some)], [S, "db", "unit", "pos", "line"])
                        at += n


def _read_folders(spark: SparkSession, wanted: DataFrame, root: str) -> DataFrame:
    """Two letters make a folder, so there are few of them, however many the entries."""
    folders = [r[0] for r in wanted.select(F.regexp_extract("path", r"^(.*)/", 1)).distinct().limit(MAX_RANGES).collect()]
    if not folders:
        return spark.createDataFrame([], f"{S} string, db string, unit int, pos long, line string")
    path = spark._jvm.org.apache.hadoop.fs.Path
    there = [f"{root}/{f}" for f in folders if path(f"{root}/{f}").getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(f"{root}/{f}"))]
    files = spark.read.text(there, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+/[^/]+/[^/]+)$", 1).alias("file"), "value")
    number = F.regexp_extract("file", r"\.pdb(\d+)\.gz$", 1)
    starred = F.regexp_replace("file", r"\.pdb\d+\.gz$", ".pdb*.gz")
    named = F.when(number == "", F.array("file")).otherwise(F.array(F.col("file"), starred))
    files = files.select(F.explode(named).alias("path"), F.nullif(number, F.lit("")).cast("int").alias("unit"), "value")
    lines = files.join(wanted, "path").select(S, "db", "unit", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    return lines.withColumn("pos", F.col("pos").cast("long"))
