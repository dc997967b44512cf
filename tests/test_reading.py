"""Files in ranges of bytes, models over stretches of lines, and mirrors of which only the wanted files are opened."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from helixframe.sources import structures as St


def atom(serial, res, x):
    return f"ATOM  {serial:5d}  CA  GLY A{res:4d}    {x:8.3f}{0.0:8.3f}{0.0:8.3f}  1.00  0.00           C"


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "100"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def test_lines_of_split_files(spark, tmp_path, small_ranges):
    """Large, small, empty and gzipped files, with and without carriage returns, are as they are when read line by line."""
    rng = random.Random(1)
    want = {}
    for name, n, end in (("big", 400, "\n"), ("crlf", 150, "\r\n"), ("one", 1, "\n"), ("two", 2, "\n")):
        lines = ["x" * rng.choice([0, 1, 9, 80]) + str(k) for k in range(n)]
        (tmp_path / f"{name}.pdb").write_bytes(end.join(lines).encode() + end.encode() * (n % 2))
        want |= {(name, k): line for k, line in enumerate(lines)}
    (tmp_path / "none.pdb").write_bytes(b"")
    (tmp_path / "zip.pdb.gz").write_bytes(gzip.compress("\n".join(str(k) for k in range(999)).encode()))
    want |= {("zip", k): str(k) for k in range(999)}
    got = St.read_lines(spark, str(tmp_path))
    assert {(r.structure_id, r.pos): r.line for r in got.collect()} == want
    assert got.where("structure_id = 'big'").select(F.spark_partition_id()).distinct().count() > 2


def test_models_of_split_trajectories(spark, tmp_path, small_ranges, monkeypatch):
    """Models go on over ranges and stretches; frames are numbered by model; a frame with an atom missing isn't whole."""
    monkeypatch.setattr(St, "STRETCH", 7)
    text, want = [], set()
    numbers = [5, 6, 9, 40]
    for k, m in enumerate(numbers):
        text.append(f"MODEL     {m:4d}")
        for serial in range(1, 31):
            if (m, serial) != (9, 3):
                text.append(atom(serial, serial, 100 * k + serial))
                want.add(("traj", k, serial, 100.0 * k + serial, m != 9))
        text += [atom(99, 99, 0.0)] * (m == 40) + ["ENDMDL"]
    (tmp_path / "traj.pdb").write_text("\n".join(text))
    (tmp_path / "plain.pdb").write_text("\n".join(atom(s, s, s) for s in range(1, 20)))
    want |= {("plain", 0, s, float(s), True) for s in range(1, 20)}
    atoms = St.read_pdb(spark, str(tmp_path))
    assert {r.model for r in atoms.where("structure_id = 'traj'").select("model").distinct().collect()} == set(numbers)
    assert {r.model for r in atoms.where("structure_id = 'plain'").select("model").distinct().collect()} == {1}
    frames = St.frames_from_models(atoms)
    assert {(r.structure_id, r.frame, r.serial, r.x, r.whole) for r in frames.collect()} == want


def test_models_before_any_model_line(spark):
    lines = [("s", 0, atom(1, 1, 1.0)), ("s", 1, "MODEL        3"), ("s", 2, atom(1, 1, 2.0)), ("t", 0, atom(1, 1, 3.0))]
    got = St.parse_pdb(spark.createDataFrame(lines, "structure_id string, pos int, line string")).collect()
    assert {(r.structure_id, r.model, r.x) for r in got} == {("s", 1, 1.0), ("s", 3, 2.0), ("t", 1, 3.0)}


def test_long_chain_names_are_an_error(spark):
    atoms = St.parse_pdb(spark.createDataFrame([("s", 0, atom(1, 1, 1.0))], "structure_id string, pos int, line string"))
    assert St.pdb_lines(atoms).count() == 2
    with pytest.raises(Exception, match="chains of one letter, not AB"):
        St.pdb_lines(atoms.withColumn("chain", F.lit("AB"))).collect()


@pytest.fixture
def mirror(tmp_path):
    """Three entries, one with three units, among many files that can't be read: opening one would fail."""
    for folder in ("pdb/ab", "pdb/cd", "unit/bc", "mmcif/x0"):
        (tmp_path / folder).mkdir(parents=True)
        for k in range(20):
            (tmp_path / folder / f"{k}zzz.pdb{k}.gz").write_bytes(b"not gzipped")
    (tmp_path / "pdb/ab/1abc.pdb").write_text("\n".join(f"line {k}" for k in range(20_000)) + "\r\n")
    (tmp_path / "mmcif/x0/2x0y.cif").write_text("data\r\n\r\nend")
    for u in (1, 2, 10):
        (tmp_path / f"unit/bc/1abc.pdb{u}.gz").write_bytes(gzip.compress(f"unit {u}\n".encode()))
    (tmp_path / "unit/bc/1abc.pdbx.gz").write_bytes(b"not a unit")
    return tmp_path


ENTRIES = ["pdb://1abc", "mmcif://2x0y", "unit://1abc", "unit://1abc/2", "pdb://9cd9", "unit://3zqz", "bad://1abc", "pdb://x"]


def test_only_wanted_files_are_opened(spark, mirror):
    resolved = St.resolve_entries(spark.createDataFrame([(e,) for e in ENTRIES], "entry string"))
    got = St.read_entries(spark, resolved, str(mirror)).collect()
    rows = {(r.structure_id, r.db, r.unit, r.pos): r.line for r in got}
    want = {("1abc", "pdb", None, k): f"line {k}" for k in range(20_000)} | {("2x0y", "mmcif", None, k): x for k, x in enumerate(["data", "", "end"])}
    want |= {("1abc", "unit", u, 0): f"unit {u}" for u in (1, 2, 10)}
    assert rows == want
    # A unit that is named twice, by itself and by *, comes twice.
    assert len(got) == len(want) + 1
    assert St.read_entries(spark, resolved.where("db = 'bad'"), str(mirror)).count() == 0


def test_a_wanted_file_that_is_broken_is_an_error(spark, mirror):
    resolved = St.resolve_entries(spark.createDataFrame([("unit://0zzz/0",)], "entry string")).withColumn("path", F.lit("unit/bc/0zzz.pdb0.gz"))
    with pytest.raises(Exception, match="[Nn]ot a gzipped file"):
        St.read_entries(spark, resolved, str(mirror)).count()


def test_stores_that_only_spark_opens(spark, mirror):
    """The same entries through another file system, by folders."""
    for f in mirror.rglob("*zzz*"):
        f.write_bytes(gzip.compress(b"x"))
    (mirror / "unit/bc/1abc.pdbx.gz").write_bytes(gzip.compress(b"x"))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.m.link./in", f"file://{mirror}")
    resolved = St.resolve_entries(spark.createDataFrame([(e,) for e in ENTRIES], "entry string"))
    key = lambda df: sorted((r.structure_id, r.db, r.unit or 0, r.line) for r in df.where("line <> ''").collect())
    assert key(St.read_entries(spark, resolved, "viewfs://m/in")) == key(St.read_entries(spark, resolved, str(mirror)))
