"""Alignment formats. Readers take lines (alignment_id, pos, line) and numbering (structure_id, ind, chain, num, icode);
they give cells (alignment_id, row, structure_id, ind). Writers give lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.operators.alignments import prune, to_pairs
from helixframe.operators.selection import format_pdb_id
from helixframe.sources.structures import STEM, read_lines

A, S = "alignment_id", "structure_id"
CELL = r"^\s*(.*):(-?[0-9]+)([A-Za-z])?(:.*)?\s*$"
PAL_ID = r"^\s*(?:([A-Za-z0-9]*):|([A-Za-z]*))(-?[0-9]+)([A-Za-z])?\s*$"


def _id(text: Column, pattern: str = CELL) -> list[Column]:
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    return [part(1).alias("chain"), part(2).cast("int").alias("num"), part(3).alias("icode")]


def _pal_id(text: Column) -> list[Column]:
    part = lambda k: F.nullif(F.regexp_extract(text, PAL_ID, k), F.lit(""))
    return [F.coalesce(part(1), part(2)).alias("chain"), part(3).cast("int").alias("num"), part(4).alias("icode")]


def _with_ind(ids: DataFrame, numbering: DataFrame) -> DataFrame:
    n = numbering.select(F.col(S).alias("_s"), F.col("chain").alias("_c"), F.col("num").alias("_n"), F.col("icode").alias("_i"), "ind")
    return ids.join(n, (F.col(S) == F.col("_s")) & F.col("chain").eqNullSafe(F.col("_c")) & (F.col("num") == F.col("_n")) & F.col("icode").eqNullSafe(F.col("_i"))).drop("_s", "_c", "_n", "_i")


def parse_csv(lines: DataFrame, numbering: DataFrame, sep: str = ",") -> DataFrame:
    """A header of labels; cells `chain:num[icode][:letter]`, anything else is a dash."""
    cells = lines.select(A, "pos", F.posexplode(F.split("line", sep)).alias("k", "cell"))
    heads = cells.where("pos = 0").select(A, "k", F.trim("cell").alias(S))
    body = cells.where((F.col("pos") > 0) & F.col("cell").rlike(CELL)).select(A, (F.col("pos") - 1).cast("long").alias("row"), "k", *_id(F.col("cell")))
    return _with_ind(body.join(heads, [A, "k"]), numbering).select(A, "row", S, "ind")


def csv_lines(cells: DataFrame, numbering: DataFrame, names: Sequence[str], sep: str = ",") -> DataFrame:
    """Lines with a header; numbering has a letter column."""
    text = F.concat(format_pdb_id(F.col("chain"), F.col("num"), F.col("icode")), F.lit(":"), "letter")
    rows = cells.join(numbering.select(S, "ind", text.alias("cell")), [S, "ind"])
    wide = rows.groupBy(A, "row").agg(F.map_from_entries(F.collect_list(F.struct(S, "cell"))).alias("m"))
    line = F.concat_ws(sep, *[F.coalesce(F.col("m")[n], F.lit("-")) for n in names])
    body = wide.select(A, F.row_number().over(Window.partitionBy(A).orderBy("row")).alias("pos"), line.alias("line"))
    return cells.select(A).distinct().select(A, F.lit(0).alias("pos"), F.lit(sep.join(names)).alias("line")).unionByName(body)


def parse_fasta(lines: DataFrame, numbering: DataFrame) -> DataFrame:
    """`>label comment [A:2-4, B:1-4]`, then sequence lines. `.-*` are dashes; a lower-case letter is a dash that uses up a
    mer; mers come in the order of the ranges, or all of them. Rows with fewer than two mers go. Sequences of different
    lengths are an error, as is a structure with too few mers for its sequence."""
    w = Window.partitionBy(A).orderBy("pos")
    rows = lines.where("trim(line) <> '' AND line NOT LIKE '#%'").withColumn("k", F.sum(F.col("line").startswith(">").cast("int")).over(w))
    head = rows.where("line LIKE '>%'").select(A, "k", F.regexp_extract("line", r"^>\s*(\S+)", 1).alias(S), F.regexp_extract("line", r"\[([^\]]*)\]\s*$", 1).alias("ranges"))
    seq = rows.where("line NOT LIKE '>%'").groupBy(A, "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("line").alias("t")))), lambda x: x["t"]), "").alias("seq"))
    known = head.join(numbering.select(S).distinct(), S, "left_semi").select(A, "k")  # labels of other structures are passed over
    seq, head = seq.join(known, [A, "k"], "left_semi"), head.join(known, [A, "k"], "left_semi")
    sizes = Window.partitionBy(A)
    even = F.when(F.min(F.length("seq")).over(sizes) == F.max(F.length("seq")).over(sizes), F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("sequences of different lengths in "), F.col(A))))
    seq = seq.withColumn("seq", even)
    chars = seq.select(A, "k", F.posexplode(F.split("seq", "")).alias("row", "c")).where("c <> ''")
    used = F.col("c").rlike("[A-Za-z]")
    chars = chars.withColumn("n", F.sum(used.cast("int")).over(Window.partitionBy(A, "k").orderBy("row"))).where(F.col("c").rlike("[A-Z]"))
    part = r"^\s*([^:]*):(-?[0-9]+)([A-Za-z])?(?:-(-?[0-9]+)([A-Za-z])?)?\s*$"
    get = lambda k: F.nullif(F.regexp_extract("r", part, k), F.lit(""))
    ranges = head.select(A, "k", S, F.posexplode(F.split("ranges", ",")).alias("order", "r"))
    ends = ranges.where("r <> ''").select(A, "k", S, "order", get(1).alias("chain"), get(2).cast("int").alias("n0"), get(3).alias("i0"), F.coalesce(get(4), get(2)).cast("int").alias("n1"), F.when(get(4).isNull(), get(3)).otherwise(get(5)).alias("i1"))
    at = lambda df, n, i, name: _with_ind(df.select("*", F.col(n).alias("num"), F.col(i).alias("icode")), numbering).drop("num", "icode").withColumnRenamed("ind", name)
    ends = at(at(ends, "n0", "i0", "a"), "n1", "i1", "b")
    inds = numbering.select(F.col(S).alias("_s"), "ind")
    chosen = ends.join(inds, (F.col(S) == F.col("_s")) & F.col("ind").between(F.col("a"), F.col("b"))).select(A, "k", S, "order", "ind")
    whole = head.where("ranges = ''").join(inds, F.col(S) == F.col("_s")).select(A, "k", S, F.lit(0).alias("order"), "ind")
    mers = chosen.unionByName(whole).withColumn("n", F.row_number().over(Window.partitionBy(A, "k").orderBy("order", "ind")))
    cells = chars.join(mers, [A, "k", "n"], "left")
    few = F.raise_error(F.concat(F.lit("too few mers for a sequence of "), F.col(A)))
    cells = cells.select(A, F.col("row").cast("long").alias("row"), S, F.when(F.col("ind").isNull(), few).otherwise(F.col("ind")).alias("ind"))
    return prune(cells, A)


def fasta_lines(cells: DataFrame, numbering: DataFrame, names: Sequence[str], width: int = 80) -> DataFrame:
    """Header with runs of ids per chain; dashes; sequences wrapped at `width`. Letters are in lower case where the row has
    exactly one dash among `names`; so in an alignment of two, a lone mer is, and a reader takes it for a dash."""
    n = numbering.select(S, "ind", "chain", "num", "icode", "letter")
    own = cells.join(n, [S, "ind"])
    w = Window.partitionBy(A, S).orderBy("row")
    broken = F.coalesce((F.col("ind") != F.lag("ind").over(w) + 1) | (F.col("chain") != F.lag("chain").over(w)), F.lit(True))
    runs = own.withColumn("run", F.sum(broken.cast("int")).over(w)).groupBy(A, S, "run", "chain").agg(F.min(F.struct("ind", "num", "icode")).alias("a"), F.max(F.struct("ind", "num", "icode")).alias("b"))
    one = lambda e: F.concat(F.col(e)["num"].cast("string"), F.coalesce(F.col(e)["icode"], F.lit("")))
    text = F.concat("chain", F.lit(":"), one("a"), F.lit("-"), one("b"))
    heads = runs.groupBy(A, S).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", text.alias("t")))), lambda x: x["t"]), ", ").alias("ranges"))
    grid = cells.select(A, "row").distinct().withColumn(S, F.explode(F.array(*map(F.lit, names))))
    letters = grid.join(own.select(A, "row", S, "letter"), [A, "row", S], "left")
    dashes = F.sum(F.col("letter").isNull().cast("int")).over(Window.partitionBy(A, "row"))
    letters = letters.withColumn("letter", F.when(dashes == 1, F.lower("letter")).otherwise(F.upper("letter")))
    seq = letters.groupBy(A, S).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", F.coalesce("letter", F.lit("-")).alias("c")))), lambda x: x["c"]), "").alias("seq"))
    wrapped = F.split(F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n"), "\n")
    block = F.concat(F.array(F.concat(F.lit(">"), S, F.lit(" ["), "ranges", F.lit("]"))), wrapped)
    order = F.array_position(F.array(*map(F.lit, names)), F.col(S))
    lines = seq.join(heads, [A, S]).select(A, order.alias("k"), F.posexplode(block).alias("j", "line"))
    return lines.select(A, (F.row_number().over(Window.partitionBy(A).orderBy("k", "j")) - 1).alias("pos"), "line")


def parse_pal(lines: DataFrame, numbering: DataFrame) -> DataFrame:
    """Pair ranges `a -- b <--> c -- d` under `>L1 L2`; ids as `A:382`, `A382` or, for a structure with one chain or one
    chain that has the number, without a chain. Both ranges are walked together. A row's key is its contents."""
    w = Window.partitionBy(A).orderBy("pos")
    names = F.when(F.col("line").startswith(">"), F.split(F.trim(F.substring("line", 2, 1000)), r"\s+"))
    rows = lines.withColumn("names", F.last(names, ignorenulls=True).over(w)).where("line LIKE '%<-->%'")
    ids = F.split("line", r"\s*(?:<-->|--)\s*")
    rows = rows.select(A, "pos", F.posexplode(F.transform(ids, lambda x: F.trim(x))).alias("k", "text"), "names")
    rows = rows.select(A, "pos", "k", F.element_at("names", (F.floor(F.col("k") / 2) + 1).cast("int")).alias(S), *_pal_id(F.col("text")))
    named = numbering.groupBy(S, "num", "icode").agg(F.min("chain").alias("_c"), F.countDistinct("chain").alias("_m"))
    rows = rows.join(named.withColumnsRenamed({"num": "_n", "icode": "_i", S: "_s"}), (F.col(S) == F.col("_s")) & (F.col("num") == F.col("_n")) & F.col("icode").eqNullSafe(F.col("_i")), "left")
    one = F.when(F.col("_m") == 1, F.col("_c")).otherwise(F.raise_error(F.concat(F.lit("no single chain has mer "), F.col("num").cast("string"))))
    rows = rows.withColumn("chain", F.coalesce("chain", one)).drop("_s", "_n", "_i", "_c", "_m")
    at = _with_ind(rows, numbering).groupBy(A, "pos").agg(*[F.max(F.when(F.col("k") == k, F.col("ind"))).alias(f"i{k}") for k in range(4)], *[F.max(F.when(F.col("k") == k, F.col(S))).alias(f"s{k}") for k in (0, 2)])
    step = F.explode(F.sequence(F.lit(0), F.col("i1") - F.col("i0")))
    walked = at.select(A, "pos", "s0", "s2", "i0", "i2", step.alias("j"))
    row = F.struct("s0", "s2", (F.col("i0") + F.col("j")).alias("i0"), (F.col("i2") + F.col("j")).alias("i2"))
    both = F.inline(F.array(F.struct(F.col("s0").alias(S), (F.col("i0") + F.col("j")).alias("ind")), F.struct(F.col("s2").alias(S), (F.col("i2") + F.col("j")).alias("ind"))))
    return walked.select(A, row.alias("row"), both)


def pal_lines(cells: DataFrame, numbering: DataFrame) -> DataFrame:
    """Version 2.0. Each pair is pruned; a new range starts where either side isn't the next mer or ended a chain."""
    n = numbering.select(S, "ind", format_pdb_id(F.col("chain"), F.col("num"), F.col("icode")).alias("id"), "chain")
    last = Window.partitionBy(S, "chain")
    n = n.withColumn("ends", F.col("ind") == F.max("ind").over(last))
    side = lambda k: n.select(F.col(S).alias(f"s{k}"), F.col("ind").alias(f"i{k}"), F.col("id").alias(f"id{k}"), F.col("ends").alias(f"e{k}"))
    pairs = to_pairs(cells, A).select(A, "s1", "s2", "i1", "i2").distinct().join(side(1), ["s1", "i1"]).join(side(2), ["s2", "i2"])
    w = Window.partitionBy(A, "s1", "s2").orderBy("i1", "i2")
    new = (F.col("i1") != F.lag("i1").over(w) + 1) | (F.col("i2") != F.lag("i2").over(w) + 1) | F.lag("e1").over(w) | F.lag("e2").over(w)
    runs = pairs.withColumn("run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w))
    runs = runs.groupBy(A, "s1", "s2", "run").agg(*[f(F.struct("i1", f"id{k}")).alias(f"{x}{k}") for k in (1, 2) for x, f in (("a", F.min), ("b", F.max))])
    text = F.format_string("%s -- %s <--> %s -- %s", F.col("a1")["id1"], F.col("b1")["id1"], F.col("a2")["id2"], F.col("b2")["id2"])
    heads = runs.groupBy(A, "s1", "s2").agg(F.count("*").alias("n")).select(A, "s1", "s2", F.posexplode(F.array(F.concat_ws(" ", F.concat(F.lit(">"), "s1"), "s2"), F.concat(F.lit("@"), F.col("n").cast("string")))).alias("k", "line"))
    rows = heads.select(A, "s1", "s2", F.lit(0).alias("run"), "k", "line").unionByName(runs.select(A, "s1", "s2", "run", F.lit(0).alias("k"), text.alias("line")))
    body = rows.select(A, F.row_number().over(Window.partitionBy(A).orderBy("s1", "s2", "run", "k")).alias("pos"), "line")
    return cells.select(A).distinct().select(A, F.lit(0).alias("pos"), F.lit("v:2.0").alias("line")).unionByName(body)


def parse_xml(texts: DataFrame, numbering: DataFrame) -> DataFrame:
    """texts: (alignment_id, value). Members name the columns; cells of rows are `num+icode:_:chain`. More than one
    alternative in a text is an error."""
    many = F.size(F.regexp_extract_all("value", F.lit(r"<alternative[\s>/]"), 0)) > 1
    texts = texts.withColumn("value", F.when(many, F.raise_error(F.concat(F.lit("more than one alternative in "), F.col(A).cast("string")))).otherwise(F.col("value")))
    rows = texts.select(A, F.expr("xpath(value, '//member/text()')").alias("names"), F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<row>(.*?)</row>"), 1)).alias("row", "r"))
    cells = rows.select(A, "names", F.col("row").cast("long").alias("row"), F.posexplode(F.regexp_extract_all("r", F.lit(r"<meq>([^<]*)</meq>"), 1)).alias("k", "cell"))
    part = lambda k: F.nullif(F.regexp_extract("cell", r"^(-?[0-9]+)([A-Za-z])?:[^:]*:(.*)$", k), F.lit(""))
    ids = cells.select(A, "row", F.get("names", F.col("k")).alias(S), part(3).alias("chain"), part(1).cast("int").alias("num"), part(2).alias("icode"))
    return _with_ind(ids, numbering).select(A, "row", S, "ind")


def parse_alignment(path: str, lines: DataFrame, numbering: DataFrame) -> DataFrame:
    """By the suffix: .csv, .tsv, .pal, else FASTA."""
    if path.endswith((".csv", ".tsv")):
        return parse_csv(lines, numbering, "\t" if path.endswith(".tsv") else ",")
    return parse_pal(lines, numbering) if path.endswith(".pal") else parse_fasta(lines, numbering)


def read_alignment(spark: SparkSession, path: str, numbering: DataFrame) -> DataFrame:
    """Cells of the alignment files at a path, each file an alignment named after its stem."""
    if path.endswith(".xml"):
        files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), STEM, 1).alias(A), "value")
        return parse_xml(files, numbering)
    return parse_alignment(path, read_lines(spark, path).withColumnRenamed(S, A), numbering)


def xml_metadata(texts: DataFrame) -> DataFrame:
    """(alignment_id, structure_id, descriptions): the members of XML texts (alignment_id, value), and what their
    descriptions say, by tag."""
    inner = F.regexp_extract_all("value", F.lit(r"(?s)<description>(.*?)</description>"), 1)
    tags = F.flatten(F.transform(inner, lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(?s)<(\w+)[^>]*>[^<]*</\1>"), 0), lambda t: F.struct(F.regexp_extract(t, r"^<(\w+)", 1), F.trim(F.regexp_extract(t, r"(?s)>([^<]*)<", 1))))))
    return texts.select(A, F.explode(F.expr("xpath(value, '//member/text()')")).alias(S), F.map_from_entries(tags).alias("descriptions"))


def table_metadata(lines: DataFrame, sep: str = ",") -> DataFrame:
    """(alignment_id, structure_id) of the header of CSV or TSV lines."""
    return lines.where("pos = 0").select(A, F.explode(F.split("line", sep)).alias(S)).select(A, F.trim(S).alias(S))


def pal_metadata(lines: DataFrame) -> DataFrame:
    """(alignment_id, structure_id) of the sections of PAL lines."""
    return lines.where("line LIKE '>%'").select(A, F.explode(F.split(F.trim(F.expr("substring(line, 2)")), r"\s+")).alias(S)).distinct()


def alignment_metadata(lines: DataFrame) -> DataFrame:
    """(alignment_id, structure_id, comment, ranges) of FASTA headers."""
    get = lambda k: F.nullif(F.trim(F.regexp_extract("line", r"^>\s*(\S+)([^\[]*)(?:\[([^\]]*)\])?", k)), F.lit(""))
    return lines.where("line LIKE '>%'").select(A, get(1).alias(S), get(2).alias("comment"), get(3).alias("ranges"))
