"""Alignments as long tables of cells (row, structure_id, ind); a dash is an absent cell.

Where several alignments stand in one table, `also` names the columns that tell them apart.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.mers import adjusted_number, segments
from helixframe.sources.shared import keep

S = "structure_id"


def prune(cells: DataFrame, *also: str) -> DataFrame:
    """Drops rows with fewer than two mers."""
    n = F.count("*").over(Window.partitionBy(*also, "row"))
    return cells.withColumn("_n", n).where("_n >= 2").drop("_n")


def alignment_size(cells: DataFrame, *also: str) -> DataFrame:
    """(n_rows, n_mers, n_structures)."""
    return cells.groupBy(*also).agg(F.countDistinct("row").alias("n_rows"), F.count("*").alias("n_mers"), F.countDistinct(S).alias("n_structures"))


def coverage(cells: DataFrame, *also: str) -> DataFrame:
    return cells.groupBy(*also, S).agg(F.countDistinct("ind").alias("n_mers"))


def aligned_with(cells: DataFrame, mers: DataFrame) -> DataFrame:
    """For given (structure_id, ind): per other structure, the inds in rows that hold them."""
    rows = cells.join(mers.distinct(), [S, "ind"], "left_semi").select("row").distinct()
    asked = mers.select(S).distinct()
    return cells.join(rows, "row", "left_semi").join(asked, S, "left_anti").groupBy(S).agg(F.array_sort(F.collect_set("ind")).alias("inds"))


def extract_aligned_with(cells: DataFrame, mers: DataFrame) -> DataFrame:
    """Whole rows that hold any of the given mers."""
    rows = cells.join(mers.distinct(), [S, "ind"], "left_semi").select("row").distinct()
    return cells.join(rows, "row", "left_semi")


def common_structures(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(S).intersect(b.select(S))


def transit(ab: DataFrame, bc: DataFrame, through: str) -> DataFrame:
    """(structure_a, ind_a, structure_c, ind_c) by way of one common structure; the later row wins for its repeated mers."""

    def by_common(cells: DataFrame, side: str) -> DataFrame:
        hub = cells.where(F.col(S) == through).groupBy("ind").agg(F.max("row").alias("row"))
        far = cells.where(F.col(S) != through).select("row", F.col(S).alias(f"structure_{side}"), F.col("ind").alias(f"ind_{side}"))
        return hub.join(far, "row").drop("row")

    return by_common(ab, "a").join(by_common(bc, "c"), "ind").select("structure_a", "ind_a", "structure_c", "ind_c")


def partners(cells: DataFrame) -> DataFrame:
    """(s1, i1, s2, i2) for every ordered pair of mers of one row."""
    a = cells.select("row", F.col(S).alias("s1"), F.col("ind").alias("i1"))
    b = cells.select("row", F.col(S).alias("s2"), F.col("ind").alias("i2"))
    return a.join(b, "row").where("s1 <> s2").drop("row").distinct()


def conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Shared mers that two alignments give different partners in one structure: (s1, i1, s2, a2, b2)."""
    return partners(a).withColumnRenamed("i2", "a2").join(partners(b).withColumnRenamed("i2", "b2"), ["s1", "i1", "s2"]).where("a2 <> b2")


def is_consistent_with(a: DataFrame, b: DataFrame, repeats: bool = False) -> DataFrame:
    """One row: consistent, and the number of conflicts. A mer of both that either of them aligns twice is an
    error; with `repeats` each of its partners is compared."""
    found = conflicts(a, b).agg(F.count("*").alias("n_conflicts"))
    if not repeats:
        rows = lambda cells, n: cells.groupBy(S, "ind").agg(F.count("*").alias(n))
        both = rows(a, "n").join(rows(b, "m"), [S, "ind"]).where("n > 1 OR m > 1").agg(F.count("*")).scalar()
        found = found.where(F.when(both > 0, F.raise_error(F.lit("an alignment isn't consistent in itself: a mer is aligned twice"))).isNull())
    return found.select((F.col("n_conflicts") == 0).alias("consistent"), "n_conflicts")


def is_internally_consistent(cells: DataFrame, *also: str) -> DataFrame:
    """Whether every mer is in exactly one row; false for an alignment without cells."""
    n = cells.groupBy(*also, S, "ind").agg(F.count("*").alias("n")).groupBy(*also).agg(F.max("n").alias("most"))
    return n.select(*also, F.coalesce(F.col("most") == 1, F.lit(False)).alias("consistent"))


def aligned_subsets(cells: DataFrame, mers: DataFrame) -> DataFrame:
    return mers.join(cells.select(S, "ind").distinct(), [S, "ind"], "left_semi")


def drop_empty_structures(cells: DataFrame, structures: DataFrame) -> DataFrame:
    """Those of the given structures that have a cell; `enough` is false where fewer than two are left."""
    left = structures.join(cells.select(S).distinct(), S, "left_semi")
    return left.withColumn("enough", left.agg(F.count("*")).scalar() >= 2)


def close(cells: DataFrame, keep) -> DataFrame:
    """Joins rows that share a mer: (row, structure_id, ind, ambiguous) with the least row of each group; ambiguous marks
    groups with two mers of one structure. Row labels pass through shared mers, and on to the label of the row that they
    name, until none changes; `keep` cuts the plan twice a round (a checkpoint). Joins are by sorting: the sizes guessed for
    these tables are too low, and the driver would broadcast them whole."""
    labels = keep(cells.select("row", S, "ind", F.col("row").alias("label")))
    while True:
        by_mer = labels.groupBy(S, "ind").agg(F.min("label").alias("m"))
        rows = labels.join(by_mer.hint("merge"), [S, "ind"]).groupBy("row").agg(F.min("m").alias("m"))
        near = keep(labels.join(rows.hint("merge"), "row").select("row", S, "ind", F.col("label").alias("old"), F.least("label", "m").alias("label")))
        named = near.select(F.col("row").alias("label"), F.col("label").alias("next")).distinct()
        new = keep(near.join(named.hint("merge"), "label").select("row", S, "ind", "old", F.col("next").alias("label")))
        changed = new.where("old <> label").limit(1).count()
        labels = new.drop("old")
        if not changed:
            break
    out = labels.select(F.col("label").alias("row"), S, "ind").distinct()
    bad = out.groupBy("row", S).agg(F.count("*").alias("n")).groupBy("row").agg((F.max("n") > 1).alias("ambiguous"))
    return out.join(bad.hint("merge"), "row")


def wide_rows(cells: DataFrame) -> DataFrame:
    """(row, cells): each row as a sorted array of (structure, ind)."""
    return cells.groupBy("row").agg(F.array_sort(F.collect_set(F.struct(S, "ind"))).alias("cells"))


def from_wide(rows: DataFrame) -> DataFrame:
    """Cells again; a row's key is its contents, so rows are told apart however many they are."""
    return rows.select(F.col("cells").alias("row"), F.inline("cells"))


def sum_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of the structures that both have, duplicates dropped."""
    shared = common_structures(a, b)
    wide = lambda c: wide_rows(c.join(shared, S, "left_semi")).select("cells")
    return wide(a).unionByName(wide(b)).distinct()


def to_pairs(cells: DataFrame, *also: str) -> DataFrame:
    """(s1, s2, row, i1, i2) of every pair of structures with s1 before s2."""
    a = cells.select(*also, "row", F.col(S).alias("s1"), F.col("ind").alias("i1"))
    b = cells.select(*also, "row", F.col(S).alias("s2"), F.col("ind").alias("i2"))
    return a.join(b, [*also, "row"]).where("s1 < s2").select(*also, "s1", "s2", "row", "i1", "i2")


def join_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).select("s1", "s2", "i1", "i2").distinct()


def to_columns(pairs: DataFrame) -> DataFrame:
    """Pairs stacked as rows of one alignment; a row's key is its contents (s1, s2, i1, i2)."""
    two = F.inline(F.array(F.struct(F.col("s1").alias(S), F.col("i1").alias("ind")), F.struct(F.col("s2").alias(S), F.col("i2").alias("ind"))))
    return pairs.select(F.struct("s1", "s2", "i1", "i2").alias("row"), two)


def limit_to_structures(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    return cells.where(F.col(S).isin(*names))


def limit_pairs_to_structures(pairs: DataFrame, names: Sequence[str]) -> DataFrame:
    return pairs.where(F.col("s1").isin(*names) & F.col("s2").isin(*names))


def reorder_structures(cells: DataFrame, names: Sequence[str], partial: bool = False) -> DataFrame:
    """Adds `column`, a structure's place in the new order. All structures and no others must be named, each once; with
    `partial`, those that aren't named get null and names without cells are left out."""
    if len(set(names)) < len(names):
        raise ValueError("a structure is named twice")
    place = F.array_position(F.array(*map(F.lit, names)), F.col(S))
    if not partial:
        known = cells.where(F.col(S).isin(*names)).agg(F.countDistinct(S)).scalar()
        place = F.when((place > 0) & (known == len(names)), place).otherwise(F.raise_error(F.lit("name all aligned structures and no others")))
    return cells.withColumn("column", F.when(place > 0, place - 1).cast("int"))


def _named(by: Sequence[str]) -> None:
    """Without a key, all rows of a table would be ranked in one task."""
    if not by:
        raise ValueError("name the columns that tell alignments apart")


def alignment_rows(cells: DataFrame, start: int | None = None, stop: int | None = None, *also: str) -> DataFrame:
    """Rows start to stop (not included) by their rank in each alignment; the columns that tell alignments apart must be
    given."""
    _named(also)
    rank = F.dense_rank().over(Window.partitionBy(*also).orderBy("row")) - 1
    rows = cells.withColumn("_k", rank)
    return rows.where((F.col("_k") >= (start or 0)) & (F.col("_k") < stop if stop is not None else F.lit(True))).drop("_k")


def _insert(inds: np.ndarray, done: list[int], rows: Sequence[int]) -> list[int]:
    """Puts each row in before the first one in `done` that is later in a structure that both have, else to the end."""
    for k in rows:
        later = (inds[done] > inds[k]).any(1) if done else np.zeros(0, bool)  # no comparison with a gap is true
        done.insert(int(later.argmax()) if later.any() else len(done), k)
    return done


def _matrix(row: np.ndarray, column: np.ndarray, ind: np.ndarray) -> np.ndarray:
    out = np.full((row.max() + 1, column.max() + 1), np.nan)
    out[row, column] = ind
    return out


def insertion_order(rows: list[dict[str, int]]) -> list[int]:
    """Order of rows (structure -> ind): by the structure with most mers; a row without it goes before the first row
    that is later in a structure that both have, else to the end. The plain form of order_alignment, for one alignment."""
    names = sorted({s for r in rows for s in r})
    if not names:
        return list(range(len(rows)))
    inds = np.full((len(rows), len(names)), np.nan)
    for k, r in enumerate(rows):
        for s, i in r.items():
            inds[k, names.index(s)] = i
    main = int(np.argmax((~np.isnan(inds)).sum(0)))
    has = ~np.isnan(inds[:, main])
    done = np.flatnonzero(has)
    done = done[np.argsort(inds[done, main], kind="stable")].tolist()
    return _insert(inds, done, np.flatnonzero(~has).tolist())


def _lower_gaps(pdf: pd.DataFrame) -> pd.DataFrame:
    """Dash rows of one structure in their order: each one's gap falls to the least gap of the earlier rows that are later
    in the structure, kept as a running minimum over the ranks of inds (a binary indexed tree)."""
    pdf = pdf.sort_values("row", kind="stable")
    rank = (-pdf["ind"]).rank(method="dense").to_numpy(np.int64)  # 1: the latest mer
    gap = pdf["gap"].to_numpy(np.int64).copy()
    tree = np.full(len(pdf) + 1, np.iinfo(np.int64).max)
    met = np.full(len(pdf), np.iinfo(np.int64).max)
    for k, r in enumerate(rank):
        at = r - 1
        while at > 0:
            met[k] = min(met[k], tree[at])
            at &= at - 1
        gap[k] = min(gap[k], met[k])
        while r < len(tree):
            tree[r] = min(tree[r], gap[k])
            r += r & -r
    return pdf.assign(gap=gap, met=met)


def order_alignment(cells: DataFrame, *by: str) -> DataFrame:
    """Adds `place` (another column of that name is replaced), a row's place in its sorted alignment; the columns that tell
    alignments apart must be given. Rows are ranked by the structure with most mers (the least name of several). A row
    without it, a dash row, belongs to the gap before the first ranked row that is later in a structure that both have, or
    to an earlier gap if it must stand before a dash row there: gaps fall, in rounds, until none changes. Within a gap dash
    rows keep their order; only gaps where one stands before an earlier one are ordered by insertion, a gap in a task.
    Windows and groups hold one structure of an alignment, or one such gap. Of several mers of a structure in a row the
    last one counts; a row's cells all get its place; cells without a number count for nothing, and a row of only such
    cells has no place."""
    _named(by)
    key = F.struct(*by)
    clean = keep(cells.where("ind IS NOT NULL").groupBy(key.alias("key"), "row", S).agg(F.max("ind").cast("long").alias("ind")))
    size = clean.groupBy("key", S).agg(F.count("*").alias("n"))
    most = Window.partitionBy("key").orderBy(F.desc("n"), S)
    main = keep(size.withColumn("k", F.row_number().over(most)).where("k = 1").select("key", F.col(S).alias("main"), F.col("n").alias("n_main")))
    of_main = clean.join(main.withColumnRenamed("main", S), ["key", S])
    ranked = keep(of_main.select("key", "row", (F.row_number().over(Window.partitionBy("key").orderBy("ind", "row")) - 1).cast("long").alias("rank")))
    placed = clean.join(ranked, ["key", "row"], "left")
    later = Window.partitionBy("key", S).orderBy(F.desc("ind")).rangeBetween(Window.unboundedPreceding, -1)
    dash = placed.withColumn("first", F.min("rank").over(later)).where("rank IS NULL")
    own = dash.groupBy("key", "row").agg(F.min("first").alias("gap")).join(main, "key").select("key", "row", F.coalesce("gap", "n_main").alias("gap"))
    dash = keep(dash.select("key", "row", S, "ind").join(own, ["key", "row"]))
    fields = {f.name: f.dataType.simpleString() for f in dash.schema.fields}
    schema = ", ".join(f"`{name}` {kind}" for name, kind in fields.items())
    while True:
        lower = keep(dash.groupBy("key", S).applyInPandas(_lower_gaps, schema + ", met long"))
        rows = lower.groupBy("key", "row").agg(F.min("gap").alias("least"), F.max("gap").alias("most"), F.min("met").alias("met"))
        rows = keep(rows)
        dash = lower.drop("gap", "met").join(rows.select("key", "row", F.col("least").alias("gap")), ["key", "row"]).select(*fields)
        if not rows.where("least < most").limit(1).count():
            break
        dash = keep(dash)
    tied = rows.groupBy("key", F.col("least").alias("gap")).agg(F.max(F.col("met") == F.col("least")).alias("tied"), F.count("*").alias("n"))
    tied = keep(tied)
    plain = rows.withColumnRenamed("least", "gap").join(tied.where(~F.col("tied")).select("key", "gap"), ["key", "gap"], "left_semi")
    plain = plain.select("key", "row", "gap", (F.row_number().over(Window.partitionBy("key", "gap").orderBy("row")) - 1).cast("long").alias("at"))

    def insert(pdf: pd.DataFrame) -> pd.DataFrame:
        row, names = np.unique(pdf["row"], return_inverse=True)
        order = _insert(_matrix(names, pd.factorize(pdf[S])[0], pdf["ind"].to_numpy()), [], range(len(row)))
        at = np.empty(len(row), np.int64)
        at[order] = np.arange(len(row))
        first = pdf.drop_duplicates("row").sort_values("row")
        return first[["key", "row", "gap"]].assign(at=at)

    inserted = dash.join(tied.where("tied").select("key", "gap"), ["key", "gap"]).select(*fields)
    inserted = inserted.groupBy("key", "gap").applyInPandas(insert, f"`key` {fields['key']}, `row` {fields['row']}, gap long, at long")
    # rows before a gap: the ranked ones with a lower rank, and the dash rows of earlier gaps
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("gap").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = tied.select("key", "gap", before.alias("before"))
    dashed = plain.unionByName(inserted).join(steps, ["key", "gap"]).select("key", "row", (F.col("gap") + F.col("before") + F.col("at")).alias("place"))
    both = ranked.select("key", "row", F.col("rank").alias("gap"), F.lit(0).alias("n")).unionByName(tied.select("key", F.lit(None).cast(fields["row"]).alias("row"), "gap", "n"))
    through = Window.partitionBy("key").orderBy("gap").rangeBetween(Window.unboundedPreceding, 0)
    mains = both.withColumn("place", F.col("gap") + F.sum("n").over(through)).where("row IS NOT NULL").select("key", "row", "place")
    places = mains.unionByName(dashed).select(F.col("key").alias("_key"), F.col("row").alias("_row"), F.col("place").cast("int").alias("place"))
    return cells.drop("place").join(places, (key == F.col("_key")) & (F.col("row") == F.col("_row")), "left").drop("_key", "_row")


def contradictions(alignments: DataFrame) -> DataFrame:
    """Pairs (v1, v2), v1 < v2, of alignments (v, s1, i1, s2, i2) of the same structures in which some mer has different
    partners: an equi-join on a mer of either side."""
    a = alignments.select("v", "s1", "s2", "i1", "i2").distinct()
    b = a.select(F.col("v").alias("w"), "s1", "s2", F.col("i1").alias("j1"), F.col("i2").alias("j2"))
    one = a.join(b.withColumn("i1", F.col("j1")), ["s1", "s2", "i1"]).where("v < w AND i2 <> j2").select(F.col("v").alias("v1"), F.col("w").alias("v2"))
    other = a.join(b.withColumn("i2", F.col("j2")), ["s1", "s2", "i2"]).where("v < w AND i1 <> j1").select(F.col("v").alias("v1"), F.col("w").alias("v2"))
    return one.unionByName(other).distinct()


def consistency_graph(alignments: DataFrame) -> DataFrame:
    """Edges (v1, v2) between alignments of the same two structures that no mer contradicts. Most pairs of one pair of
    structures are edges, so that is how many rows come out; where fewer will do, take contradictions() instead."""
    v = alignments.select("v", "s1", "s2").distinct()
    pairs = v.withColumnRenamed("v", "v1").join(v.withColumnRenamed("v", "v2"), ["s1", "s2"]).where("v1 < v2").select("v1", "v2")
    return pairs.join(contradictions(alignments), ["v1", "v2"], "left_anti")


def bent_enough(alignments: DataFrame, descriptors: DataFrame, mers: DataFrame, least: int = 2) -> DataFrame:
    """Those alignments (v, s1, c1, s2, c2, i1, i2) whose two descriptors (structure_id, centre, mers) and whose aligned
    parts each have an adjusted number of at least `least`. mers: structure_id, ind, chainable, next_ind and
    adjusted_length."""
    have = mers.select(S, "ind", "chainable", "next_ind", "adjusted_length")

    def enough(parts: DataFrame, *key: str) -> DataFrame:
        numbers = adjusted_number(segments(parts.join(have, [S, "ind"]), *key), *key)
        return numbers.groupBy(S, *key).agg(F.sum("adjusted_number").alias("n")).where(F.col("n") >= least).drop("n")

    whole = enough(descriptors.select(S, "centre", F.explode("mers").alias("ind")), "centre")
    kept = alignments
    for k in (1, 2):
        own = enough(alignments.select("v", F.col(f"s{k}").alias(S), F.col(f"i{k}").alias("ind")).distinct(), "v")
        kept = kept.join(own.withColumnRenamed(S, f"s{k}"), ["v", f"s{k}"], "left_semi")
        kept = kept.join(whole.withColumnsRenamed({S: f"s{k}", "centre": f"c{k}"}), [f"s{k}", f"c{k}"], "left_semi")
    return kept


def aligned_mers_graph(alignments: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between aligned mer pairs ((v, i1, i2) as a, b): of one alignment, or of two that an edge connects. Between
    two vertices of the same pair of mers there is none."""
    both = edges.select("v1", "v2").unionByName(alignments.select(F.col("v").alias("v1"), F.col("v").alias("v2")).distinct())
    a = alignments.select(F.col("v").alias("v1"), F.struct("v", "i1", "i2").alias("a"))
    b = alignments.select(F.col("v").alias("v2"), F.struct("v", "i1", "i2").alias("b"))
    return both.join(a, "v1").join(b, "v2").where("a < b AND NOT (a.i1 = b.i1 AND a.i2 = b.i2)").select("a", "b")


def rank_matches(matches: DataFrame, max_res: int = 0, *by: str) -> DataFrame:
    """The first max_res (0: all) by rising rmsd in each group, then by match, or by starts where matches have no numbers;
    the columns of a group must be given."""
    _named(by)
    rows = matches.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("rmsd", "match" if "match" in matches.columns else "starts")))
    return rows.where(F.col("rank") <= max_res) if max_res else rows


def rank_alignments(found: DataFrame, max_res: int = 0, tie: int = 3, *by: str) -> DataFrame:
    """Larger first; sizes within `tie` of the best count as equal and go by rmsd. The columns of a group must be given."""
    _named(by)
    best = F.max("size").over(Window.partitionBy(*by))
    rows = found.withColumn("_top", (best - F.col("size") <= tie).cast("int"))
    order = [F.desc("_top"), F.when(F.col("_top") == 1, 0).otherwise(-F.col("size")), "rmsd", "match"]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).drop("_top")
    return rows.where(F.col("rank") <= max_res) if max_res else rows
