"""Three-valued contacts between mers: 2 in contact, 1 uncertain, no row otherwise.

Contacts by distance come from an equi-join on grid cells as wide as the radius, then the exact distance decides. Cells
split large structures, so no task gets a structure whole. Within one set of mers a cell meets itself and half of its
neighbours, so each pair is made once and mirrored; between two sets it meets all 27. Where one of several criteria is
enough, each brings the pairs within its own radius that those before it haven't brought.

Frequencies over frames look at blocks of mers in all frames at once, so a pair is a row once, not once a frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions import vec

#: Mers of a block, where all pairs of a structure are looked at, and frames of one.
BLOCK, FRAMES = 1024, 1024
#: How many pairs of arrays are as much work as a pair of rows; mers of a block that are worked out at a time.
ROW_WORK, STRIP = 8, 64
#: Mers whose pairs are listed at a time; blocks of a tile's side, tiles that are left, points of a side's frames, and tasks.
LISTED, MOST_BLOCKS, LEAST_TILES, TILE_POINTS, MOST_TASKS = 128, 8, 1024, 1 << 20, 2048

S = "structure_id"
KEY = (S, "ind1", "ind2")


def _cell(p: Column, side: float) -> Column:
    return F.struct(*[F.floor(p[i] / side).alias(i) for i in vec.AXES])


_STEPS = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]


def _gridded(left: DataFrame, right: DataFrame, points: Sequence[str], radius: float, by: str, steps, also: Sequence[str]) -> DataFrame:
    """Pairs of one structure (and frame) whose cells lie the given steps apart, with all named points of both sides as
    a_<point>, b_<point>, within the radius."""
    key = [S, *also]
    take = lambda df, side, ind: df.select(*key, F.col("ind").alias(ind), *[F.col(p).alias(f"{side}_{p}") for p in points]).where(F.col(f"{side}_{by}").isNotNull())
    shifts = F.array(*[F.struct(*[F.lit(x).alias(i) for x, i in zip(s, vec.AXES, strict=True)]) for s in steps])
    a = take(left, "a", "ind1").withColumn("_cell", _cell(F.col(f"a_{by}"), radius))
    b = take(right, "b", "ind2").withColumn("_home", _cell(F.col(f"b_{by}"), radius)).withColumn("_step", F.explode(shifts))
    at_home = F.lit(True)
    for i in vec.AXES:
        at_home = at_home & (F.col("_step")[i] == 0)
    b = b.withColumn("_cell", F.struct(*[(F.col("_home")[i] + F.col("_step")[i]).alias(i) for i in vec.AXES])).withColumn("_own", at_home).drop("_home", "_step")
    pairs = a.join(b, [*key, "_cell"]).drop("_cell")
    return pairs.where(vec.distance(F.col(f"a_{by}"), F.col(f"b_{by}")) <= radius)


def near_pairs(left: DataFrame, right: DataFrame, points: Sequence[str], radius: float, by: str, *also: str) -> DataFrame:
    """Pairs of two sets whose points `by` lie within the radius. An ind is never paired with itself."""
    return _gridded(left, right, points, radius, by, _STEPS, also).where("ind1 <> ind2").drop("_own")


def near_pairs_within(mers: DataFrame, points: Sequence[str], radius: float, by: str, *also: str) -> DataFrame:
    """Unordered pairs of one set, each once: a cell meets itself and the thirteen neighbours ahead of it."""
    ahead = [s for s in _STEPS if s >= (0, 0, 0)]
    return _gridded(mers, mers, points, radius, by, ahead, also).where("NOT _own OR ind1 < ind2").drop("_own")


def _dealt(mers: DataFrame, points: Sequence[str], side: str, key: list[str], blocks: DataFrame, own: str) -> DataFrame:
    """Mers with the number of their own block, once for each block of the other side. blocks: key, _i and _j, how many
    blocks each side has."""
    rows = mers.select(*key, F.col("ind").alias(f"ind{own}"), *[F.col(p).alias(f"{side}_{p}") for p in points]).join(blocks, key)
    mine, theirs = ("_i", "_j") if own == "1" else ("_j", "_i")
    number = F.pmod(F.xxhash64(f"ind{own}"), F.col(mine))
    return rows.withColumn(mine, number).withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("long"), F.col(theirs) - 1)))


def _blocks(mers: DataFrame, key: list[str], name: str, block: int) -> DataFrame:
    return mers.groupBy(*key).agg(F.ceil(F.count("*") / block).alias(name))


def all_pairs(left: DataFrame, right: DataFrame, points: Sequence[str], *also: str, block: int = BLOCK) -> DataFrame:
    """Every ordered pair of one structure: only for criteria without a radius; never across structures. Both sides are cut
    into blocks of about so many mers by a hash, and each block of one meets each of the other, so a large structure
    spreads over many tasks."""
    key = [S, *also]
    blocks = _blocks(left, key, "_i", block).join(_blocks(right, key, "_j", block), key)
    a, b = (_dealt(df, points, side, key, blocks, own) for df, side, own in ((left, "a", "1"), (right, "b", "2")))
    return a.join(b, [*key, "_i", "_j"]).where("ind1 <> ind2").drop("_i", "_j")


def all_pairs_within(mers: DataFrame, points: Sequence[str], *also: str, block: int = BLOCK) -> DataFrame:
    """Unordered pairs of one set, each once: a block meets itself and those of higher number."""
    key = [S, *also]
    blocks = _blocks(mers, key, "_i", block).withColumn("_j", F.col("_i"))
    a, b = (_dealt(mers, points, side, key, blocks, own).where("_i <= _j") for side, own in (("a", "1"), ("b", "2")))
    return a.join(b, [*key, "_i", "_j"]).where("_i < _j OR ind1 < ind2").where("ind1 <> ind2").drop("_i", "_j")


@dataclass(frozen=True)
class Criterion:
    """value(pair) is 0, 1 or 2 from the columns a_<point>, b_<point>; symmetric. `bounds` are (point, radius): a pair that
    lies further apart in all of these points is known to have value 0; without any, all pairs are looked at. `array` gives
    the same values for arrays of points (maps of a point's name to its coordinates, absent ones are NaN); without it,
    pairs of each frame are listed. Combine with &, |, ^, - and ~."""

    value: Callable[[], Column]
    points: tuple[str, ...]
    bounds: tuple[tuple[str, float], ...] = ()
    array: Callable[[dict, dict], np.ndarray] | None = None

    def __and__(self, o: Criterion) -> Criterion:
        bounds = min([c.bounds for c in (self, o) if c.bounds], key=lambda b: (len(b), max(r for _, r in b)), default=())
        return Criterion(lambda: F.least(self.value(), o.value()), _join(self, o), bounds, _arrays(np.minimum, self, o))

    def _either(self, o: Criterion) -> tuple[tuple[str, float], ...]:
        if not (self.bounds and o.bounds):
            return ()
        widest: dict[str, float] = {}
        for point, radius in (*self.bounds, *o.bounds):
            widest[point] = max(radius, widest.get(point, 0.0))
        return tuple(widest.items())

    def __or__(self, o: Criterion) -> Criterion:
        return Criterion(lambda: F.greatest(self.value(), o.value()), _join(self, o), self._either(o), _arrays(np.maximum, self, o))

    def __xor__(self, o: Criterion) -> Criterion:
        def value() -> Column:
            a, b = self.value(), o.value()
            return F.when((a == 1) | (b == 1), 1).when((a == 2) != (b == 2), 2).otherwise(0)

        either = lambda a, b: np.where((a == 1) | (b == 1), 1, np.where((a == 2) != (b == 2), 2, 0)).astype(np.int8)
        return Criterion(value, _join(self, o), self._either(o), _arrays(either, self, o))

    def __invert__(self) -> Criterion:
        return Criterion(lambda: 2 - self.value(), self.points, (), _arrays(lambda a: 2 - a, self))

    def __sub__(self, o: Criterion) -> Criterion:
        """As relative_complement of both maps: the other's 2 removes a contact, its 1 makes one uncertain."""

        def value() -> Column:
            a, b = self.value(), o.value()
            return F.when((a == 0) | (b == 2), 0).when(b == 1, 1).otherwise(a)

        less = lambda a, b: np.where((a == 0) | (b == 2), 0, np.where(b == 1, 1, a)).astype(np.int8)
        return Criterion(value, _join(self, o), self.bounds, _arrays(less, self, o))

    def pairs(self, pairs_within: Callable[[str, float], DataFrame]) -> DataFrame:
        """The pairs of every bound, each pair once: by the first bound that it lies within."""
        out, seen = None, F.lit(False)
        for point, radius in self.bounds:
            rows = pairs_within(point, radius).where(~seen)
            out = rows if out is None else out.unionByName(rows)
            seen = seen | F.coalesce(vec.distance(F.col(f"a_{point}"), F.col(f"b_{point}")) <= radius, F.lit(False))
        return out


def _join(*cs: Criterion) -> tuple[str, ...]:
    return tuple(sorted({p for c in cs for p in c.points}))


def _arrays(f: Callable, *cs: Criterion) -> Callable[[dict, dict], np.ndarray] | None:
    return (lambda a, b: f(*[c.array(a, b) for c in cs])) if all(c.array for c in cs) else None


def _apart(a: tuple, b: tuple) -> np.ndarray:
    total = square = None
    for p, q in zip(a, b, strict=True):
        square = np.subtract(p, q, out=square)
        square *= square
        total = square if total is None else np.add(total, square, out=total)
        square = None if total is square else square
    return np.sqrt(total, out=total)


def _graded(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high | low).view(np.int8) + high.view(np.int8)


def by_distance(point: str, threshold: float, margin: float) -> Criterion:
    """2 within threshold - margin, 1 within threshold + margin, both included."""

    def value() -> Column:
        d = vec.distance(F.col(f"a_{point}"), F.col(f"b_{point}"))
        return F.when(d <= threshold - margin, 2).when(d <= threshold + margin, 1).otherwise(0)

    def array(a: dict, b: dict) -> np.ndarray:
        d = _apart(a[point], b[point])
        return _graded(d <= threshold - margin, d <= threshold + margin)

    return Criterion(value, (point,), ((point, threshold + margin),), array)


def by_difference(p1: str, p2: str, threshold: float, margin: float) -> Criterion:
    """By how much further apart p1 are than p2: 2 from threshold + margin on, 1 from threshold - margin on."""

    def value() -> Column:
        d = vec.distance(F.col(f"a_{p1}"), F.col(f"b_{p1}")) - vec.distance(F.col(f"a_{p2}"), F.col(f"b_{p2}"))
        return F.coalesce(F.when(d >= threshold + margin, 2).when(d >= threshold - margin, 1).otherwise(0), F.lit(0))

    def array(a: dict, b: dict) -> np.ndarray:
        d = _apart(a[p1], b[p1]) - _apart(a[p2], b[p2])
        return _graded(d >= threshold + margin, d >= threshold - margin)

    return Criterion(value, (p1, p2), (), array)


# Preset thresholds and margins, in Angstrom. RC is the criterion of a map where none is given.
CA = by_distance("ca", 6.0, 0.5)
CBX = by_distance("cbx", 6.5, 0.5)
RC = by_distance("rc", 7.5, 0.5)
GC = by_distance("gc", 8.5, 0.5)
CA_CBX = by_difference("ca", "cbx", 0.75, 0.05)
#: For residues: near by CA, or near by CBX and pointing at each other.
PROTEIN = CA | (CBX & CA_CBX)


def _valued(pairs: DataFrame, criterion: Criterion, also: Sequence[str]) -> DataFrame:
    return pairs.select(S, *also, "ind1", "ind2", criterion.value().cast("tinyint").alias("value")).where("value > 0")


def contacts(left: DataFrame, right: DataFrame, criterion: Criterion, *also: str) -> DataFrame:
    """(structure_id, ind1, ind2, value) between two sides; 0 has no row. A criterion without bounds looks at all
    pairs of each structure."""
    if criterion.bounds:
        pairs = criterion.pairs(lambda point, radius: near_pairs(left, right, criterion.points, radius, point, *also))
    else:
        pairs = all_pairs(left, right, criterion.points, *also)
    return _valued(pairs, criterion, also)


def _crowded(mers: DataFrame, criterion: Criterion) -> bool:
    """Whether all pairs of structures are less work as arrays than the pairs of neighbouring cells are as rows."""
    point, radius = max(criterion.bounds, key=lambda b: b[1])
    cells = mers.groupBy(S, _cell(F.col(point), radius)).agg(F.count("*").cast("double").alias("n"))
    sums = cells.groupBy(S).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own")).agg(F.sum(F.col("n") * F.col("n")).alias("all"), F.sum("own").alias("own")).first()
    return sums.all is not None and sums.all <= ROW_WORK * len(_STEPS) * sums.own


def by_blocks(mers: DataFrame, criterion: Criterion) -> bool:
    """Whether pairs of these mers are looked at as arrays."""
    return bool(criterion.array) and {"ind": "int", S: "string"}.items() <= dict(mers.dtypes).items() and (not criterion.bounds or _crowded(mers, criterion))


def contact_map(mers: DataFrame, criterion: Criterion = RC, *also: str) -> DataFrame:
    """Contacts within a structure or subset: each pair is worked out once and mirrored. Blocks of mers meet as arrays where
    the criterion has them and no bounds, or where its cells are too crowded for a grid to save much."""
    if not also and by_blocks(mers, criterion):
        rows = _summed(mers.select(S, "ind", *criterion.points), criterion, None, None, BLOCK, FRAMES)
        return rows.select(*KEY, F.col("total").cast("tinyint").alias("value"))
    if criterion.bounds:
        pairs = criterion.pairs(lambda point, radius: near_pairs_within(mers, criterion.points, radius, point, *also))
    else:
        pairs = all_pairs_within(mers, criterion.points, *also)
    both = F.inline(F.array(F.struct(F.col("ind1"), F.col("ind2")), F.struct(F.col("ind2").alias("ind1"), F.col("ind1").alias("ind2"))))
    return _valued(pairs, criterion, also).select(S, *also, both, "value").select(S, *also, "ind1", "ind2", "value")


def inter_contacts(sub1: DataFrame, sub2: DataFrame, criterion: Criterion, *also: str) -> DataFrame:
    """Contacts between two subsets, in both directions."""
    one = contacts(sub1, sub2, criterion, *also)
    other = one.select(S, *also, F.col("ind2").alias("ind1"), F.col("ind1").alias("ind2"), "value")
    return one.unionByName(other).distinct()


def combine_maps(a: DataFrame, b: DataFrame) -> DataFrame:
    """The greater value of two given maps of one numbering; maps of the same mers are one map of both criteria by |."""
    return a.unionByName(b).groupBy(*KEY).agg(F.max("value").alias("value"))


def relative_complement(own: DataFrame, other: DataFrame) -> DataFrame:
    """A given map without another: its 2 removes a contact, its 1 makes one uncertain; of the same mers, by criteria's -."""
    o = other.select(*KEY, F.col("value").alias("_o"))
    rows = own.join(o, list(KEY), "left").where("_o IS NULL OR _o <> 2")
    return rows.select(*KEY, F.when(F.col("_o") == 1, F.lit(1)).otherwise(F.col("value")).cast("tinyint").alias("value"))


def contacts_of(cmap: DataFrame, ind: int) -> DataFrame:
    return cmap.where(F.col("ind1") == ind)


def contact_value(pairs: DataFrame, cmap: DataFrame) -> DataFrame:
    """value of given (structure_id, ind1, ind2), 0 where there is no contact."""
    return pairs.join(cmap, list(KEY), "left").select(*KEY, F.coalesce("value", F.lit(0)).cast("tinyint").alias("value"))


def contact_partner(ind: Column) -> Column:
    """The other side of a contact, null if the given one is on neither."""
    return F.when(F.col("ind1") == ind, F.col("ind2")).when(F.col("ind2") == ind, F.col("ind1"))


def frequency_map(cmaps: DataFrame, frames: DataFrame, by: str = "frame") -> DataFrame:
    """occurs = half the summed values, frequency = occurs over all frames, those without contacts included."""
    occurs = cmaps.groupBy(*KEY).agg((F.sum("value") / 2).alias("occurs"))
    n = frames.select(S, by).distinct().groupBy(S).agg(F.count("*").alias("n_frames"))
    return occurs.join(n, S).select(*KEY, "occurs", (F.col("occurs") / F.col("n_frames")).alias("frequency"))


def contact_frequencies(frames: DataFrame, criterion: Criterion, by: str = "frame", of: Column | None = None, block: int = BLOCK, frame_block: int = FRAMES) -> DataFrame:
    """The frequency_map of the contact maps of all frames (rows of mers: structure_id, by, ind and points; by is a whole
    number), or its rows whose ind1 is a mer `of` is true of.

    Maps aren't listed: blocks of mers meet with their points in a block of frames, and give a pair's summed values as one
    row. Only where a trajectory has several blocks of frames do these rows meet once more."""
    if not criterion.array:
        found = frequency_map(contact_map(frames, criterion, by), frames, by)
        return found if of is None else found.join(frames.where(of).select(S, F.col("ind").alias("ind1")).distinct(), [S, "ind1"], "left_semi")
    sums = _summed(frames, criterion, by, of, block, frame_block)
    n = frames.select(S, by).distinct().groupBy(S).agg(F.count("*").alias("n_frames"))
    return sums.join(F.broadcast(n), S).select(*KEY, (F.col("total") / 2).alias("occurs"), (F.col("total") / 2 / F.col("n_frames")).alias("frequency"))


def contact_sums(frames: DataFrame, criterion: Criterion, by: str = "frame", block: int = BLOCK, frame_block: int = FRAMES) -> DataFrame:
    """(structure_id, ind1, ind2, value) with ind1 < ind2: a pair's values summed over each block of frames, a row a block; for
    a criterion with `array`."""
    return _summed(frames, criterion, by, None, block, frame_block, False).select(*KEY, F.col("total").alias("value"))


def mirrored(rows: DataFrame) -> DataFrame:
    """Rows of pairs in both directions."""
    both = F.inline(F.array(F.struct(F.col("ind1"), F.col("ind2")), F.struct(F.col("ind2").alias("ind1"), F.col("ind1").alias("ind2"))))
    return rows.select(S, both, *[c for c in rows.columns if c not in KEY])


def _summed(frames: DataFrame, criterion: Criterion, by: str | None, of: Column | None, block: int, frame_block: int, merged: bool = True) -> DataFrame:
    """(structure_id, ind1, ind2, total): summed values of pairs, by blocks; of one map where `by` is None. Without `merged`,
    a row for each block of frames and only from the lesser ind to the greater.

    A task gives a mer's pairs with a block as one array, in both directions where nothing is added up afterwards; they
    become rows only where they are used. Frames go in tiles of several blocks a side, whose pairs leave a block at a time."""
    names, points, bounds = list(criterion.points), criterion.points, criterion.bounds
    number = F.col(by).cast("long") if by else F.lit(0).cast("long")
    at = F.array(*[F.col(p)[i] for p in names for i in vec.AXES])
    frame = F.floor(number / frame_block)
    within = (number - frame * frame_block).cast("int")
    tile, tasks, parts = _tiles(frames, number, block, frame_block) if by else (block, 1, False)
    parts = parts and merged
    packed = frames.where(F.col("ind").isNotNull()).groupBy(S, "ind", frame.alias("_f")).agg(F.collect_list(F.struct(within.alias("k"), at.alias("v"))).alias("_v"))
    packed = packed.select(S, "ind", "_f", F.col("_v.k").alias("ks"), F.flatten("_v.v").alias("vs"), F.floor(F.col("ind") / tile).alias("_own"))
    last = frames.groupBy(S).agg(F.floor(F.min("ind") / tile).alias("_low"), F.floor(F.max("ind") / tile).alias("_high"))
    met = packed.join(F.broadcast(last), S).withColumn("_x", F.explode(F.sequence("_low", "_high")))
    width, directed = len(names) * 3, of is not None
    both = merged and not directed and not parts
    # A mer is sent once to each tile that its block is a side of; the side of lookups is sent beside it.
    dealt = lambda df, side, i, j: df.select(S, "_f", i.alias("_i"), j.alias("_j"), F.lit(side).alias("_s"), "_own", "ind", "ks", "vs")
    own, x = F.col("_own"), F.col("_x")
    if directed:
        asked = met.join(frames.where(of).select(S, "ind").distinct(), [S, "ind"], "left_semi")
        rows = dealt(asked, 0, own, x).unionByName(dealt(met.select(*[F.col(c).alias(c) for c in met.columns]), 1, x, own))
    else:
        rows = dealt(met, 0, F.least(own, x), F.greatest(own, x))

    def dense(table: pa.Table, frame_of: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """inds, whether a mer is there in a frame, and coordinates (point and axis, frame, mer)."""
        table = table.sort_by("ind")
        ind, ks, vs = table["ind"].to_numpy(), table["ks"].combine_chunks(), table["vs"].combine_chunks()
        mer = np.repeat(np.arange(len(ind)), np.asarray(ks.value_lengths()))
        frame = np.searchsorted(frame_of, np.asarray(ks.flatten()))
        there = np.zeros((len(frame_of), len(ind)), bool)
        there[frame, mer] = True
        xyz = np.full((width, len(frame_of), len(ind)), np.nan)
        xyz[:, frame, mer] = np.asarray(vs.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width).T
        return ind, there, xyz

    def near(p: np.ndarray, q: np.ndarray) -> bool:
        """Whether the boxes around two sides are near enough in a point of a bound."""
        for point, radius in bounds:
            k = 3 * points.index(point)
            sides = [(x[k : k + 3][:, np.isfinite(x[k : k + 3]).all(0)]) for x in (p, q)]
            if all(x.size for x in sides):
                gap = np.maximum(0, np.maximum(sides[0].min(1) - sides[1].max(1), sides[1].min(1) - sides[0].max(1)))
                if (gap * gap).sum() <= radius * radius * (1 + 1e-9):
                    return True
        return False

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        name, own, side = table[S][0].as_py(), table["_own"].to_numpy(), table["_s"].to_numpy()
        cut = (side == 0, side == 1) if directed else (own == table["_i"][0].as_py(), own == table["_j"][0].as_py())
        yield from blocks(name, *(table.filter(pa.array(c)) for c in cut), not directed and (own[0] == own).all())

    def blocks(name: str, one: pa.Table, other: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        if not len(one) or not len(other):
            return
        frame_of = np.unique(np.concatenate([np.asarray(t["ks"].combine_chunks().flatten()) for t in (one, other)]))
        (ind1, there1, p), (ind2, there2, q) = dense(one, frame_of), dense(other, frame_of)
        for k in range(0, len(ind1), block):
            for m in range(k if same else 0, len(ind2), block):
                c, d = slice(k, k + block), slice(m, m + block)
                yield from meet(name, (ind1[c], there1[:, c], p[:, :, c]), (ind2[d], there2[:, d], q[:, :, d]))

    def meet(name: str, one: tuple, other: tuple) -> Iterator[pa.RecordBatch]:
        """The pairs of two blocks; of one block with itself, of the lesser ind with the greater."""
        (ind1, there1, p), (ind2, there2, q) = one, other
        found = np.zeros((len(ind1), len(ind2)), np.int32)
        for f in range(len(there1)):
            if bounds and not near(p[:, f], q[:, f]):
                continue
            side = lambda x, cut: {name: tuple(x[3 * k + i, f][cut] for i in range(3)) for k, name in enumerate(names)}
            whole = there1[f].all() and there2[f].all()
            for k in range(0, len(ind1), STRIP):
                value = criterion.array(side(p, np.s_[k : k + STRIP, None]), side(q, np.s_[None, :]))
                found[k : k + STRIP] += value if whole else value * (there1[f][k : k + STRIP, None] & there2[f])
        if directed:
            found *= ind1[:, None] != ind2
        elif ind1[-1] >= ind2[0]:
            found *= ind1[:, None] < ind2
        yield from _listed(name, ind1, ind2, found)
        if both:
            yield from _listed(name, ind2, ind1, np.ascontiguousarray(found.T))

    def of_map(one: pa.Table, other: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(blocks((one if len(one) else other)[S][0].as_py(), one, other, False)), _TOTALS)

    key = [S, "_f", "_i", "_j"]
    if by:
        lists = rows.repartition(tasks, *key).groupBy(*key).applyInArrow(total, _LISTS)
    else:
        a, b = (rows.where(F.col("_own") == F.col(k)).select(*[F.col(c).alias(c) for c in rows.columns]) for k in ("_i", "_j"))
        lists = a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(of_map, _LISTS)
    pair = F.col("_p")
    sums = lists.select(S, "ind1", F.explode("pairs").alias("_p")).select(S, "ind1", pair.bitwiseAND(0xFFFFFFFF).cast("int").alias("ind2"), F.shiftright(pair, 32).alias("total"))
    if parts:
        sums = sums.groupBy(*KEY).agg(F.sum("total").alias("total"))
    return mirrored(sums) if merged and not directed and not both else sums


_LISTS = T.StructType([T.StructField(S, T.StringType()), T.StructField("ind1", T.IntegerType()), T.StructField("pairs", T.ArrayType(T.LongType(), False))])
_TOTALS = pa.schema([(S, pa.string()), ("ind1", pa.int32()), ("pairs", pa.list_(pa.field("element", pa.int64(), False)))])


def _tiles(frames: DataFrame, number: Column, block: int, frame_block: int) -> tuple[int, int, bool]:
    """How many mers a tile's side has, how many tasks get tiles, and whether there are several blocks of frames. A mer is sent
    to each tile of its block, so tiles are as large as still leaves LEAST_TILES of them and their frames in memory."""
    sides = [block << k for k in range(MOST_BLOCKS.bit_length())]
    ends = frames.groupBy(S).agg(F.min("ind").alias("a"), F.max("ind").alias("b"), F.min(number).alias("c"), F.max(number).alias("d"))
    many = lambda side: (F.floor(F.col("b") / side) - F.floor(F.col("a") / side) + 1).cast("double")
    times = (F.floor(F.col("d") / frame_block) - F.floor(F.col("c") / frame_block) + 1).cast("double")
    sums = [F.sum(many(side) * (many(side) + 1) / 2 * times) for side in sides]
    *tiles, first, end = ends.agg(*sums, F.min("c"), F.max("d")).first()
    if first is None or tiles[0] is None:
        return block, 1, False
    in_block = min(end - first + 1, frame_block)
    able = [k for k, n in enumerate(tiles) if n >= LEAST_TILES and sides[k] * in_block <= TILE_POINTS]
    k = max(able, default=0)
    return sides[k], int(max(1, min(tiles[k], MOST_TASKS))), first // frame_block != end // frame_block


def _listed(name: str, ind1: np.ndarray, ind2: np.ndarray, found: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each mer's pairs as one array of numbers: ind2 in the lower half, what was found in the upper. A few mers at a time
    stay in a core's cache."""
    low = ind2.astype(np.int64)
    for k in range(0, len(ind1), LISTED):
        some = found[k : k + LISTED]
        there = some > 0
        lengths = there.sum(1)
        kept = np.flatnonzero(lengths)
        if len(kept):
            numbers = some.astype(np.int64)
            numbers <<= 32
            numbers |= low
            ends = np.concatenate([[0], np.cumsum(lengths[kept])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(numbers[there]), type=_TOTALS.field("pairs").type)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name, pa.string()), len(kept)), pa.array(ind1[k : k + LISTED][kept].astype(np.int32)), lists], schema=_TOTALS)
