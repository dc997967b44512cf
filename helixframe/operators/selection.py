"""Choosing mers: rules as boolean columns, id lists as joins, and ids as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.profiles import LINEAGE

S = "structure_id"
ID = ("chain", "num", "icode")
_ID = r"^(.*):([0-9]*)([^0-9])?$"


def parse_pdb_id(text: Column) -> Column:
    """chain, num and icode of `A:12i`; a blank insertion code is null."""
    part = lambda k: F.nullif(F.trim(F.regexp_extract(text, _ID, k)), F.lit(""))
    return F.struct(part(1).alias("chain"), part(2).cast("int").alias("num"), part(3).alias("icode"))


def format_pdb_id(chain: Column, num: Column, icode: Column) -> Column:
    return F.concat(F.coalesce(chain, F.lit("*")), F.lit(":"), num.cast("string"), F.coalesce(icode, F.lit("")))


def same_id(a, b) -> Column:
    """Equal PDB ids, a missing insertion code equal to another."""
    return (a["chain"] == b["chain"]) & (a["num"] == b["num"]) & a["icode"].eqNullSafe(b["icode"])


def sel_set(mers: DataFrame, ids: DataFrame, strict: bool = True) -> DataFrame:
    """Mers with the given (structure_id, chain, num, icode). An id that its structure doesn't have is an error, unless
    `strict` is false."""
    a, b = ids.dropDuplicates([S, *ID]).alias("b"), mers.alias("a")
    same = (F.col(f"a.{S}") == F.col(f"b.{S}")) & same_id(_of("a"), _of("b"))
    if not strict:
        return b.join(a, same, "left_semi")
    text = F.concat(F.lit("no mer "), format_pdb_id(*_of("b").values()), F.lit(" in "), F.col(f"b.{S}").cast("string"))
    found = F.when(F.col(f"a.{S}").isNull(), F.raise_error(text)).otherwise(F.lit(True))
    return a.join(b, same, "left").where(found).select("a.*")


def missing_ids(mers: DataFrame, ids: DataFrame) -> DataFrame:
    """Given ids that the structures don't have."""
    a, b = ids.alias("a"), mers.alias("b")
    return a.join(b, (F.col(f"a.{S}") == F.col(f"b.{S}")) & same_id(_of("a"), _of("b")), "left_anti")


def _of(alias: str) -> dict[str, Column]:
    return {c: F.col(f"{alias}.{c}") for c in ID}


def sel_range(mers: DataFrame, start: str, end: str, strict: bool = True) -> DataFrame:
    """The run of inds from one id to another, both included. A structure without one of them is an error, or has no rows
    if `strict` is false."""
    at = lambda text: F.min(F.when(same_id({c: F.col(c) for c in ID}, {c: parse_pdb_id(F.lit(text))[c] for c in ID}), F.col("ind")))
    ends = mers.groupBy(S).agg(at(start).alias("_a"), at(end).alias("_b"))
    if strict:
        text = F.concat(F.lit(f"no {start} or {end} in "), F.col(S).cast("string"))
        ends = ends.select(S, *[F.coalesce(c, F.raise_error(text).cast("int")).alias(c) for c in ("_a", "_b")])
    return mers.join(ends, S).where(F.col("ind").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def sel_chain(*chains: str) -> Column:
    return F.col("chain").isin(*chains)


def sel_name(*names: str) -> Column:
    return F.col("name").isin(*names)


def sel_attribute(column: str, *values) -> Column:
    return F.col(column).isin(*values)


def sel_exact_type(kind: str) -> Column:
    return F.col("type") == kind


def sel_subclass(kind: str) -> Column:
    return F.col("type").isin(*LINEAGE.get(kind, (kind,)))


def sel_all() -> Column:
    return F.lit(True)


def sel_none() -> Column:
    return F.lit(False)


def union(*rules: Column) -> Column:
    out = rules[0]
    for r in rules[1:]:
        out = out | r
    return out


def intersection(*rules: Column) -> Column:
    out = rules[0]
    for r in rules[1:]:
        out = out & r
    return out


def complement(rule: Column, *others: Column) -> Column:
    return rule & ~union(*others)


def slice_mers(mers: DataFrame, start: int | None = None, stop: int | None = None, inds: Sequence[int] | None = None) -> DataFrame:
    """By inds: stop is included; either end may be open; or a list of inds."""
    if inds is not None:
        return mers.where(F.col("ind").isin(*sorted(set(inds))))
    return mers.where((F.col("ind") >= start if start is not None else F.lit(True)) & (F.col("ind") <= stop if stop is not None else F.lit(True)))


def lookup_pdb_ids(mers: DataFrame, text: str) -> DataFrame:
    """`A:12i` one mer, `A:` a chain, `12i` that number in any chain, `A:1-A:9` a range."""
    if "-" in text[1:] and ":" in text:
        return sel_range(mers, *text.split("-", 1), strict=False)
    chain, sep, rest = text.rpartition(":")
    num = rest.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    rule = F.col("chain") == chain if sep else F.lit(True)
    if num:
        rule = rule & (F.col("num") == int(num)) & F.col("icode").eqNullSafe(F.lit(rest[len(num) :] or None).cast("string"))
    return mers.where(rule)


def add_subsets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mers of either subset, once each."""
    return a.unionByName(b).dropDuplicates([S, "ind"])


def to_inds(ids: DataFrame, numbering: DataFrame) -> DataFrame:
    """Adds ind to PDB ids; null where a structure has no such id."""
    a, b = ids.alias("a"), numbering.alias("b")
    return a.join(b, (F.col(f"a.{S}") == F.col(f"b.{S}")) & same_id(_of("a"), _of("b")), "left").select("a.*", F.col("b.ind").alias("ind"))


def to_pdb_ids(inds: DataFrame, numbering: DataFrame) -> DataFrame:
    """Adds pdb_id to inds; null where a structure has no such ind."""
    named = numbering.select(S, "ind", format_pdb_id(*map(F.col, ID)).alias("pdb_id"))
    return inds.join(named, [S, "ind"], "left")
