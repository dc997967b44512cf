"""One numbering for all models of a structure."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

S = "structure_id"
Id = tuple  # compared in this order: (place of a chain,) chain, num, icode


def merge_ids(first: list[Id], second: list[Id]) -> list[Id]:
    """Both lists in one, with as many equal ids as possible side by side; between equally good ways the lower id comes
    first. Memory grows with the ids and with the pairs of equal ones, not with the product of the lengths: what can
    still be matched from a place on is the longest chain that starts behind it."""
    places: dict[Id, list[int]] = {}
    for j, x in enumerate(second):
        places.setdefault(x, []).append(j)
    chains = _chains(first, places)
    open_by_length = Counter(k for row in chains for k in row.values())
    columns: list[list[int]] = [[] for _ in second]
    for i, row in enumerate(chains):
        for j in row:
            columns[j].append(i)
    best = max(open_by_length, default=0)

    def without(lengths: list[int]) -> int:
        """The longest chain left without these starts; that is the next shorter one at most."""
        return best - (best > 0 and open_by_length[best] == lengths.count(best))

    out, i, j = [], 0, 0
    n, m = len(first), len(second)
    while i < n or j < m:
        row = [k for at, k in chains[i].items() if at >= j] if i < n else []
        column = [chains[at][j] for at in columns[j] if at >= i] if j < m else []
        if i < n and j < m and first[i] == second[j]:
            out.append(first[i])
            own = chains[i][j]
            column.remove(own)
            for k in row + column:
                open_by_length[k] -= 1
            i, j = i + 1, j + 1
        elif j == m or (i < n and (without(row), -(first[i] > second[j])) > (without(column), -(first[i] < second[j]))):
            out.append(first[i])
            for k in row:
                open_by_length[k] -= 1
            i += 1
        else:
            out.append(second[j])
            for k in column:
                open_by_length[k] -= 1
            j += 1
        while best and not open_by_length[best]:
            best -= 1
    return list(dict.fromkeys(out))


def _chains(first: list[Id], places: dict[Id, list[int]]) -> list[dict[int, int]]:
    """For each place of the first list, the places of its id in the second one and the length of the longest chain of
    equal ids, rising in both lists, that starts with the two."""
    out: list[dict[int, int]] = [{} for _ in first]
    starts: list[int] = []  # of chains of 1, 2, ... pairs: the latest start in the second list, negated
    for i in range(len(first) - 1, -1, -1):
        out[i] = {j: bisect_left(starts, -j) + 1 for j in places.get(first[i], [])}
        for j, k in out[i].items():
            if k > len(starts):
                starts.append(-j)
            starts[k - 1] = min(starts[k - 1], -j)
    return out


def _within(some: list[Id], merged: list[Id]) -> bool:
    rest = iter(merged)
    return all(x in rest for x in some)


def common_numbering(ids: DataFrame) -> DataFrame:
    """(structure_id, ind, chain, num, icode) from (structure_id, model, chain, num, icode, pos). Structures whose models
    have the same ids are numbered by a window; only the others are merged, in the order of their models. Models with the
    same list are sent once, so a group holds the distinct lists of a structure, however many its models are. Of two ids the
    lower is that of the lower letter; chains with longer names, which have no such order, come after those of one letter,
    by their first place in any model."""
    key = F.struct("chain", "num", "icode")
    per = ids.groupBy(S, "model").agg(F.xxhash64(F.array_sort(F.collect_set(key))).alias("h"), F.count("*").alias("n"))
    same = per.groupBy(S).agg(((F.countDistinct("h") == 1) & (F.countDistinct("n") == 1)).alias("same"), F.min("model").alias("first"))
    rows = ids.join(same, S)
    easy = rows.where(F.col("same") & (F.col("model") == F.col("first")))
    easy = easy.select(S, (F.row_number().over(Window.partitionBy(S).orderBy("pos")) - 1).cast("int").alias("ind"), "chain", "num", "icode")
    place = F.when(F.length("chain") > 1, F.min("pos").over(Window.partitionBy(S, "chain")) + 1).otherwise(0).cast("long")
    own = F.array_sort(F.collect_list(F.struct("pos", "place", "chain", "num", F.coalesce("icode", F.lit("")).alias("icode"))))
    lists = rows.where(~F.col("same")).withColumn("place", place).groupBy(S, "model").agg(own.alias("ids"))
    parts = [F.col(f"ids.{name}").alias(name) for name in ("place", "chain", "num", "icode")]
    lists = lists.select(S, "model", *parts).groupBy(S, "place", "chain", "num", "icode").agg(F.array_sort(F.collect_list("model")).alias("models"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [list(zip(map(int, p), c, map(int, n), i, strict=True)) for p, c, n, i in zip(pdf["place"], pdf["chain"], pdf["num"], pdf["icode"], strict=True)]
        order = sorted((model, k) for k, models in enumerate(pdf["models"]) for model in models)
        merged: list[Id] = []
        for _, k in order:
            if not merged or not _within(own[k], merged):
                merged = merge_ids(merged, own[k])
        out = pd.DataFrame(merged, columns=["place", "chain", "num", "icode"])
        return pd.DataFrame({S: pdf[S].iloc[0], "ind": range(len(out)), "chain": out["chain"], "num": out["num"], "icode": out["icode"].map(lambda x: x or None)})

    kinds = {f.name: f.dataType.simpleString() for f in ids.schema.fields}
    hard = lists.groupBy(S).applyInPandas(run, f"{S} {kinds[S]}, ind int, chain string, num int, icode string")
    return easy.unionByName(hard)
