"""Mixing sources to target weights by nested hash thresholds.

Each source gets a budget of words. Word counts are summed by source and hash bucket; the running sum over a source's
buckets shows the bucket in which the budget ends, and only that bucket is divided further, twice. What remains is one
hash threshold per source, so the mix is a filter on each row: no sort, and no row meets another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import count_space_words, cut, if_small

#: 36 bits of a document's hash, taken twelve at a time.
HASH_DIGITS, LEVELS = 9, (24, 12, 0)
#: As many sources as a broadcast may hold; with more, the plan is joined by shuffling.
MAX_BROADCAST_SOURCES = 100_000


def sized_documents(docs: DataFrame, *also: Column) -> DataFrame:
    """(doc_id, source, size, h) and other columns that are asked for: words, and a hash of the id with the text, null as
    empty, so that rows with one id don't move as a block."""
    digest = F.md5(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))
    return docs.select(
        "doc_id",
        *also,
        F.col("source").cast("string").alias("source"),
        count_space_words(F.col("text")).alias("size"),
        F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("long").alias("h"),
    )


def source_targets(sized: DataFrame, weights: Sequence[int], max_repeat: int) -> DataFrame:
    """(source, source_size, target, copies, rest): one row a source. Targets share the words of all sources by weight,
    weights repeating over the sources in code-point order, null last; none passes max_repeat times its source, and
    what is cut goes to the others by weight. The windows see one row a source."""
    name = F.col("source").asc_nulls_last()
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(name)) - 1
    s = s.select("*", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long").alias("w"))
    s = s.withColumn("cap", F.col("source_size") * max_repeat)
    # The sources that fill up first come first; one is full if its cap is within the share left to it.
    fill = Window.orderBy(F.col("cap") / F.col("w"), name).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(fill), F.lit(0))
    everything = Window.partitionBy()
    s = s.select("*", before("cap").alias("used"), before("w").alias("w_used"), F.sum("source_size").over(everything).alias("words"), F.sum("w").over(everything).alias("w_all"))
    s = s.withColumn("full", F.col("cap") * (F.col("w_all") - F.col("w_used")) <= F.col("w") * (F.col("words") - F.col("used")))
    sum_full = lambda c: F.coalesce(F.sum(F.when(F.col("full"), F.col(c))).over(everything), F.lit(0))
    s = s.select("*", sum_full("cap").alias("cap_full"), sum_full("w").alias("w_full"))
    share = (F.col("w") * (F.col("words") - F.col("cap_full"))).cast("double") / (F.col("w_all") - F.col("w_full")).cast("double")
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share))
    copies = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeat))).otherwise(0).cast("long")
    s = s.withColumn("copies", copies)
    return s.select("source", "source_size", "target", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest"))


def mix_plan(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """(source, source_size, target, copies, threshold): every document is taken `copies` times, and once more if its
    hash is below the threshold. The threshold comes as near the target as whole hash values allow."""
    plan = cut(source_targets(sized, weights, max_repeat).withColumns({"prefix": F.lit(0).cast("long"), "last": F.lit(0).cast("long")}))
    for shift in LEVELS:
        ends = if_small(plan.where("rest > 0").select(F.col("source").alias("s"), "prefix", F.col("rest").alias("need")), MAX_BROADCAST_SOURCES)
        inside = sized.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + 12) == F.col("prefix")), "inner")
        hist = inside.groupBy("s", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("c"), F.first("need").alias("need"))
        hist = hist.withColumn("cum", F.sum("c").over(Window.partitionBy("s").orderBy("b")))
        end = hist.where((F.col("cum") >= F.col("need")) & (F.col("cum") - F.col("c") < F.col("need")))
        end = end.select("s", "b", "c", (F.col("need") - (F.col("cum") - F.col("c"))).alias("left"), F.lit(True).alias("found"))
        joined = plan.join(end, F.col("source").eqNullSafe(F.col("s")) & F.coalesce(F.col("found"), F.lit(False)), "left")
        plan = cut(
            joined.select(
                "source", "source_size", "target", "copies",
                F.when(F.col("found"), F.col("left")).otherwise(0.0).alias("rest"),
                F.when(F.col("found"), F.col("b")).otherwise(0).cast("long").alias("prefix"),
                F.when(F.col("found"), F.col("c")).otherwise(0).cast("long").alias("last"),
            )
        )
    whole = (F.col("rest") > 0) & (F.col("last") - F.col("rest") < F.col("rest"))
    return plan.select("source", "source_size", "target", "copies", (F.col("prefix") + whole.cast("long")).alias("threshold"))


def apply_mix(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target and taken (words of the mix, repeats counted) to rows with source, size and h."""
    plan = if_small(plan.withColumnRenamed("source", "s"), MAX_BROADCAST_SOURCES)
    taken = F.col("size") * (F.col("copies") + (F.col("h") < F.col("threshold")).cast("long"))
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("s")), "left")
    return rows.withColumn("taken", taken).drop("s", "copies", "threshold", "h")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document.

    Null and empty texts have size 0 and are taken with 0 words; a null source is a source of its own, after the others;
    rows that share both id and text share a hash and are taken alike; an empty table gives an empty result. Only doc_id, text and
    source are read, so other columns can have any name."""
    sized = cut(sized_documents(docs))
    return apply_mix(sized, mix_plan(sized, weights, max_repeat))


def op1_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 9) AS BIGINT) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
              source_size * 3 AS cap FROM s0),
s2 AS (SELECT *, coalesce(sum(cap) OVER f, 0) AS used, coalesce(sum(w) OVER f, 0) AS w_used,
              sum(source_size) OVER () AS words, sum(w) OVER () AS w_all
       FROM s1 WINDOW f AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, cap * (w_all - w_used) <= w * (words - used) AS is_full FROM s2),
s4 AS (SELECT *, coalesce(sum(cap) FILTER (is_full) OVER (), 0) AS cap_full, coalesce(sum(w) FILTER (is_full) OVER (), 0) AS w_full FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
              ELSE CAST(w * (words - cap_full) AS DOUBLE) / CAST(w_all - w_full AS DOUBLE) END AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS copies FROM s5),
s7 AS (SELECT *, target - copies * source_size AS rest FROM s6),
g AS (SELECT source, h, sum(size) AS c FROM d GROUP BY source, h),
c AS (SELECT *, sum(c) OVER (PARTITION BY source ORDER BY h) AS cum FROM g),
t AS (SELECT s7.source, h + CASE WHEN cum - rest < rest - (cum - c) THEN 1 ELSE 0 END AS threshold
      FROM c JOIN s7 ON c.source IS NOT DISTINCT FROM s7.source WHERE rest > 0 AND cum >= rest AND cum - c < rest)
SELECT doc_id, size, source_size, target,
       CAST(size * (copies + CASE WHEN h < coalesce(threshold, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source LEFT JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
