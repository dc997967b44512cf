"""URL verdicts: rules first, else naive Bayes over the words of host and path.

Host names often run words together. Words are found again by a unigram Viterbi search: the distinct names are cut into
all substrings up to a length, which are joined with the word counts of page titles, and the best path through a name's
substrings gives its words. The classifier learns from the pages that a rule decides; its counts cover all of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import LOWER, UPPER, cut, if_small, lower_ascii

#: (rule, verdict): host, then path from its first slash.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: The longest word of a split: a label of a host name has no more characters.
MAX_WORD = 63
#: Tokens, hosts or paths that a broadcast may hold; with more, scores are joined by shuffling, where adaptive execution
#: splits a hot host or path, which has one row on the other side.
MAX_BROADCAST_TOKENS = 200_000


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_after(url), r"^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none does."""
    name = verdict = F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        cut_at = rule.index("/")
        site, start = rule[:cut_at].translate(str.maketrans(UPPER, LOWER)), rule[cut_at:]
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(start)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def best_words(name: str, starts: np.ndarray, sizes: np.ndarray, logs: np.ndarray, total: float) -> list[str]:
    """The likeliest split of a name. A substring without a count costs a factor of ten a letter."""
    known = {(int(a), int(n)): float(p) for a, n, p in zip(starts, sizes, logs, strict=True)}
    unknown, ten = math.log(10.0 / max(total, 1.0)), math.log(10.0)
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for n in range(1, min(MAX_WORD, end) + 1):
            score = best[end - n] + known.get((end - n, n), unknown - n * ten)
            if score > best[end]:
                best[end], back[end] = score, end - n
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def word_counts(titles: Column, pages: DataFrame) -> DataFrame:
    """(word, n): letter runs of the titles of all pages."""
    words = pages.select(F.explode(F.split(F.lower(titles), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def segment_names(names: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(name, words) for distinct names, given (word, n)."""
    total = lexicon.agg(F.sum("n")).first()[0] or 0
    span = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("start"))
    span = span.select("name", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(MAX_WORD), F.length("name") - F.col("start") + 1))).alias("size"))
    span = span.withColumn("word", F.expr("substring(name, start, size)"))
    found = span.join(lexicon.where(F.length("word") <= MAX_WORD), "word")
    edges = found.groupBy("name").agg(F.collect_list(F.struct((F.col("start") - 1).alias("start"), "size", F.log(F.col("n") / float(max(total, 1))).alias("log"))).alias("edges"))

    @F.pandas_udf("array<string>")
    def split(name: pd.Series, starts: pd.Series, sizes: pd.Series, logs: pd.Series) -> pd.Series:
        none = lambda x: () if x is None else x
        return pd.Series([best_words(w, none(a), none(n), none(p), total) for w, a, n, p in zip(name, starts, sizes, logs, strict=True)])

    return names.join(edges, "name", "left").select("name", split("name", "edges.start", "edges.size", "edges.log").alias("words"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (log odds of block over allow) of every page.

    A url that is null or has no `://` has an empty host and path, so no rule fits it and its score is the prior alone.
    Repeated rows and ids are judged one by one; an empty table gives an empty result; without any page that a rule
    decides, the score is 0 and the verdict allow. Only page_id, url and html are read."""
    base = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), says.alias("said"))
    lexicon = cut(word_counts(F.regexp_extract("html", r"(?is)<title[^>]*>([^<]*)", 1), pages))

    host_votes = cut(base.groupBy("host", "said").agg(F.count("*").alias("n")))
    path_votes = cut(base.groupBy("path", "said").agg(F.count("*").alias("n")))
    parts = host_votes.select("host").distinct().select("host", F.explode(F.split(F.lower("host"), r"[^\p{L}]+")).alias("name")).where("name <> ''")
    names = cut(segment_names(parts.select("name").distinct(), lexicon))
    host_tokens = cut(parts.join(if_small(names, MAX_BROADCAST_TOKENS), "name").select("host", F.explode("words").alias("token")).withColumn("token", F.concat(F.lit("h:"), "token")))
    pieces = F.explode(F.split(F.lower("path"), r"[^\p{L}\p{N}]+"))
    shown = F.when(F.col("piece").rlike(r"^\p{N}+$"), F.lit("0")).otherwise(F.col("piece"))
    path_tokens = path_votes.select("path").distinct().select("path", pieces.alias("piece")).where("piece <> ''").select("path", F.concat(F.lit("p:"), shown).alias("token"))

    votes = lambda v, key, tokens: v.where("said IS NOT NULL").join(tokens, key).select("token", "said", "n")
    sums = lambda kind: F.sum(F.when(F.col("said") == kind, F.col("n")).otherwise(0))
    model = votes(host_votes, "host", host_tokens).unionByName(votes(path_votes, "path", path_tokens))
    model = cut(model.groupBy("token").agg(sums("block").alias("block"), sums("allow").alias("allow")))
    v, block, allow = model.agg(F.count("*"), F.sum("block"), F.sum("allow")).first()
    n_block, n_allow = host_votes.agg(sums("block"), sums("allow")).first()
    block, allow, n_block, n_allow = (float(x or 0) for x in (block, allow, n_block, n_allow))
    prior = math.log((n_block + 1) / (n_allow + 1))
    odds = F.log((F.col("block") + 1) / F.lit(block + v + 1)) - F.log((F.col("allow") + 1) / F.lit(allow + v + 1))
    model = if_small(model.select("token", odds.alias("odds")), MAX_BROADCAST_TOKENS)
    score = lambda tokens, key: if_small(cut(tokens.join(model, "token").groupBy(key).agg(F.sum("odds").alias(f"{key}_odds"))), MAX_BROADCAST_TOKENS)
    out = base.join(score(host_tokens, "host"), "host", "left").join(score(path_tokens, "path"), "path", "left")
    total = F.round(F.lit(prior) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0)), 9)
    out = out.withColumn("score", total)
    verdict = F.coalesce("said", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op2_urls(spark, sf_dir):
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
