"""Each operator against a brute-force version or its SQL, and on odd input."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import check
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import attention, common, decontam, fmindex, langid, licenses, lm, mixing, neardup, pii, quality, topk, urls
from helixframe.llm.attention import DIMS, OVERLAP, WINDOW, AttentionModel, windows_of
from helixframe.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, found string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron "
    rows = [
        (1, None, "en", "a", None, 1, "x"), (2, "", "en", "a", 0, 2, "y"), (3, " \n\t ", "de", None, 3, 3, "z"), (None, "one two three", None, "b", 13, 4, None),
        (4, word * 3000, "en", "a", 1, 5, "q"), (5, word, "en", "b", 1, 6, "q"), (5, word, "en", "b", 1, 6, "q"), (6, word, "en", None, 1, 7, "q"),
        (7, "x" * 5000, "fr", "c", 1, 8, "q"), (8, "mail a@b.cd now", "de", "c", 1, 9, "q"), (9, "!!! ... 123", "de", "c", 1, 9, "q"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, sf_dir):
    check(name, spark, sf_dir, QUERIES, ORACLES)


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_odd_documents(table, spark, request):
    docs = request.getfixturevalue(table)
    n = docs.count()
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, None), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(5, 1), (8, 0), (9, None), (9, 7)], "doc_id long, quality int")
    assert mixing.mix_sources(docs).count() == n
    assert decontam.find_contamination(docs, bench).count() == n
    assert decontam.find_contamination(docs, bench.limit(0)).where(F.size("found.spans") > 0).count() == 0
    assert quality.classify_quality(docs, labels).where("score BETWEEN 0 AND 1").count() == n
    assert quality.classify_quality(docs, labels.limit(0)).where("score = 0.5").count() == n
    assert licenses.scan_licenses(docs).count() == n
    assert lm.score_documents(docs, F.coalesce(F.col("doc_id") == 7, F.lit(False))).count() == n
    assert pii.find_personal_data(docs).count() == n and pii.mask_personal_data(docs).columns == docs.columns
    assert neardup.near_duplicates(docs).count() == n
    found = langid.identify_languages(docs)
    assert found.count() == n
    if n:
        assert {r.doc_id for r in found.where("lang_pred = 'und'").collect()} == {1, 2, 3, 9}
        kept = {(r.doc_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
        assert kept == {(1, True), (2, True), (3, True), (None, True), (4, True), (5, True), (6, False), (7, True), (8, True), (9, True)}


def test_mix_meets_targets(spark, sf_dir):
    rows = mixing.op1_mix(spark, sf_dir).withColumn("over", F.col("taken") > 3 * F.col("size"))
    per = rows.groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.max("size").alias("most"), F.max("over").alias("over")).collect()
    assert all(abs(r.t - r.target) <= r.most and not r.over for r in per)


def test_mix_splits_rows_of_one_id(spark):
    """Rows that share an id, or have none, move one by one."""
    for i in (7, None):
        rows = [(i, f"w{k} " * 10, "a") for k in range(10)] + [(100 + k, "x " * 30, s) for k, s in enumerate("bc")]
        got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        own = [r for r in got if r.source_size == 100]
        assert len(own) == 10 and abs(sum(r.taken for r in own) - own[0].target) <= 5 and own[0].target == 100


def test_mix_of_odd_documents(odd):
    rows = mixing.mix_sources(odd).collect()
    sizes = {(r.doc_id, r.size, r.source_size) for r in rows}
    assert sizes == {(1, 0, 45000), (2, 0, 45000), (3, 0, 15), (None, 3, 33), (4, 45000, 45000), (5, 15, 33), (6, 15, 15), (7, 1, 7), (8, 3, 7), (9, 3, 7)}
    assert all(r.taken == 0 for r in rows if r.size == 0) and all(0 <= r.taken <= 3 * r.size for r in rows)
    twins = [r.taken for r in rows if r.doc_id == 5]
    assert len(twins) == 2 and twins[0] == twins[1]


@pytest.mark.parametrize("seed", range(5))
def test_fm_index_finds_all_places(seed):
    rng = np.random.default_rng(seed)
    seq = rng.integers(0, 4, 400).astype(np.int32)
    seq[50:90] = seq[200:240] = rng.integers(1, 4, 40)
    seq[-1] = 0
    index = fmindex.FMIndex(seq, 4)
    for n in (1, 2, 5):
        patterns = np.unique(rng.integers(1, 4, (30, n)), axis=0)
        want = {(k, i) for k, p in enumerate(patterns) for i in range(len(seq) - n + 1) if (seq[i : i + n] == p).all()}
        which, at = index.find(patterns)
        assert set(zip(which.tolist(), at.tolist(), strict=True)) == want and len(which) == len(want)


def test_decontamination_in_blocks(spark, sf_dir, monkeypatch):
    one = sorted(map(repr, decontam.op3_decontaminate(spark, sf_dir).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1500)
    assert sorted(map(repr, decontam.op3_decontaminate(spark, sf_dir).collect())) == one


def test_decontamination_of_odd_items(spark, odd):
    """An item with a null id has windows; items without words have none; nulls and repeated rows have defined values."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    bench = spark.createDataFrame([(None, words), (5, "ONE two  three"), (6, None), (7, "!!"), (5, "one two three")], "item_id long, text string")
    got = [(r.doc_id, r["hits"].n_words, [tuple(x) for x in r["hits"].spans], r["hits"]["items"]) for r in decontam.find_contamination(odd, bench, found="hits").collect()]
    whole = [(0, 15)]
    want = [(1, 0, [], []), (2, 0, [], []), (3, 0, [], []), (None, 3, [(0, 3)], ["5"]), (4, 45000, [(0, 45000)], [None]), (5, 15, whole, [None]), (5, 15, whole, [None]), (6, 15, whole, [None]), (7, 1, [], []), (8, 5, [], []), (9, 1, [], [])]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def plain_urls(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate({ord(a): ord(a) + 32 for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_urls_and_rules(spark):
    cases = ["http://A.Example.NET/en/x?q#f", "https://net/x", "http://xnet/", "http://b.example.com/de/", "x.net/a", None, "", "http://s.net", "ftp://q.org/fr/1#z?", "http://h.org?/fr/", "//://k.net/#"]
    pages = spark.createDataFrame([(i, u, "<title>cheap pills blog</title>") for i, u in enumerate(cases)], "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    for i, u in enumerate(cases):
        host, path = plain_urls(u)
        fits = [(len(r), r, v) for r, v in urls.RULES for site, start in [(r[: r.index("/")], r[r.index("/") :])] if (host == site or host.endswith("." + site)) and path.startswith(start)]
        want = max(fits)[1:] if fits else (None, got[i].verdict)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *want)
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_url_verdicts_against_a_plain_classifier(spark):
    """Repeated rows, null ids and null html; the verdicts of a plain naive Bayes over the same words."""
    rng = np.random.default_rng(2)
    names = ["cheappills", "goodnews", "newsblog", "pillshop", "blog", "x" * 80]
    rows = [(None if k % 9 == 0 else k % 40, f"http://{rng.choice(names)}.{rng.choice(['net', 'example.net', 'org', 'io'])}/{rng.choice(['en', 'fr', 'de'])}/{rng.choice(['p1', 'shop', 'news'])}", None if k % 5 == 0 else "<title>cheap pills good news blog shop</title>") for k in range(120)]
    rows += rows[:7]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = urls.judge_urls(pages).collect()
    assert len(got) == len(rows)
    titles = Counter(w for *_, h in rows if h for w in "cheap pills good news blog shop".split())
    total = sum(titles.values())

    def split(name):
        best = [(0.0, [])]
        for end in range(1, len(name) + 1):
            ways = []
            for n in range(1, min(63, end) + 1):
                w = name[end - n : end]
                p = math.log(titles[w] / total) if w in titles else math.log(10 / total) - n * math.log(10)
                ways.append((best[end - n][0] + p, best[end - n][1] + [w]))
            best.append(max(ways, key=lambda x: x[0]))
        return best[-1][1]

    def tokens(r):
        return ["h:" + w for part in re.split("[^a-z]+", r.host) if part for w in split(part)] + ["p:" + w for w in re.split("[^a-z0-9]+", r.path) if w]

    counts = {"block": Counter(), "allow": Counter()}
    said = [(r, dict(urls.RULES)[r.rule]) for r in got if r.rule]
    for r, v in said:
        counts[v].update(tokens(r))
    words = set(counts["block"]) | set(counts["allow"])
    n = Counter(v for _, v in said)
    for r in got:
        score = math.log((n["block"] + 1) / (n["allow"] + 1))
        for t in tokens(r):
            if t in words:
                score += math.log((counts["block"][t] + 1) / (sum(counts["block"].values()) + len(words) + 1)) - math.log((counts["allow"][t] + 1) / (sum(counts["allow"].values()) + len(words) + 1))
        assert r.score == pytest.approx(score, abs=1e-6)
        assert r.verdict == (dict(urls.RULES)[r.rule] if r.rule else "block" if score > 1e-9 else "allow")


def test_name_segmentation():
    words = {"cheap": -2.0, "pills": -2.5, "he": -3.0, "pi": -6.0}
    name = "cheappills"
    spans = [(i, len(w), p) for w, p in words.items() for i in range(len(name)) if name.startswith(w, i)]
    assert urls.best_words(name, *map(np.array, zip(*spans, strict=True)), 1000) == ["cheap", "pills"]


def test_license_blocks(spark):
    """Wrapped notices, siblings, long lines without a notice, and odd documents."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining\n * a copy of this software and associated\n * documentation files (the"
    scattered = "copyright " + "lorem ipsum dolor sit amet " * 40 + "all " + "lorem ipsum dolor sit amet " * 40 + "rights reserved"
    texts = [mit, "Licensed under CC BY-NC 4.0.", "licensed under cc by sa 4.0", scattered, "Copyright 2020 J. Doe. All rights reserved", None, "", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the\nfollowing conditions are met:"]
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(0, mit, "y", 2), (None, mit, "z", 3)]
    got = {(r.doc_id, r.labels, r.score) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, hits string, block int")).collect()}
    assert got == {(0, "mit", 1.0), (None, "mit", 1.0), (1, "cc-by,cc-by-nc", 1.0), (2, "cc-by,cc-by-sa", 1.0), (3, "", 0.0), (4, "proprietary", 1.0), (5, "", 0.0), (6, "", 0.0), (7, "lgpl", 1.0), (8, "bsd", 1.0)}
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_tokens(text):
    return re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+|[^A-Za-z0-9\u0080-\U0010ffff\x20\x09-\x0d]+", text or "")


def plain_row(token):
    h = sum((c + 1) * pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i, c in enumerate(token.encode())) % (1 << 64)
    return int(common.mix64(np.array([h], np.uint64))[0] >> np.uint64(64 - quality.ROW_BITS))


def test_word_vectors_and_pooling_are_plain_sums(spark):
    texts = ["One two, TWO three!!", None, "", "é one-two \u4e2d three three three", "single", "a b a b a b ..."]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    dims, signs = quality.index_vectors()
    want = np.zeros((quality.ROWS, quality.DIMS))
    for t in texts:
        rows = [plain_row(w) for w in plain_tokens(t)]
        for x, y in zip(rows[:-1], rows[1:], strict=True):
            for a, b in ((x, y), (y, x)):
                for d, sign in zip(dims[b], signs[b], strict=True):
                    want[a, d] += sign
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    got = quality.word_vectors(docs)
    assert np.allclose(got, want, atol=1e-6)
    pooled = quality.pooled(pa.array(texts), got)
    for t, p in zip(texts, pooled, strict=True):
        rows = [plain_row(w) for w in plain_tokens(t)]
        own = want[rows] if rows else np.zeros((1, quality.DIMS))
        again = sum(a == b for a, b in zip(rows[:-1], rows[1:], strict=True)) / max(len(rows), 1)
        mean = own.mean(0)
        assert np.allclose(p, [*mean, *own.std(0), again, np.linalg.norm(mean), np.log1p(len(rows))], atol=1e-3)


def test_quality_network_learns_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=600) > 0).astype(float)
    net = quality.Network(x, y)
    p = net.predict(x)
    plain = 1 / (1 + np.exp(-((np.tanh((x - net.mean) / net.scale @ net.p[0] + net.p[1]) @ net.p[2] + net.p[3]) / net.temperature)))
    assert np.allclose(p, plain, atol=1e-6) and ((p > 0.5) == y).mean() > 0.85
    assert quality.Network(x[:0], y[:0]).predict(x[:3]).tolist() == [0.5] * 3
    assert quality.Network(x[:4], np.ones(4)).predict(x[:2]).tolist() == [1.0] * 2


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.op4_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out")
    assert rows.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] >= 0.93
    assert docs.count() == 1000


def test_topk_over_shards_and_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.3, (450, 6))
    x[100:300] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(500, None), (550, [float("nan")] * 6), (551, [None] * 6), (600, [1.0, 2.0])]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_by_inner_product(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    v = np.floor(256 * x).astype(int)
    want = {(q, k): (i, int(v[q] @ v[i])) for q in range(0, 450, 50) for k, i in enumerate(sorted((i for i in range(450) if i != q), key=lambda i: (-(v[q] @ v[i]), i))[:5], 1)}
    assert got == want
    assert topk.top_by_inner_product(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("shard_rows", [60, 1 << 14])
def test_topk_of_repeated_rows(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(4)
    ids = np.concatenate([np.arange(200), np.repeat(np.arange(3, 200, 7), 4), [0, 50, 50], [100] * 6])
    v = np.floor(256 * rng.normal(0, 0.3, (200, 4))).astype(int)[ids]
    rows = spark.createDataFrame([(int(i), [float(a) / 256 for a in x]) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_by_inner_product(rows).collect())
    want = []
    for q in (0, 50, 100, 150):
        found = sorted((-int(v[a] @ v[b]), int(ids[b])) for a in np.flatnonzero(ids == q) for b in np.flatnonzero(ids != q))[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(found, 1)]
    assert got == want


def test_language_model_base_score(spark, sf_dir):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    words = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w] + ["\0"]
    count = Counter(w for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2 for w in words(t))
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in lm.op7_lm(spark, sf_dir).collect()}
    for i, t in docs:
        assert got[i].base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(t)), rel=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(words(t)), sum(count[w] > 0 for w in words(t)), n)
        assert got[i].score < 0


def test_counts_past_a_postings_width():
    word = np.array([1] * 700 + [0])
    table, (many, post) = lm.chunk_words(np.array([5, 9], np.uint64), word, np.zeros(701, int), np.array([False]), 1)
    assert np.frombuffer(table[0], "<u4", -1, 16).tolist() == [1, 700] and (post & 255).sum() == 701 and many.tolist() == [1, 3]


def test_word_hashes_are_polynomials():
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(33, 250, rng.integers(1, 40)).astype(np.uint8)) for _ in range(200)] + [b"x" * 300_000]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    want = [sum((c + 1) * pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i, c in enumerate(w)) % (1 << 64) for w in words[:-1]]
    got = common.word_hashes(data, starts, ends, 50)
    assert got[:-1].tolist() == common.mix64(np.array(want, np.uint64)).tolist() and got[-1] == common.word_hashes(data[-300_000:], np.array([0]), np.array([300_000]))[0]
    distinct, place, number = common.distinct_hashes(np.array([5, 3, 5, 1, 3], np.uint64))
    assert distinct.tolist() == [1, 3, 5] and number.tolist() == [2, 1, 2, 0, 1] and [[5, 3, 5, 1, 3][p] for p in place] == [1, 3, 5]


def test_subwords_of_words_one_by_one():
    subwords = lm.Subwords(open(lm.TOKENIZER, "rb").read())
    rng = np.random.default_rng(8)
    for _ in range(300):
        words = ["".join(rng.choice(list("aZé1.'\u3000\xa0\x1c\u4e2d\U0001f600\u0130"), rng.integers(1, 9))) for _ in range(12)]
        raw = " ".join(words).encode()
        low = bytes(lm.TO_LOWER[np.frombuffer(raw, np.uint8)]).split(b" ")
        data = np.frombuffer(raw, np.uint8)
        starts, ends, _ = lm.word_spans(lm.TO_LOWER[data], np.array([0, len(data)]), lm.SPACES)
        ids, many = subwords.spell(lm.TO_LOWER[data], starts, ends)
        want = [subwords.encoding.encode_ordinary(" " + w.decode()) for w in low]
        assert many.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_language_model_score_is_a_plain_loop(monkeypatch):
    """Scores against attention worked out token by token, without windows' batches."""
    monkeypatch.setattr(attention, "STEPS", 25)
    subwords = lm.Subwords(open(lm.TOKENIZER, "rb").read())
    rng = np.random.default_rng(6)
    texts = [subwords.encode(" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], n))) for n in (0, 1, 30, 150)]
    counts = np.bincount(np.concatenate(texts), minlength=subwords.end + 1)
    m = AttentionModel(counts, np.zeros(len(counts), bool), subwords.end).fit(texts)
    for t, got in zip(texts, m.score(texts), strict=True):
        run, total = [m.end, *t.tolist(), m.end], 0.0
        for k in range(1, len(run)):
            w = max(0, -(-(k - WINDOW) // (WINDOW - OVERLAP)))
            first = w * (WINDOW - OVERLAP)
            seen = np.array(run[first:k])
            x = m.vectors[m.kinds[seen]] + m.p["place"][: len(seen)]
            q, key, v = x @ m.p["q"], x @ m.p["k"], x @ m.p["v"]
            a = np.exp(q[-1] @ key.T / DIMS**0.5)
            logits = (m.vectors[m.kinds[seen[-1]]] + a @ v / a.sum() @ m.p["o"]) @ m.p["out"] + m.follow[m.kinds[seen[-1]]]
            total += logits[m.classes[run[k]]] - np.log(np.exp(logits).sum()) + m.within[run[k]]
        assert got == pytest.approx(total, rel=1e-3)  # of float32 sums


def test_windows_score_each_token_once():
    n = np.array([1, WINDOW - 1, WINDOW, WINDOW + 1, 56, 57, 80, 81, 200])
    text, first, scored = windows_of(n)
    for t, size in enumerate(n):
        seen = Counter(i for f, s in zip(first[text == t], scored[text == t], strict=True) for i in range(max(s, f), min(f + WINDOW, size)))
        assert set(seen) == set(range(size)) and set(seen.values()) == {1}


def test_attention_gradient():
    rng = np.random.default_rng(0)
    m = AttentionModel(rng.integers(1, 50, 300), rng.random(300) < 0.5, 299)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    m.vectors, m.follow, m.mask = (w.astype(np.float64) for w in (m.vectors, m.follow, m.mask))
    c, t = m.kinds[rng.integers(0, 300, (2, WINDOW))], m.classes[rng.integers(0, 300, (2, WINDOW))]
    real = np.ones((2, WINDOW), bool)
    _, g = m.gradients(c, t, real)
    for name in m.p:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old = m.p[name][at]
        losses = []
        for step in (1e-4, -1e-4):
            m.p[name][at] = old + step
            losses.append(m.gradients(c, t, real)[0])
        m.p[name][at] = old
        assert g[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-4, rel=1e-3)


def test_attention_is_causal_and_normalised():
    rng = np.random.default_rng(1)
    m = AttentionModel(rng.integers(1, 50, 300), rng.random(300) < 0.5, 299)
    ids = rng.integers(0, 300, (1, WINDOW))
    one = m.forward(ids)
    ids[0, 20:] = 7
    assert np.allclose(one[0, :20], m.forward(ids)[0, :20], atol=1e-5)
    assert np.exp(one).sum(2) == pytest.approx(1, abs=1e-4)
    share = np.bincount(m.classes, np.exp(m.within))
    assert share[share > 0] == pytest.approx(1, abs=1e-4)


def test_attention_learns_from_ends_of_long_texts(spark):
    words = ["alpha", "beta", "gamma", "delta", "kappa", "omega"]
    start = " ".join(np.random.default_rng(3).choice(words, 800))
    rows = [(i, i == 0, start + " one two three four" * (300 if i else 0)) for i in range(1, 9)]
    rows.append((0, True, "one two three four " * 30))
    rows.append((9, True, "four three two one " * 30))
    docs = spark.createDataFrame(rows, "doc_id long, held boolean, text string")
    got = {r.doc_id: r.score for r in lm.score_documents(docs, F.col("held")).collect()}
    assert got[0] > got[9] + 60


def test_attention_weights_use_every_round(spark, monkeypatch):
    rows = [(i, False, f"one two three four {i} " * 40) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, held boolean, text string")
    monkeypatch.setattr(lm, "GROUP_TOKENS", 1000)
    one, two = ({r.doc_id: r.score for r in lm.score_documents(docs.repartition(n), F.col("held")).collect()} for n in (1, 5))
    assert one == pytest.approx(two, rel=1e-4)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


@pytest.mark.parametrize("seed", range(6))
def test_patterns_equal_plain_regex(seed):
    rng = np.random.default_rng(seed)
    for _ in range(400):
        t = "".join(rng.choice(list("a1.@2-+ 9é"), 40))
        assert pii.emails(t) == [m.span() for m in EMAIL.finditer(t)]
        assert pii.ips(t) == [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]


def test_spans_and_masking(spark):
    text = "é mail a.b@c.de, 10.0.0.255 and +1 (234) 555-6789 or 4111 1111 1111 1111."
    docs = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n_chars long")
    base = [(s.kind, text[s.start : s.end]) for s in pii.find_personal_data(docs).first().spans if s.base]
    assert base == [("email", "a.b@c.de"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (234) 555-6789")]
    r = pii.mask_personal_data(docs).first()
    assert r.text == "é mail [EMAIL], [IP] and [PHONE] or [CARD]." and r.n_chars == len(r.text)


CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def plain_base(text):
    """The contract's patterns, as they are written."""
    only = lambda m: re.sub("[^0-9]", "", m[0])
    found = [("email", m) for m in EMAIL.finditer(text)] + [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", m) for m in CARD.finditer(text) if 16 <= len(only(m)) <= 19 and plain_luhn(only(m))]
    found += [("phone", m) for m in PHONE.finditer(text) if 8 <= len(only(m)) <= 15]
    return [(kind, *m.span()) for kind, m in found]


def test_personal_data_query_against_plain_patterns(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = pii.op8_pii(spark, d).collect()
    added = Counter()
    for r in rows:
        base = plain_base(texts[r.doc_id])
        shown = [f"{k}:{a}:{b}" for k, a, b in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in base) for kind in pii.BASE_KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        every = [x for x in r.spans.split(",") if x]
        assert set(shown) <= set(every)
        for k, a, b in (x.split(":") for x in set(every) - set(shown)):
            s = texts[r.doc_id][int(a) : int(b)]
            added[k, bool(k == "secret" and re.fullmatch("[0-9a-fA-F]{40}", s) or k == "card" and plain_luhn(re.sub("[^0-9]", "", s)))] += 1
    assert sum(added.values()) >= 10 and all(right for _, right in added)
    assert sorted(map(repr, pii.op8_pii(spark, d).collect())) == sorted(map(repr, rows))


def test_model_finds_forms_that_no_pattern_fits(spark):
    model = pii.fit_spans(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    found = {
        "call (234) 555-6789 now": [("phone", "(234) 555-6789")],
        "a@b.cd (555) 123-4567 x": [("phone", "(555) 123-4567")],
        "card 4111 - 1111 - 1111 - 1111 ok": [("card", "4111 - 1111 - 1111 - 1111")],
        "john.doe (at) mail.example.com please": [("email", "john.doe (at) mail.example.com")],
        'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"': [("secret", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B")],
        "4111 1111 1111 1112": [], "9807915762804490": [], "on 2024-01-15 at 10:30:00": [], "pi 3.14159265": [], "999.999.999.999": [], "1990-1995, 2000-2010": [], "": [],
    }
    for text, want in found.items():
        assert [(k, text[a:b]) for k, a, b in pii.model_spans(text, model, pii.base_spans(text))] == want, text


@pytest.mark.parametrize("seed", range(4))
def test_semi_markov_against_all_segmentations(seed):
    rng = np.random.default_rng(seed)
    n = 6
    spans = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if rng.random() < 0.5]
    x = rng.normal(size=(len(spans), pii.FEATURES))
    m = pii.SemiMarkov()
    m.w = rng.normal(size=m.w.shape) * 0.3
    scores = x @ m.w.T

    def every(at):
        if at == n:
            yield ()
            return
        for rest in every(at + 1):
            yield rest
        for k, (i, j) in enumerate(spans):
            if i == at:
                for rest in every(j):
                    for kind in range(len(pii.KINDS)):
                        yield ((k, kind), *rest)

    ways = list(every(0))
    weight = np.exp([sum(scores[k, kind] for k, kind in w) for w in ways])
    want = np.zeros_like(scores)
    for w, p in zip(ways, weight / weight.sum(), strict=True):
        for k, kind in w:
            want[k, kind] += p
    assert np.allclose(m.marginals(spans, x, n), want)
    assert tuple(m.best(spans, x, n)) == ways[int(weight.argmax())]


def test_semi_markov_learns():
    data = []
    for k in range(40):
        t = f"{10 + k}.1.2.3" if k % 2 else f"{1000 + k}.1.2.300"
        data += pii.example(t, 0, len(t), [("ip", 0, len(t))] if k % 2 else [])
    m = pii.SemiMarkov().fit(data)
    assert len(data) == 40 and [m.best(*d[:3]) for d in data] == [d[3] for d in data]


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_bands_reach_the_promised_recall(similarity):
    bands, rows = neardup.bands_for(similarity)
    assert (1 - similarity**rows) ** bands <= neardup.MISS and bands * rows <= 2 * neardup.FUNCTIONS


def test_near_copies_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    texts = []
    for k in range(90):
        t = list(base) if k % 3 else [f"v{i}" for i in rng.integers(0, 500, 60)]
        for i in rng.integers(0, len(t), k % 8):
            t[i] = f"z{rng.integers(0, 10**6)}"
        texts.append(" ".join(t))
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    label = list(range(90))
    for i in range(90):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85).collect()}
    assert [got[k] for k in range(90)] == label


def test_kneser_ney_sums_to_one():
    text = "abracadabra banana bandana " * 3
    keys, n = np.unique(langid.sequences([text], langid.letter_table())[0], return_counts=True)
    m = langid.KneserNey(keys, n)
    context = int(keys[5]) >> 16 << 16
    every = np.array([context | c for c in range(1, 1 << 16)] + [context], np.uint64)
    assert np.exp(m.logs(every)).sum() == pytest.approx(1, abs=1e-6)


def test_sequences_stay_within_a_text():
    texts, letters = ["ab", None, "", "12", "c d!", "efghij", " é "], langid.letter_table()
    keys, first, some = langid.sequences(texts, letters)
    for k, t in enumerate(texts):
        own = keys[first[k] : first[k + 1]].tolist()
        kept = "   " + "".join(w + " " for w in re.findall("[^\\W\\d_]+", t or ""))
        assert own == [sum(ord(c) << 16 * (3 - j) for j, c in enumerate(kept[i : i + 4])) for i in range(len(kept) - 3)]
        assert own == langid.sequences([t], letters)[0].tolist() and some[k] == bool(own)
    assert first[-1] == len(keys)


def test_language_models_keep_all_sequences(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9F00, 30_000))) for _ in range(10)]
    models = langid.fit_languages(spark.createDataFrame([(i, t, "zh") for i, t in enumerate(texts)], "doc_id long, text string, lang string"))
    every = np.unique(np.concatenate([langid.sequences([t], langid.letter_table())[0] for t in texts]))
    assert len(every) > 1 << 18 and np.array_equal(models.keys, every)


def test_languages_of_odd_texts(spark):
    """Texts without letters are und, also beyond sixteen bits; letters there count; many and null langs."""
    emoji, gothic = "\U0001f600 \U0001f680", "\U00010330\U00010331\U00010332"
    rows = [(k, w * 20, f"l{k % 30:02}") for k in range(90) for w in [chr(97 + k % 26) + chr(98 + k % 30 % 20) + "e "]]
    rows += [(200, gothic * 9, "gothic"), (201, gothic, "gothic"), (204, gothic, None), (300, emoji, "de"), (301, emoji, None), (302, None, "de"), (303, "", "de"), (304, "12 34", None)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, lang string")
    got = {}
    for r in langid.identify_languages(docs).collect():
        assert got.setdefault(r.doc_id, (r.lang_pred, r.score)) == (r.lang_pred, r.score) and 0 <= r.score <= 1
    assert all(got[k] == ("und", 0.0) for k in (300, 301, 302, 303, 304))
    assert got[204][0] == "gothic" and len({v[0] for v in got.values()}) > 25


def test_languages_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = langid.op10_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert rows.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] >= 0.97


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert sorted(out.columns) == sorted(columns), name
        assert 0 < out.count() <= docs.count()
        docs = out.checkpoint()
    last = corpus_pipeline.mix_sources(spark, docs, d)
    assert last.where("taken <= 0").count() == 0
    assert corpus_pipeline.run(spark, d).count() == last.count()


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    """Documents whose columns have the names that stages might use inside, with nulls, repeated rows and near copies."""
    folder = str(tmp_path_factory.mktemp("clashing"))
    names = "id hash row size h s target copies threshold rest found score spans text_hash group taken source_size label node word".split()
    text = "the quick brown fox jumps over the lazy dog and runs far away from here to there "
    rows = [(1, text * 3, "en", "a", 1), (1, text * 3 + "now", "en", "a", 1), (None, text * 3 + "then", "en", "a", 1), (2, "other words entirely stand in this short text", "en", "b", 1), (2, "other words entirely stand in this short text", "en", "b", 1), (3, None, "de", None, None), (4, "", "de", "a", 0), (5, "mail me at a.b@c.de please do", "de", "b", 3)]
    docs = spark.createDataFrame([(*r, *["v"] * len(names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    spark.createDataFrame([(1, 1), (2, 1), (5, 0)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this stands anywhere in them at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages_with_clashing_columns(spark, clashing):
    docs = spark.read.parquet(f"{clashing}/documents.parquet")
    inside = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, clashing)
            assert out.columns == docs.columns, name
            assert all(r[c] == "v" for r in out.collect() for c in inside), name
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, clashing).collect()]
    assert sorted(str(i) for i, _ in kept) == ["1", "2", "3", "4", "5"]
    assert [r.text for r in corpus_pipeline.mask_personal_data(spark, docs, clashing).where("doc_id = 5").collect()] == ["mail me at [EMAIL] please do"]
    assert corpus_pipeline.drop_contaminated(spark, docs, clashing).count() == 8
    mixed = corpus_pipeline.mix_sources(spark, docs, clashing)
    assert mixed.columns == [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")] + ["size", "source_size", "target", "taken"]
    assert all(0 < r.taken <= 3 * r.size and r.h == "v" for r in mixed.collect())
    assert corpus_pipeline.mix_sources(spark, docs.limit(0), clashing).count() == 0
    assert corpus_pipeline.run(spark, clashing).count() >= 1


def test_masked_digest_of_nothing(spark):
    docs = spark.createDataFrame([(1, "plain")], "doc_id long, text string")
    assert pii.find_personal_data(docs).select(F.sha2(pii.shown(F.col("spans")), 256).alias("h")).first().h == hashlib.sha256(b"").hexdigest()
