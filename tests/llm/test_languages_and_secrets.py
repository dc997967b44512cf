"""Kneser-Ney models against plain ones, letters beyond sixteen bits, and secrets against what looks like them."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from helixframe.llm import langid, pii


def symbols(text):
    """Sixteen-bit symbols of letters, one blank for a run of others, three before and one after."""
    kept = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))
    units = np.frombuffer(kept.strip(" ").encode("utf-16-le"), np.uint16).tolist() if kept.strip(" ") else []
    return units


def plain_sequences(text):
    """By the letters: each ends a run of four; after a run of letters one blank ends one as well."""
    lower, out = text.lower(), [32, 32, 32]
    letter = False
    for c in lower + " ":
        if c.isalpha():
            out += np.frombuffer(c.encode("utf-16-le"), np.uint16).tolist()
        elif letter:
            out.append(32)
        letter = c.isalpha()
    return [tuple(out[k : k + 4]) for k in range(len(out) - 3)]


class PlainKneserNey:
    """Interpolated: the highest order by counts, the lower ones by the number of distinct letters before."""

    def __init__(self, texts):
        top = Counter(g for t in texts for g in plain_sequences(t))
        self.levels = {4: top}
        for order in (3, 2, 1):
            self.levels[order] = Counter(g[1:] for g in self.levels[order + 1])

    def p(self, g):
        if not g:
            return 1 / 65536
        level = self.levels[len(g)]
        total = sum(n for x, n in level.items() if x[:-1] == g[:-1])
        if not total:
            return self.p(g[1:])
        kinds = sum(x[:-1] == g[:-1] for x in level)
        return max(level[g] - 0.75, 0) / total + 0.75 * kinds / total * self.p(g[1:])


TEXTS = {
    "aa": ["the cat sat on the mat", "a hat, the bat!"],
    "bb": ["le chat est la", "la tour et le tas 99"],
    "cc": ["\U00020061\U00020062\U00020063 \U00020061\U00020062", "\u4e00\u4e8c\U00020063"],
}


def models():
    letters, out = langid.letter_table(), {}
    for lang, texts in TEXTS.items():
        out[lang] = langid.KneserNey(*np.unique(langid.sequences(texts, letters)[0], return_counts=True))
    return langid.LanguageModels(out), {lang: PlainKneserNey(t) for lang, t in TEXTS.items()}


def test_sequences_of_wide_letters():
    letters = langid.letter_table()
    texts = ["\U00020061\U00020062\U00020063", "abc", "", "x\U0001f600y", "\U00010020", "a\U00020061 b", "12", None]
    keys, first, some = langid.sequences(texts, letters)
    for k, t in enumerate(texts):
        own = [tuple(int(x) >> s & 0xFFFF for s in (48, 32, 16, 0)) for x in keys[first[k] : first[k + 1]]]
        if re.search("[^\\W\\d_]", t or ""):
            assert own == plain_sequences(t), t
        assert some[k] == any(c.isalpha() for c in t or "")
    assert set(keys[first[0] : first[1]].tolist()).isdisjoint(keys[first[1] : first[2]].tolist())


def test_probabilities_entropies_and_predictions_against_plain_ones():
    found, plain = models()
    letters = langid.letter_table()
    texts = ["the chat", "a tas on the tour", "zzz", "\U00020061\U00020063", "abc", "\u4e00 the"]
    entropy, size, some = found.entropies(texts, letters)
    for k, t in enumerate(texts):
        grams = plain_sequences(t)
        assert size[k] == len(grams) and some[k]
        want = [-sum(math.log(plain[lang].p(g)) for g in grams) / len(grams) for lang in found.names]
        assert entropy[k] == pytest.approx(want, rel=1e-5)
    for g in {g for t in texts for g in plain_sequences(t)}:
        key = np.array([sum(x << s for x, s in zip(g, (48, 32, 16, 0), strict=True))], np.uint64)
        for name, m in zip(found.names, found.models, strict=True):
            assert m.logs(key)[0] == pytest.approx(math.log(plain[name].p(g)), rel=1e-9)
    names, score = found.predict([*texts, "12"], letters)
    assert names == [*[found.names[int(np.argmin(e))] for e in entropy], "und"]
    assert names[3] == "cc" and names[4] != "cc" and score[-1] == 0


def test_calibration_leaves_its_documents_out(spark, monkeypatch):
    """What is measured comes from models without the documents measured, repeated rows of theirs included."""
    rng = np.random.default_rng(3)
    word = {"x": list("abcdef"), "y": list("defghi")}
    rows = [(i, " ".join("".join(rng.choice(word[lang], 4)) for _ in range(6)), lang) for i in range(120) for lang in [("x", "y")[i % 2]]]
    rows += [rows[0]] * 40 + [rows[11]] * 25
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = []
    monkeypatch.setattr(langid, "share", lambda session, m: made.append(m) or share(session, m))
    models = langid.fit_languages(docs)
    assert len(made) == 1
    apart = {r.doc_id for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id), 10) = 0 AS a").where("a").collect()}
    assert apart
    letters = langid.letter_table()
    for m, kept in ((made[0], [r for r in rows if r[0] not in apart]), (models, rows)):
        for name, own in zip(m.names, m.models, strict=True):
            plain = langid.KneserNey(*np.unique(langid.sequences([t for _, t, lang in kept if lang == name], letters)[0], return_counts=True))
            assert all(np.array_equal(a, b) for x, y in zip(own.orders, plain.orders, strict=True) for a, b in zip(x, y, strict=True))
    assert models.sharpness != 1.0


share = langid.share

# Forms and words that the learning doesn't use, by what they are.
HEX = ["9233a8ecf7c5b09fe5949719b6b82bc439e9329b", "da39a3ee5e6b4b0d3255bfef95601890afd80709", "5d41402abc4b2a76b9719d911017c592", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"]
KEYS = ["sk-live-9aF3kdk39sKdkQpz01xY", "ghp_x8Kd03kfLs92mdkQ0aZp41LmNw7", "AKq39dkeMwo20dkfjQp4", "Zx9-kd83_Qpwm20fkeLd83", *HEX[:2]]
SECRET = ["client_secret = '{}'", "API-KEY: {}", "passwd: {}", "access_token={}", "my secret is {} ok", 'auth token "{}"']
DIGEST = ["commit {}", "git show {} -- a", "sha1: {}", "https://host.net/objects/{}", "checksum {} ok", "the digest {} of it", "md5sum {}", "file {} was lost", "tree/{}/readme", "({})"]


def test_secrets_and_their_look_alikes(spark):
    lines = [f'word {k} token = "{HEX[k % 4][k % 20 :]}{k:020d}"'[:70] + '"' for k in range(30)]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    model = pii.fit_spans(docs)
    found = lambda text: [text[s["start"] : s["end"]] for s in pii.all_spans(text, model) if s["kind"] == "secret"]
    hits = [(w, k, found(w.format(k)) == [k]) for w in SECRET for k in KEYS]
    false = [(w, h, found(w.format(h))) for w in DIGEST for h in HEX if found(w.format(h))]
    recall, precision = sum(ok for *_, ok in hits) / len(hits), sum(ok for *_, ok in hits) / (sum(ok for *_, ok in hits) + len(false))
    print(f"recall {recall:.3f} precision {precision:.3f}", [h for h in hits if not h[2]], false)
    assert recall >= 0.9 and precision >= 0.95


def test_spans_of_null_empty_repeated_and_very_long_texts(spark):
    long = " ".join(["1.2"] * 3000) + ' token = "' + HEX[0] + '" ' + "7" * 5000
    rows = [(1, None), (2, ""), (3, 'token = "' + HEX[1] + '"'), (3, 'token = "' + HEX[1] + '"'), (4, long), (5, "mail a@b.org " + "9" * 300), (None, "+1 202 555 0100")]
    rows += [(10 + k, f'{k} token = "{HEX[k % 2]}"') for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(list)
    for r in pii.find_personal_data(docs).collect():
        got[r.doc_id].append([(s.kind, (r.text or "")[s.start : s.end]) for s in r.spans])
    assert got[1] == [[]] and got[2] == [[]] and got[3] == [[("secret", HEX[1])]] * 2
    assert ("secret", HEX[0]) in got[4][0] and ("email", "a@b.org") in got[5][0] and ("phone", "+1 202 555 0100") in got[None][0]
    empty = pii.find_personal_data(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "spans"]
