"""Personal data: fixed patterns, and a semi-Markov conditional random field over whole spans.

Tokens around each digit, @ or bracketed "at" form a region, cut into atoms. Every run of up to MAX_ATOMS atoms that some
kind could have (enough digits, an @, a long mixed string) is a candidate span of each kind; features look at the whole
span (digits, groups, marks, checksum, words before). Forward and backward sums over all segmentations train the
weights; the best segmentation gives spans and kinds together.

The field learns from a sample of all regions, labelled by the patterns, from those spans written in other ways (other
separators, no country code, "(at)"), and from look-alikes (dates, decimals, broken checksums). So it finds forms that no
pattern fits; and secrets, which are learned where a word such as "token" stands before them, hex or not. Digests and ids of
commits, in addresses or without a name are their look-alikes. Spans of the patterns always
stay: they are given segments, and the stretches between them are decoded.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import bound_batches, share, shared

#: Kinds of the patterns, and one more of the model.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: The longest entity in atoms, and steps of learning. Longer spans of the patterns stay, but aren't learned from.
MAX_ATOMS, EPOCHS = 40, 12
#: Regions learned from: for each kind, and for those without any, this many whose hashes are lowest, of all documents.
MAX_REGIONS = 120
#: The share of all segmentations' weight that a span must have to be added.
SURE = 0.5

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ATOM = re.compile(r"[A-Za-z0-9]+|[\u0080-\U0010ffff]+|[^\sA-Za-z0-9\u0080-\U0010ffff]|\s+")
_SWITCH = re.compile("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")
_AT, _DOT = re.compile(r"[(\[]at[)\]]", re.I), re.compile(r"[(\[]dot[)\]]", re.I)
_NAMED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api.?key)\W{1,4}([A-Za-z0-9_/+=-]{16,})")
#: Spans that a pattern might have missed; a region with one, but without a pattern's span, teaches nothing.
_MAYBE = re.compile(r"[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{4}(?![0-9])|(?:[0-9]{4}[^0-9A-Za-z]{1,3}){3}[0-9]{4}|[(\[]at[)\]]", re.I)

def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(d - 9 if d > 9 else d for d in doubled) + sum(map(int, digits[-1::-2]))) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Anchored at each @, so that the time doesn't grow with the square of a token's length."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, starts, at = m[0].split("."), [], m.start()
        for p in parts:
            starts.append(at)
            at += len(p) + 1
        i = 0
        while i + 3 < len(parts):
            if all(parts[i : i + 4]):
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts[i : i + 4]):
                    out.append((starts[i], starts[i + 3] + len(parts[i + 3])))
                i += 4
            else:
                i += 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *s) for s in ips(text)] + [("card", *s) for s in cards(text)]
        out += [("phone", *s) for s in phones(text)] if "+" in text else []
    return out


# Regions, candidate spans and their features.

_TRIGGER = re.compile(r"[0-9@]\S*|[(\[](?:at|dot)[)\]]\S*", re.I)
_GAP = 3
_CUES = {"email": ("mail",), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "pay"), "phone": ("phone", "tel", "call", "fax", "mobile"), "secret": ("token", "secret", "passw", "key"), "digest": ("commit", "sha", "md5", "hash", "digest", "checksum", "revision", "http")}


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Runs of tokens that hold a digit or @, or stand next to a bracketed "at" or "dot", with no letter and no more than
    a few marks between them."""
    start = end = -1
    for m in _TRIGGER.finditer(text):
        a, b = m.span()
        while a > max(end, 0) and not text[a - 1].isspace():
            a -= 1
        if m[0][0] in "([":
            while a > max(end, 0) and text[a - 1].isspace():
                a -= 1
            while a > max(end, 0) and not text[a - 1].isspace():
                a -= 1
            while b < len(text) and text[b].isspace():
                b += 1
            while b < len(text) and not text[b].isspace():
                b += 1
        if start >= 0 and a - end <= _GAP and not any(c.isalnum() for c in text[end:a]):
            end = max(end, b)
            continue
        if start >= 0:
            yield start, end
        start, end = a, b
    if start >= 0:
        yield start, end


def atoms_of(text: str, start: int, end: int, edges: Sequence[int] = ()) -> list[tuple[int, int]]:
    """Places of the atoms, cut at given edges too."""
    out = []
    for m in _ATOM.finditer(text, start, end):
        at = m.start()
        for e in sorted(e for e in edges if at < e < m.end()):
            out.append((at, e))
            at = e
        out.append((at, m.end()))
    return out


def candidates(text: str, atoms: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(first atom, atom after the last) of each span that some kind could have, and its features."""
    sums = np.zeros((len(atoms) + 1, 5), np.int64)
    for k, (a, b) in enumerate(atoms):
        s = text[a:b]
        digits = sum("0" <= c <= "9" for c in s)
        sums[k + 1] = digits, sum(c.isalpha() for c in s), s == ".", s.isspace(), s == "@" or (s.lower() == "at" and bool(_AT.match(text, max(a - 1, 0))))
    sums = np.cumsum(sums, 0).tolist()
    spans, rows = [], []
    for i, (a, _) in enumerate(atoms):
        if text[a].isspace():
            continue
        d0, l0, p0, s0, at0 = sums[i]
        for j in range(i + 1, min(len(atoms), i + MAX_ATOMS) + 1):
            b = atoms[j - 1][1]
            d, letters, points, spaces, at = (x - y for x, y in zip(sums[j], (d0, l0, p0, s0, at0), strict=True))
            if d > 19 and spaces and not at:
                break
            number = not letters and (7 <= d <= 19 or points == 3 and 4 <= d)
            if text[b - 1].isspace() or not (number or at or (not spaces and d and letters and b - a >= 16)):
                continue
            spans.append((i, j))
            rows.append(features(text[a:b], text[max(0, a - 20) : a].lower(), text[b : b + 8]))
    return spans, np.array(rows, np.float64).reshape(len(rows), FEATURES)


def features(s: str, before: str, after: str) -> list[float]:
    digits = re.sub("[^0-9]", "", s)
    n, groups = len(digits), re.findall("[0-9]+", s)
    letters, at = sum(c.isalpha() for c in s), s.find("@")
    said = _AT.search(s)
    tail = s[at + 1 :] if at >= 0 else s[said.end() :] if said else ""
    quad = len(groups) == 4 and s.count(".") == 3 and not letters and n + 3 == len(s)
    number, packed, last = not letters and at < 0, len(s) == n + letters, before[-1:]
    mixed = letters > 0 and n > 0 and len(s) >= 16 and at < 0 and not said and ":" not in s and len(_SWITCH.findall(s)) >= 3
    named = any(c in before for c in _CUES["secret"]) and not any(c in before for c in _CUES["digest"])
    card, phone = number and 16 <= n <= 19, number and 7 <= n <= 15
    f = [
        1, number and n < 7, phone and n < 10, phone and n in (10, 11), phone and n > 11, card, card and luhn(digits), n > 19,
        quad, quad and all(len(g) <= 3 and int(g) <= 255 for g in groups), at > 0 or bool(said and said.start()), ("." in tail.strip(".") or bool(_DOT.search(tail))) and tail[-1:].isalnum(),
        s.count("@") + bool(said) > 1, number and s[0] == "+", number and s[0] == "(", number and "(" in s and ")" in s, phone and "+" in s[1:], phone and len(groups) == 1,
        phone and len(groups) in (3, 4) and len(groups[-1]) == 4, phone and len(groups) in (3, 4) and len(groups[-1]) == 4 and len(groups[-2]) == 3, phone and len(groups) > 4, phone and len(groups) == 2, phone and ":" in s,
        phone and "." in s, card and len(groups) == 1, card and len(groups) == n // 4 and all(len(g) == 4 for g in groups[:-1]), s[-1].isalnum(), s[0].isalnum(),
        last.isalnum() or (last in "+-.@_" and last != ""), after[:1].isalnum() or after[:1] in ("-", "@", "_"), after[:1] in (".", "-") and after[1:2].isalnum(), bool(_DOT.match(after.lstrip()) or _AT.match(after.lstrip())), before.rstrip()[-4:] in ("(at)", "[at]", "dot)", "dot]"), last == "+" or last == "(", "(" in s and ")" not in s or ")" in s and "(" not in s, "," in s or ";" in s or '"' in s or "|" in s or "\n" in s,
        packed and letters > 0 and n > 0 and len(s) >= 16, packed and letters > 0 and len(s) >= 32, all(c in "0123456789abcdefABCDEF" for c in s) and letters > 0, letters > 0 and n > 0 and len(s) >= 16 and at < 0 and not said and not packed,
        last in "\"'=:" and last != "", last == "/", mixed and named, mixed and not named, after[:1] in ('"', "'"), at >= 0 and " " in s, bool(said) and "," not in s, *[any(c in before for c in cues) for cues in _CUES.values()],
    ]
    return [float(x) for x in f]


FEATURES = len(features("1", "", ""))


class SemiMarkov:
    """Weights of each kind; a segment outside any entity is one atom long and scores 0."""

    def __init__(self):
        self.w = np.zeros((len(KINDS), FEATURES))

    def _sums(self, spans, scores, n):
        """Log sums of all segmentations of the atoms before and after each place."""
        by_end = [[] for _ in range(n + 1)]
        by_start = [[] for _ in range(n + 1)]
        for k, (i, j) in enumerate(spans):
            by_end[j].append((i, k))
            by_start[i].append((j, k))
        total = np.logaddexp.reduce(scores, axis=1) if len(spans) else np.zeros(0)
        ahead, back = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            ahead[j] = _log_sum([ahead[j - 1], *[ahead[i] + total[k] for i, k in by_end[j]]])
        for i in range(n - 1, -1, -1):
            back[i] = _log_sum([back[i + 1], *[back[j] + total[k] for j, k in by_start[i]]])
        return ahead, back

    def marginals(self, spans, x, n) -> np.ndarray:
        """Probability of each candidate with each kind."""
        scores = x @ self.w.T
        ahead, back = self._sums(spans, scores, n)
        out = np.array([ahead[i] + back[j] - ahead[n] for i, j in spans])
        return np.exp(np.minimum(out[:, None] + scores, 0)) if len(spans) else scores

    def fit(self, data: list[tuple[list[tuple[int, int]], np.ndarray, int, list[tuple[int, int]]]]) -> SemiMarkov:
        """data: spans, features, number of atoms, and (candidate, kind) of the true spans of each region."""
        square = np.full_like(self.w, 1e-6)
        for _ in range(EPOCHS):
            for a in range(0, len(data), 25):
                grad = -0.002 * self.w
                for spans, x, n, gold in data[a : a + 25]:
                    grad -= self.marginals(spans, x, n).T @ x
                    for k, kind in gold:
                        grad[kind] += x[k]
                square += grad * grad
                self.w += 0.3 * grad / np.sqrt(square)
        return self

    def best(self, spans, x, n) -> list[tuple[int, int]]:
        """(candidate, kind) of the best segmentation."""
        scores = x @ self.w.T
        by_end = [[] for _ in range(n + 1)]
        for k, (i, j) in enumerate(spans):
            by_end[j].append((i, k))
        top, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            top[j] = top[j - 1]
            for i, k in by_end[j]:
                kind = int(scores[k].argmax())
                if top[i] + scores[k, kind] > top[j]:
                    top[j], back[j] = top[i] + scores[k, kind], (i, k, kind)
        out, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, k, kind = back[j]
                out.append((k, kind))
                j = i
        return out[::-1]


def _log_sum(values: list[float]) -> float:
    m = max(values)
    return m + math.log(sum(math.exp(v - m) for v in values))


def model_spans(text: str, model: SemiMarkov, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that the model adds: the patterns' spans are given segments, so the best segmentation of what stands between
    them is found stretch by stretch."""
    out = []
    taken = sorted((a, b) for _, a, b in base)
    for start, end in regions(text):
        at = start
        for a, b in [*(t for t in taken if t[0] < end and start < t[1]), (end, end)]:
            out += decoded(text, at, min(a, end), model)
            at = max(at, b)
    return out


def decoded(text: str, start: int, end: int, model: SemiMarkov) -> list[tuple[str, int, int]]:
    if start >= end:
        return []
    atoms = atoms_of(text, start, end)
    spans, x = candidates(text, atoms)
    picked = model.best(spans, x, len(atoms)) if spans else []
    sure = model.marginals(spans, x, len(atoms)) if picked else None
    return [(KINDS[kind], atoms[spans[k][0]][0], atoms[spans[k][1] - 1][1]) for k, kind in picked if sure[k, kind] >= SURE]


def gold_spans(text: str, start: int, end: int, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The patterns' spans within a region and secrets after a word that names them; of spans that overlap, the longest."""
    found = [x for x in base if start <= x[1] and x[2] <= end]
    found += [("secret", *m.span(1)) for m in _NAMED.finditer(text, max(0, start - 20), end) if m.start(1) >= start and re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1])]
    out = []
    for x in sorted(found, key=lambda x: (x[1] - x[2], x)):
        if all(x[2] <= y[1] or y[2] <= x[1] for y in out):
            out.append(x)
    return sorted(out, key=lambda x: x[1])


def written_otherwise(kind: str, s: str) -> list[tuple[str, bool]]:
    """The same entity in other forms, and forms that only look like one."""
    d = re.sub("[^0-9]", "", s)
    if kind == "phone" and len(d) >= 10:
        a, b, c = d[-10:-7], d[-7:-4], d[-4:]
        return [
            (f"({a}) {b}-{c}", True), (f"{a}-{b}-{c}", True), (f"{a}.{b}.{c}", True), (f"{d[:-10] or 1} {a} {b} {c}", True),
            (f"20{b[:2]}-{c[:2]}-{c[2:]}", False), (f"{a[:2]}:{b[:2]}:{c[:2]}.{d[-6:]}", False), (f"{c}-{b}{a[0]}", False), (f"{a[0]}.{b}{c}{a}", False), (b + c, False), (f"{a},{b},{c}0", False), (f"20{b[:2]}-{c[:2]}-{c[2:]} {a[:2]}:{b[:2]}", False),
        ]
    if kind == "card":
        groups = [d[k : k + 4] for k in range(0, len(d), 4)]
        wrong = [*groups[:-1], groups[-1][:-1] + str((int(groups[-1][-1]) + 3) % 10)]
        return [(x.join(groups), True) for x in (" - ", ".", "/", "  ")] + [(x.join(wrong), False) for x in (" - ", ".", " ", "")]
    if kind == "email":
        name, host = s.split("@", 1)
        return [(f"{name} (at) {host}", True), (f"{name} [at] {host.replace('.', ' [dot] ')}", True), (f"{name}(at){host.replace('.', '(dot)')}", True), (f"{name}@", False), (f"@{name}", False)]
    if kind == "ip":
        return [(".".join(str(int(p) + 256) for p in s.split(".")), False), (s.rsplit(".", 1)[0], False)]
    return []


def secrets_otherwise(s: str) -> list[tuple[str, str, str, bool]]:
    """(before, form, after, true): secrets of other letters under other names, and what only looks like one."""
    digest = hashlib.sha256(s.encode())
    h, mixed = digest.hexdigest(), base64.urlsafe_b64encode(digest.digest()).decode()
    packed = re.sub("[^A-Za-z0-9]", "", mixed)
    d = re.sub("[^0-9]", "", h).ljust(14, "0")
    sizes = (h, h[:40], h[:32])
    out = [("api_key: ", f"sk-live-{packed[:20]}", "", True), ("secret=", packed[:24], " ", True), ('password = "', mixed[:28], '"', True), ("API key ", packed[:32], ", ", True), ("token: ", f"{packed[:4]}_{packed[4:30]}", "\n", True), ("'secret': '", h[:32], "'", True)]
    out += [(before, x, after, False) for k, (before, after) in enumerate((("commit ", " "), ("sha256:", ""), ("md5 = ", "\n"), ("https://a.org/b/", "/c"), ("hash ", "."), ("checksum: ", ""), ("see ", " for"), ("", "  file.txt"), ('"', '"'), ("revision ", ")"))) for x in (sizes[k % 3],)]
    return [*out, ("token ", f"20{d[:2]}-{d[2:4]}-{d[4:6]}T{d[6:8]}:{d[8:10]}:{d[10:12]}", " ", False), ("key ", f"part-{d[:2]}-of-the-whole", " ", False), ("see ", packed[:24], " ", False)]


def example(text: str, start: int, end: int, gold: list[tuple[str, int, int]]) -> list[tuple]:
    """Spans, features, number of atoms, and (candidate, kind) of the true spans of a region; nothing if a true span is no
    candidate, as it is longer than MAX_ATOMS or mere marks."""
    atoms = atoms_of(text, start, end, [e for _, a, b in gold for e in (a, b)])
    spans, x = candidates(text, atoms)
    place = {(atoms[i][0], atoms[j - 1][1]): k for k, (i, j) in enumerate(spans)}
    if not spans or not all((a, b) in place for _, a, b in gold):
        return []
    return [(spans, x, len(atoms), [(place[a, b], KINDS.index(kind)) for kind, a, b in gold])]


def examples(text: str, start: int, end: int, gold: list[tuple[str, int, int]]) -> list[tuple]:
    """What the field learns from a region: the region, then its entity written otherwise in its place."""
    out = example(text, start, end, gold)
    for kind, a, b in gold if len(gold) == 1 else ():
        for form, true in written_otherwise(kind, text[a:b]):
            new = text[:a] + form + text[b:]
            out += example(new, start, end + len(form) - (b - a), [(kind, a, a + len(form))] if true else [])
        for before, form, after, true in secrets_otherwise(text[a:b]) if kind == "secret" else ():
            at, new = len(before), before + form + after
            for x, y in regions(new):
                if x <= at and at + len(form) <= y:
                    out += example(new, x, y, [(kind, at, at + len(form))] if true else [])
    return out


def fit_spans(docs: DataFrame) -> SemiMarkov:
    """Learns from at most MAX_REGIONS regions of each kind, those with the lowest hashes among all documents' regions."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for text in batch.column(0).to_pylist():
                found = list(regions(text)) if text and (_DIGIT.search(text) or "@" in text) else ()
                base = base_spans(text) if found else []
                for a, b in found:
                    gold = gold_spans(text, a, b, base)
                    if gold or not _MAYBE.search(text, a, b):
                        a0 = max(0, a - 20)
                        label = min((KINDS.index(k) for k, _, _ in gold), default=-1)
                        rows.add((label, text[a0 : b + 1], a - a0, b - a0, ",".join(f"{k}:{x - a0}:{y - a0}" for k, x, y in gold)))
            rows = sorted((zlib.crc32(repr(r).encode()), *r) for r in rows)
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["h", "label", "text", "a", "b", "gold"])

    bound_batches(docs.sparkSession)
    key = ["h", "text", "a", "b", "gold"]
    rows = docs.select("text").mapInArrow(gather, "h long, label int, text string, a long, b long, gold string").dropDuplicates(["label", *key])
    first = Window.partitionBy("label").orderBy(*key)
    data = []
    for r in rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= MAX_REGIONS).orderBy("label", *key).collect():
        gold = [(k, int(a), int(b)) for k, a, b in (g.split(":") for g in r.gold.split(",") if g)]
        data += examples(r.text, r.a, r.b, gold)
    return SemiMarkov().fit([data[k] for k in np.random.default_rng(4).permutation(len(data))])


FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
_FOUND_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def all_spans(text: str, model: SemiMarkov) -> list[dict]:
    """Spans of the patterns and the model, by kind as listed and start."""
    base = base_spans(text)
    more = model_spans(text, model, base) if _DIGIT.search(text) or "@" in text or _AT.search(text) else []
    both = [(KINDS.index(k), a, b, True) for k, a, b in base] + [(KINDS.index(k), a, b, False) for k, a, b in more]
    return [{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in sorted(both)]


def find_personal_data(docs: DataFrame, spans: str = "spans") -> DataFrame:
    """docs with one more column: spans as (kind, start, end, base), by kind as listed and start, in code points.

    Null texts count as empty and have no spans; repeated rows get equal ones; an empty table gives an empty result. An
    input column of that name is replaced."""
    docs = docs.drop(spans)
    sent = share(docs.sparkSession, fit_spans(docs))
    schema = T.StructType([*docs.schema.fields, T.StructField(spans, FOUND)])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared(sent)
        for batch in batches:
            rows = [all_spans(x.as_py() or "", model) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _FOUND_ARROW)], names)

    return docs.mapInArrow(run, schema)


def masked(text: str, spans: list[dict]) -> str:
    """The text with each span replaced by its kind; spans that overlap become one, named after the first."""
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= done:
            out += [text[done : s["start"]], f"[{s['kind'].upper()}]"]
        done = max(done, s["end"])
    return "".join([*out, text[done:]])


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """docs with the spans in `text` replaced; n_chars follows, if there is such a column."""
    sent = share(docs.sparkSession, fit_spans(docs))
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared(sent)
        for batch in batches:
            texts, sizes = [], batch.column("n_chars").to_pylist() if "n_chars" in names else []
            for k, x in enumerate(batch.column("text")):
                text = x.as_py()
                spans = all_spans(text, model) if text else []
                texts.append(masked(text, spans) if spans else text)
                if spans and sizes:
                    sizes[k] = len(texts[k])
            columns = {c: batch.column(c) for c in names} | {"text": pa.array(texts, pa.string())}
            if sizes:
                columns["n_chars"] = pa.array(sizes, batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return docs.mapInArrow(run, schema)


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = find_personal_data(docs).drop("text")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, BASE_KINDS), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
