"""A small causal attention model over subword ids, in numpy.

The next subword is predicted in two steps: its class, then the subword from its class by counts. The class's scores
are those of counted pairs (kind of the token, class of the next), to which one head of causal attention over the
window adds what it has learned. A token's kind is a finer class. The attention reads a vector for each kind, which comes
from the counted pairs too: kinds that lead to like classes lie near each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Classes that are predicted, kinds that are read, and how many of each are single frequent ids; others share by hash.
CLASSES, FREQUENT, KINDS, FREQUENT_KINDS, DIMS = 64, 48, 1024, 768, 16
#: Tokens of a window, and how many of them repeat the window before as context.
WINDOW, OVERLAP = 48, 16
#: Windows scored at once, and the least number of training steps, with so many windows each.
BATCH, STEPS, STEP_WINDOWS = 64, 300, 48
#: Pairs are counted as if each kind had come before this many more tokens, spread as all tokens are.
PRIOR = 20.0


def shared_classes(counts: np.ndarray, spaced: np.ndarray, end: int, many: int, frequent: int) -> np.ndarray:
    """Class of each id: the end and the most frequent ids have their own, others share by whether a space begins them."""
    ids = np.arange(len(counts), dtype=np.int64)
    share = (many - frequent) // 2
    out = frequent + share * spaced.astype(np.int64) + (ids * 2654435761 % 2**32 >> 16) % share
    top = np.lexsort((ids, -counts))
    top = top[top != end][: frequent - 1]
    out[end], out[top] = 0, 1 + np.arange(len(top))
    return out


def windows_of(n: np.ndarray, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of n tokens each: (text, first token, first token to score) of every window. Each token is scored once."""
    step = WINDOW - overlap
    many = 1 + np.maximum(-(-(n - WINDOW) // step), 0)
    text = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return text, k * step, np.where(k > 0, k * step + overlap, 0)


def keep_freed_memory() -> None:
    """Freeing one large block makes the allocator keep smaller ones for the next arrays, rather than give them back to
    the system and fetch them again in each step."""
    np.empty(31 << 20, np.uint8)


class AttentionModel:
    def __init__(self, counts: np.ndarray, spaced: np.ndarray, end: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.end, self.tokens = end, int(counts.sum())
        self.classes = shared_classes(counts, spaced, end, CLASSES, FREQUENT)
        self.kinds = shared_classes(counts, spaced, end, KINDS, FREQUENT_KINDS)
        size, total = np.bincount(self.classes, minlength=CLASSES), np.bincount(self.classes, counts, CLASSES)
        self.within = np.log((counts + 1.0) / (total + size)[self.classes]).astype(np.float32)
        self.share = np.maximum((total + size) / (total + size).sum(), 1e-9)  # a class may have no id
        self.follow = np.tile(np.log(self.share), (KINDS, 1)).astype(np.float32)
        d = DIMS
        self.vectors = rng.normal(0, 0.5, (KINDS, d)).astype(np.float32)
        shape = {"place": (WINDOW, d), "q": (d, d), "k": (d, d), "v": (d, d), "o": (d, d), "out": (d, CLASSES)}
        self.p = {n: (rng.normal(0, 0.3 if n == "place" else 0.05 if n == "out" else s[0] ** -0.5, s)).astype(np.float32) for n, s in shape.items()}
        self.steep = self.far = True
        self.mask = np.tril(np.ones((WINDOW, WINDOW), np.float32))

    def follows(self, pairs: np.ndarray) -> AttentionModel:
        """Takes over how often each class came next after each kind. Vectors of kinds are the main directions in which
        their classes differ from the whole, beside a random part that tells kinds apart."""
        pairs = pairs.reshape(KINDS, CLASSES) + PRIOR * self.share
        self.follow = np.log(pairs / pairs.sum(1, keepdims=True)).astype(np.float32)
        u, s, _ = np.linalg.svd(self.follow - np.log(self.share), full_matrices=False)
        main = (u * s)[:, : DIMS * 3 // 4]
        self.vectors[:, : main.shape[1]] = 0.5 * main / np.maximum(main.std(0), 1e-6)
        return self

    def measure(self) -> None:
        """Bounds on the products of queries and keys, and on the scores of classes, tell whether any could come near what
        exponentials can hold."""
        p, most = self.p, lambda m: float(np.abs(m).max())
        longest = lambda w: float(np.sqrt(((self.vectors @ w) ** 2).sum(1).max()) + np.sqrt(((p["place"] @ w) ** 2).sum(1).max()))
        self.steep = longest(p["q"]) * longest(p["k"]) * DIMS**-0.5 > 40
        mean = most(self.vectors @ p["v"]) + most(p["place"] @ p["v"])
        self.far = most(self.vectors @ p["out"] + self.follow) + mean * float(np.abs(p["o"] @ p["out"]).sum(0).max()) > 40

    def _attend(self, x: np.ndarray, begin: int = 0):
        """What each place from `begin` on takes from those up to it: queries, keys, values with a one, weights, their sums,
        the mean."""
        flat, scale = x.reshape(-1, DIMS), x.dtype.type(DIMS**-0.5)
        own = x[:, begin:]
        q = (own.reshape(-1, DIMS) @ (self.p["q"] * scale)).reshape(own.shape)
        k = np.ascontiguousarray((flat @ self.p["k"]).reshape(x.shape).transpose(0, 2, 1))
        v = np.empty((*x.shape[:2], DIMS + 1), x.dtype)
        v[..., :DIMS] = (flat @ self.p["v"]).reshape(x.shape)
        v[..., DIMS] = 1
        a = q @ k
        if self.steep:
            np.clip(a, -60, 60, out=a)  # within what exponentials can hold
        np.exp(a, out=a)
        a *= self.mask[begin:]
        s = a @ v
        return q, k, v, a, s[..., DIMS:], s[..., :DIMS] / s[..., DIMS:]

    def _forward(self, c: np.ndarray):
        """Scores of the next class (flat, one row a token) after each kind in windows (n, WINDOW), their exponentials and
        the sums of those, and what led to them."""
        p = self.p
        kind = self.vectors.take(c, 0)
        x = kind + p["place"]
        parts = self._attend(x)
        h = kind.reshape(-1, DIMS) + parts[-1].reshape(-1, DIMS) @ p["o"]
        logits = h @ p["out"]
        logits += self.follow.take(c.ravel(), 0)
        if self.far:
            np.clip(logits, -60, 60, out=logits)
        e = np.exp(logits)
        return logits, e, e @ np.ones(CLASSES, e.dtype), (x, *parts, h)

    def forward(self, ids: np.ndarray) -> np.ndarray:
        """Log probabilities of the next class after each of the ids in windows (n, WINDOW)."""
        self.measure()
        logits, _, total, _ = self._forward(self.kinds[ids])
        return (logits - np.log(total)[:, None]).reshape(*ids.shape, CLASSES)

    def gradients(self, c: np.ndarray, t: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the real tokens, and its gradient, for windows of kinds and of the classes that came next."""
        p = self.p
        logits, d, total, (x, q, k, v, a, z, o, h) = self._forward(c)
        n, t, flat = max(int(real.sum()), 1), t.ravel(), lambda m: m.reshape(-1, m.shape[-1])
        rows, weight = np.arange(len(t)), (real / n).ravel().astype(x.dtype)
        loss = float((np.log(total) - logits[rows, t]) @ weight)
        d *= (weight / total)[:, None]
        d[rows, t] -= weight
        g = {"out": h.T @ d}
        dh = d @ p["out"].T
        g["o"] = flat(o).T @ dh
        do = np.empty(v.shape, x.dtype)
        np.divide((dh @ p["o"].T).reshape(o.shape), z, out=do[..., :DIMS])
        do[..., DIMS] = -np.einsum("bid,bid->bi", do[..., :DIMS], o)
        dv = flat(a.transpose(0, 2, 1) @ do[..., :DIMS])
        ds = do @ v.transpose(0, 2, 1)
        ds *= a
        dq, dk = flat(ds @ k.transpose(0, 2, 1)), flat(ds.transpose(0, 2, 1) @ q)
        dq *= x.dtype.type(DIMS**-0.5)
        dx = np.zeros_like(p["place"])
        for name, d in (("q", dq), ("k", dk), ("v", dv)):
            g[name] = flat(x).T @ d
            dx += d.reshape(x.shape).sum(0) @ p[name].T
        g["place"] = dx
        return loss, g

    def batches(self, texts: list[np.ndarray], size: int, overlap: int = OVERLAP) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, ids, targets, real) for windows over texts; each text begins and ends with the end token."""
        n = np.array([len(t) + 1 for t in texts], np.int64)
        if not len(n):
            return
        flat = np.concatenate([x for t in texts for x in ([self.end], t)] + [np.full(WINDOW + 1, self.end)]).astype(np.int32)
        begin = np.cumsum(n) - n
        text, first, scored = windows_of(n, overlap)
        if overlap:  # windows that begin a text come first, side by side, so that the others' batches have no such
            by = np.argsort(first > 0, kind="stable")
            text, first, scored = text[by], first[by], scored[by]
            edge = int((first == 0).sum())
            starts = [*range(0, edge, size), *range(edge, len(text), size)]
        else:
            edge, starts = 0, range(0, len(text), size)
        for a in starts:
            to = min(a + size, edge) if a < edge else a + size
            own = text[a:to]
            at = first[a:to, None] + np.arange(WINDOW + 1)
            run = flat[begin[own][:, None] + np.minimum(at, n[own][:, None])]
            yield own, run[:, :-1], run[:, 1:], (at[:, :-1] < n[own][:, None]) & (at[:, :-1] >= scored[a:to, None])

    def fit(self, texts: list[np.ndarray], rounds: int = 1) -> AttentionModel:
        """Steps over all tokens of the texts, in windows side by side, each as often as any other: once, or more where
        all `rounds` together would have under STEPS steps."""
        keep_freed_memory()
        rng = np.random.default_rng(2)
        data = list(self.batches(texts, 1 << 30, 0))
        if not data:
            return self
        _, ids, targets, real = data[0]
        c, t = self.kinds[ids].astype(np.uint16), self.classes[targets].astype(np.uint16)
        # The weights are views of one vector, which a step changes as a whole.
        whole, at = np.concatenate([w.ravel() for w in self.p.values()]), 0
        for name, w in self.p.items():
            self.p[name] = whole[at : at + w.size].reshape(w.shape)
            at += w.size
        m, v = np.zeros_like(whole), np.zeros_like(whole)
        passes = max(1, -(-STEPS * STEP_WINDOWS // (rounds * len(ids))))
        order = np.concatenate([rng.permutation(len(ids)) for _ in range(passes)])
        for step, at in enumerate(range(0, len(order), STEP_WINDOWS), 1):
            if step % 8 == 1:  # a step moves each weight by about a hundredth
                self.measure()
            pick = order[at : at + STEP_WINDOWS]
            _, g = self.gradients(c[pick], t[pick], real[pick])
            d = np.concatenate([g[name].ravel() for name in self.p])
            m = 0.9 * m + 0.1 * d
            v = 0.99 * v + 0.01 * d * d
            whole -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each text, its end included."""
        keep_freed_memory()
        out, p = np.zeros(len(texts)), self.p
        seen, mixed = self.vectors @ p["out"] + self.follow, p["o"] @ p["out"]  # without and by attention
        ones = np.ones(CLASSES, np.float32)
        self.measure()
        for own, ids, targets, real in self.batches(texts, BATCH):
            c = self.kinds.take(ids)
            x = self.vectors.take(c, 0)
            x += p["place"]
            # Where no window begins a text, the places that repeat the window before are only looked at.
            begin = 0 if real[:, 0].any() else OVERLAP
            c, targets, real = c[:, begin:], targets[:, begin:], real[:, begin:]
            t = self.classes.take(targets).ravel()
            flat = self._attend(x, begin)[-1].reshape(-1, DIMS) @ mixed
            flat += seen.take(c.ravel(), 0)
            if self.far:
                np.clip(flat, -60, 60, out=flat)
            logs = flat[np.arange(len(t)), t] + self.within.take(targets.ravel())
            logs -= np.log(np.exp(flat, out=flat) @ ones)
            np.add.at(out, own, (logs.reshape(real.shape) * real).sum(1, dtype=np.float64))
        return out
