"""Scoring looks at the places that a window repeats, but works out classes only where a token is scored."""

import numpy as np

from helixframe.llm import attention
from helixframe.llm.attention import CLASSES, OVERLAP, WINDOW, AttentionModel


def test_only_scored_places_are_worked_out(monkeypatch):
    rng = np.random.default_rng(2)
    end = 500
    texts = [rng.integers(0, end, k) for k in (0, 1, 46, 47, 48, 49, 79, 80, 81, 333, 900)]
    counts = np.bincount(np.concatenate([np.append(t, end) for t in texts]), minlength=end + 1)
    model = AttentionModel(counts, np.arange(end + 1) % 2 == 0, end)
    model.follows(rng.integers(0, 9, attention.KINDS * CLASSES)).fit(texts)
    places, attend = [], model._attend
    monkeypatch.setattr(model, "_attend", lambda x, *begin: places.append((WINDOW - sum(begin)) * len(x)) or attend(x, *begin))
    got = model.score(texts)
    later = sum(max(0, -(-(len(t) + 1 - WINDOW) // (WINDOW - OVERLAP))) for t in texts)
    assert sum(places) == WINDOW * len(texts) + (WINDOW - OVERLAP) * later
    # Every window whole, each token from the one window that scores it.
    for t, score in zip(texts, got, strict=True):
        row, want = np.append(t, end), 0.0
        ids = np.concatenate([[end], row, np.full(WINDOW, end)])
        for first in range(0, max(1, len(row) - OVERLAP), WINDOW - OVERLAP):
            logs = model.forward(ids[None, first : first + WINDOW])[0]
            for k in range(OVERLAP if first else 0, min(WINDOW, len(row) - first)):
                want += logs[k, model.classes[row[first + k]]] + model.within[row[first + k]]
        assert abs(score - want) <= 1e-5 * abs(want) + 1e-4
