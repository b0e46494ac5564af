"""Nodes that no beam reaches."""

import numpy as np

from sparkwright.llm import hnsw


def test_scan_after_failed_audit(monkeypatch):
    r = np.random.default_rng(5)
    x = r.normal(size=(40, 8))
    x = np.concatenate((x, x + r.normal(size=x.shape) * 1e-3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x)
    monkeypatch.setattr(g, "near", lambda q, least, beam: [np.zeros(0, np.int64)] * len(q))
    want = [np.flatnonzero(g.exact @ v >= 0.95).tolist() for v in x]
    assert min(map(len, want)) >= 2 and [f.tolist() for f in g.audited(x, 0.95, 0.98)] == want
