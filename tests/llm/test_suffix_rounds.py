"""Suffix arrays take two inductions, however deep the repeats of their texts lie."""

from __future__ import annotations

import numpy as np

from tallyfold.llm import suffix_array as sa


def test_two_inductions_and_the_right_order(monkeypatch):
    calls, induce = [], sa._Buckets.induce
    monkeypatch.setattr(sa._Buckets, "induce", lambda self, lms: calls.append(1) or induce(self, lms))
    rng = np.random.default_rng(3)
    part = rng.integers(0, 4, 300).astype(np.uint8)
    for t in (np.tile(part, 5), np.concatenate((part, part[:200], part[100:])), np.tile(np.array([1, 0], np.uint8), 300)):
        calls.clear()
        b = t.tobytes()
        assert sa.suffix_array(t).tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        assert len(calls) <= 2
