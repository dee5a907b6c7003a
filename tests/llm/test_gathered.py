"""The passes of the language model take the texts of a task side by side, whatever batches they come in."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from stepfree.llm import markov


def test_batches_are_gathered_before_texts_are_sorted(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [np.append(rng.integers(0, markov.END, n), markov.END).astype("<i2") for n in (0, 3, 5000, 40, 1, 2100, 7, 40)]
    batches = [pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["symbols"]) for x in texts]
    assert [len(p) for p in markov.gathered(iter(batches))] == [8]
    monkeypatch.setattr(markov, "GATHERED", 5000)
    parts = list(markov.gathered(iter(batches)))
    assert len(parts) == 2 and [b for p in parts for b in p] == batches
    emit = rng.uniform(0.5, 1.5, (markov.SYMBOLS, 3))
    move = rng.uniform(0.1, 1, (3, 3))
    model = markov.Hmm(np.full(3, 1 / 3), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    whole, single = markov.expected_counts(model, texts), sum(markov.expected_counts(model, [x]) for x in texts)
    assert np.allclose(whole, single, rtol=1e-4, atol=1e-4)
    # every text starts once, every symbol is emitted once, every step moves once
    sizes = np.array([len(x) for x in texts])
    assert np.allclose([whole[:3].sum(), whole[3:12].sum(), whole[12:].sum()], [len(texts), (sizes - 1).sum(), sizes.sum()], rtol=1e-4)
