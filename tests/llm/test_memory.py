"""What a worker holds."""

import tracemalloc

import numpy as np
import pyarrow as pa
from quillgraph.llm import ngram_join


def test_hashing_holds_little(monkeypatch):
    """Four MB of texts are hashed within 32 MB, and where they are cut for that changes nothing."""
    words = [" ".join(f"w{(k * 7919 + m * m) % 5000}" for m in range(500)) for k in range(1800)]
    texts = pa.array([*words, None, "", "one two"])
    monkeypatch.setattr(ngram_join, "_powers", {})
    tracemalloc.start()
    sizes = [len(s) for s in ngram_join.gram_sets(texts, 5)]
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sum(map(len, words)) > 4_000_000 and peak < 32 << 20
    assert sizes[-3:] == [0, 0, 1]
    small = list(ngram_join.gram_sets(texts[:40], 5))
    monkeypatch.setattr(ngram_join, "CHUNK", 5000)
    assert all(np.array_equal(a, b) for a, b in zip(small, ngram_join.gram_sets(texts[:40], 5), strict=True))
