"""n_links of the Jaccard join against brute force over all pairs of different sets."""

import numpy as np
import pytest

from tidemark.llm import jaccard_join


def shingles(text):
    w = text.split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def near_copies():
    """Two groups of near copies with equal ones among them, chains whose ends do not link, and strangers."""
    rng = np.random.default_rng(11)
    texts = []
    for g in "pq":
        base = [f"{g}{k}" for k in range(150)]
        for i in range(60):
            w = list(base)
            for p in rng.integers(0, 150, i % 5):
                w[p] = f"x{rng.integers(1e9)}"
            texts += [" ".join(w)] * (1 + (i % 7 == 0))
    for k in range(0, 60, 3):
        texts.append(" ".join(f"c{i}" for i in range(k, k + 100)))
    return texts + [" ".join(f"s{j}-{i}" for i in range(30)) for j in range(10)]


@pytest.mark.parametrize("chunk", [512, 20])
def test_every_link_is_counted(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard_join, "CLASS_SETS", chunk, raising=False)
    texts = near_copies()
    sets = [shingles(t) for t in texts]
    want = {}
    for i, a in enumerate(sets):
        want[i] = sum(100 * len(a & b) >= 80 * len(a | b) for b in set(sets) - {a})
    got = {r["id"]: r["n_links"] for r in jaccard_join.jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want
