"""Vector codes against plain assignments, the bounds against all distances, and edge cases."""

import hashlib
import math

import numpy as np
import pytest

from tidemark.llm.codes import Codebooks, assigned_all, compress_vectors, reassigned


def plain(rows, parts, entries, rounds):
    """(id, code, error, label_error, sha) of (id, vector, label) rows, one number after the other."""
    kept = [(i, [math.floor(256 * c) for c in v], z) for i, v, z in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = [[r[1][p * w : (p + 1) * w] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda c, p: min(range(len(books[p])), key=lambda e: (dist(c[p], books[p][e]), e))
    for _ in range(rounds):
        codes = [[near(c, p) for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, k in zip(cut, codes, strict=True) if k[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    codes = [[near(c, p) for p in range(parts)] for c in cut]
    errors = [sum(dist(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, codes, strict=True)]
    sums = {}
    for r, e in zip(kept, errors, strict=True):
        sums[r[2]] = sums.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], bytes(k).hex(), e, sums[r[2]], sha) for r, k, e in zip(kept, codes, errors, strict=True)), key=str)


def test_bounds_lose_nothing():
    """Pruned assignments are those of all distances, ties to the lower index, after small and large moves."""
    rng = np.random.default_rng(3)
    for spread, shift in ((3, 1), (40, 3), (40, 60), (4000, 200)):
        x = rng.integers(-spread, spread + 1, (400, 4, 3))
        books = [Codebooks(rng.integers(-spread, spread + 1, (4, 16, 3)))]
        for _ in range(3):
            books.append(Codebooks(books[-1].entries + rng.integers(-shift, shift + 1, books[-1].entries.shape) * rng.integers(0, 2, (4, 16, 1))))
        codes, error, lower = assigned_all(x, books[0])
        least = x.size
        for old, new in zip(books, books[1:], strict=False):
            upper = np.sqrt(error.astype(np.float64)) * (1 + 1e-9)
            codes, error, lower, took = reassigned(x, codes, upper, lower, old, new)
            want, wanted, tight = assigned_all(x, new)
            assert (codes == want).all() and (error == wanted).all() and (lower <= tight).all()
            least = min(least, took)
        assert spread < 40 or shift > 3 or least < 400 * 4 * 16 / 2  # bounds leave most distances out


ROWS = [
    *((i, [math.sin(i * (k + 1) * 0.7) * 3 for k in range(8)], i % 3 if i % 4 else None) for i in range(60)),
    (60, None, 1), (61, [1.0, None, *[0.0] * 6], 1), (62, [float("nan")] * 8, 1), (63, [float("inf")] * 8, 0),
    (5, [0.5] * 8, 1), (5, [0.5] * 8, 1), (None, [0.25] * 8, 2), (None, [-0.25] * 8, None),
]


@pytest.mark.parametrize("entries, rounds", [(5, 2), (64, 3), (100, 0)])
def test_against_plain(spark, entries, rounds):
    rows = [(*r, "x", 1, 2) for r in ROWS]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string, error int, id int")
    got = compress_vectors(df.repartition(5), parts=4, entries=entries, rounds=rounds)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(ROWS, 4, entries, rounds)


def test_odd_lengths_and_empty(spark):
    df = spark.createDataFrame([(1, [], 0), (2, [1.0] * 3, 0), (3, [1.0] * 8, 0), (4, [2.0] * 4, 0), (5, [1e300] * 8, 0)], "vec_id long, embedding array<double>, label int")
    got = {r["id"]: r for r in compress_vectors(df, parts=4, entries=2).collect()}
    assert set(got) == {3, 5} and got[3]["code"] == "00000000" and got[5]["error"] == 0
    for none in (df.where("false"), df.where("vec_id = 2")):
        out = compress_vectors(none, parts=4)
        assert out.count() == 0 and out.columns == ["id", "code", "error", "label_error", "codebooks_sha256"]
