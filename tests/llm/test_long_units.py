"""Texts with units that cannot be cut: stretches against whole lattices, and a run of half a million characters."""

import math
import resource
import time

import numpy as np
import pytest

from tidemark.llm import pieces
from tidemark.llm.queries import PIECES


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(PIECES)


def whole_log_p(vocabulary, text, ids):
    """The log-probability of a segmentation in the whole lattice, from backward sums of every position."""
    units = pieces.units_of(vocabulary, text, {})
    lattices = pieces.Lattices(vocabulary)
    total, k, ids = 0.0, 0, list(ids)
    for u in lattices.numbers([units])[0].tolist():
        at, last = int(lattices.first[u]), int(lattices.last[u])
        while at < last:
            for e in range(lattices.edge_at[at], lattices.edge_at[at + 1]):
                want = list(pieces._ids(lattices, np.array([at]), np.array([e])))
                if ids[k : k + len(want)] == want:
                    break
            else:
                raise AssertionError((at, ids[k : k + 4]))
            total += float(lattices.log_p[e])
            k += len(want)
            at += int(lattices.size[e])
    assert k == len(ids)
    return total


TEXTS = ["a rule: " + "-" * 90 + " and words behind", "=" * 33 + "é☃" + "_" * 50, "no run here at all", "-" * 70]


@pytest.mark.parametrize("stretch", [7, 64])
def test_stretches_are_the_lattice(vocabulary, monkeypatch, stretch):
    keys = np.arange(1, len(TEXTS) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    best = pieces.best_block(pieces.Lattices(vocabulary, search=True), TEXTS)
    monkeypatch.setattr(pieces, "LONG", 5)
    monkeypatch.setattr(pieces, "STRETCH", stretch)
    assert [x.tolist() for x in pieces.best_block(pieces.Lattices(vocabulary, search=True), TEXTS)] == [x.tolist() for x in best]
    got = pieces.sample_block(pieces.Lattices(vocabulary), TEXTS, keys, 4)
    monkeypatch.setattr(pieces, "LONG", 1 << 13)
    for text, samples in zip(TEXTS, got, strict=True):
        assert len({tuple(s[0]) for s in samples}) == len(samples) == 4
        for ids, log_p, score in samples:
            assert pieces.decode(vocabulary, ids) == text.encode() and 0 < score <= 1
            assert math.isclose(log_p, whole_log_p(vocabulary, text, ids), rel_tol=1e-5, abs_tol=1e-4)


def test_draws_follow_the_chances(vocabulary, monkeypatch):
    """First samples of many keys have the frequencies that the lattice gives them."""
    monkeypatch.setattr(pieces, "LONG", 2)
    text, n, seen = "-----", 3000, {}
    lattices = pieces.Lattices(vocabulary)
    for key in range(n):
        [[(ids, log_p, _)]] = pieces.sample_block(lattices, [text], np.array([key], np.uint64) * np.uint64(0xD1B54A32D192ED03), 1)
        seen.setdefault(tuple(ids), [0, log_p])[0] += 1
    for count, log_p in seen.values():
        p = math.exp(log_p)
        assert abs(count - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 1


def test_parts_of_long_units(vocabulary, monkeypatch):
    unit = "".join("▁the-----word====" + chr(0x4E00 + k % 7) for k in range(40))
    want = vocabulary.parts(unit)
    monkeypatch.setattr(pieces, "LONG", 16)
    assert vocabulary.parts(unit) == want and "".join(want) == unit and len(want) > 10


def test_half_a_million_hyphens(vocabulary):
    text = "words before " + "-" * 500_000 + " and behind"
    began, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    [samples] = pieces.sample_block(pieces.Lattices(vocabulary), [text], np.array([77], np.uint64), 2)
    assert len(samples) == 2 and all(pieces.decode(vocabulary, ids) == text.encode() for ids, _, _ in samples)
    assert samples[0][0].tolist() != samples[1][0].tolist()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # KB
    assert time.time() - began < 120
