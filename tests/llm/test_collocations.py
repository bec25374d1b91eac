"""Phrases against counts of a plain loop, shards and bit tables of any size, and edge cases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm.collocations import Frequent, collocations, frequent_bits, intervals, rooms, suffix_order


def plain(rows, words, least, first, inside):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    gone = {(lang, w[i : i + k]) for (lang, w), a in cand.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * a >= inside * f[lang, w[i : i + k]]}
    by = defaultdict(list)
    for (lang, w), a in cand.items():
        if (lang, w) not in gone:
            score, _, left, right = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            by[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, rows in by.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:first], 1)}


def test_suffixes():
    rng = np.random.default_rng(1)
    for most in (1, 2, 3, 5):
        ids = rng.integers(0, 4, 300).astype(np.int32)
        room = rooms(ids)
        assert room.tolist() == [next((j for j in range(300 - i) if ids[i + j] == 0), 300 - i) for i in range(300)]
        order, lcp = suffix_order(ids, room, most)
        heads = [tuple(ids[i : i + min(room[i], most)]) for i in order]
        assert heads == sorted(heads) and sorted(order) == list(range(300))
        for k in range(1, most + 1):
            want = Counter(tuple(ids[i : i + k]) for i in range(300) if room[i] >= k)
            at, n = intervals(order, lcp, room, k)
            assert {tuple(ids[i : i + k]): c for i, c in zip(at, n.tolist(), strict=True)} == want and len(at) == len(want)


def test_bits(spark):
    names = [f"näme {i}" for i in range(3000)]
    df = spark.createDataFrame([("en", p) for p in names[:1000]] + [("de", names[5])], "lang string, phrase string")
    for bits in (1 << 15, 1 << 22):
        got = frequent_bits(df, bits)
        assert isinstance(got, Frequent) and got.has([b"en " + p.encode() for p in names[:1000]]).all() and got.has([b"de " + names[5].encode()])[0]
        assert got.has([b"en " + p.encode() for p in names[1000:]]).mean() < (0.1 if bits < 1 << 20 else 0.01)


ROWS = [
    ("The big cat sat. The big cat ran, THE BIG dog\tran\nthe  big cat", "en"), ("the big cat sat; a b c d; a b c d!", "en"), (None, "en"), ("", None), (" \n .,;", "de"),
    ("the big cat sat", None), ("a b c d: a b c", "und"), ("x" * 30_000 + " a b " + "one two three four " * 3000, "fr"), ("ü é a b\x85c ü é a", "fr"), ("the big cat sat. The big cat ran", "en"),
]


@pytest.mark.parametrize("words, least, first, inside, size", [(3, 2, 2000, 50, 1 << 22), (3, 1, 4, 50, 40), (4, 2, 100, 80, 100), (2, 3, 100, 50, 1)])
def test_edges(spark, words, least, first, inside, size):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in ROWS * 2], "text string, lang string, a int, phrase string, n int").repartition(3)
    got = collocations(df, words=words, least=least, first=first, inside=inside, size=size, bits=1 << 15)
    assert {tuple(r) for r in got.collect()} == plain(ROWS * 2, words, least, first, inside)
    none = collocations(df.where("false"))
    assert none.count() == 0 and none.columns == got.columns


def test_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain([(r["text"], r["lang"]) for r in df.collect()], 3, 10, 2000, 50)
    assert {tuple(r) for r in collocations(df).collect()} == want and len(want) > 100
