"""The pipeline's stages on edge cases, and its rows against plain ones of every stage."""

import os
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline as cp
from tidemark.llm import toxicity
from tidemark.llm.queries import mix_sql

LONG = "lorem ipsum dolor sit amet " * 3000
ROWS = [
    (1, "one two three four five six seven", "en", "a"),
    (2, "one  two three\tfour five six seven", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (6, "One Two three four five six SEVEN", "en", "a"),
    (6, "One Two three four five six SEVEN", "en", "a"),
    (None, "a text without an id, of more than five words", "en", None),
    (None, "another text without an id, and other words in it", "en", "b"),
    (8, LONG, "en", "a"),
]

@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, i, 1.0, "x", True) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row int, seq double, copy string, kept boolean")


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stage_on_edges(spark, sf, odd, name, stage):
    """Nulls, empty and long texts, ties, repeated rows, and columns named as the stages name theirs."""
    out = stage(spark, odd, sf)
    got = out.collect()
    if name == "pieces":
        assert all(r["exact"] for r in got) and len({(r["doc_id"], tuple(r["ids"])) for r in got}) >= len(ROWS) + 4
    else:
        assert out.columns == odd.columns
        assert {tuple(r) for r in got} <= {tuple(r) for r in odd.collect()}
        if name == "exact_dedup":
            assert sorted(r["row"] for r in got if r["doc_id"] != 6) == [0, 2, 6, 7, 8] and len(got) == 6
        if name == "near_dedup":  # rows 3 and 4 of the list are blank: no shingles, no links
            assert sorted(r["row"] for r in got) == [0, 2, 3, 6, 7, 8]
    empty = stage(spark, odd.where("false"), sf)
    assert empty.count() == 0 and (name == "pieces" or empty.columns == odd.columns)


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def test_run_against_plain_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    evidence, score = model.scorer()
    left = sorted((tuple(r) for r in docs.collect() if score(evidence(r["text"] or "")) < 0.5), key=lambda r: r[0])
    first = {}
    for r in left:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    left = sorted(first.values())
    sets = [shingles(r[1]) for r in left]
    parent = list(range(len(left)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    left = [r for i, r in enumerate(left) if find(i) == i]
    con = duckdb.connect()
    con.sql("CREATE TABLE kept (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO kept VALUES (?, ?, ?, ?, ?)", left)
    want = Counter(r[0] for r in con.sql(f"SELECT doc_id FROM ({mix_sql('kept')})").fetchall())
    got = cp.run(spark, sf).collect()
    assert all(r["exact"] for r in got)
    assert Counter(r["doc_id"] for r in got if r["rank"] == 1) == want
    # of a repeated document, copies draw apart
    often = [d for d, n in want.items() if n > 1]
    texts = {r[0]: r[1] for r in left}
    drawn = {d: {tuple(r["ids"]) for r in got if r["doc_id"] == d and r["rank"] == 1} for d in often if len(texts[d]) > 200}
    assert drawn and all(len(v) == want[d] for d, v in drawn.items())


def test_names():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "pieces"] and all(f.__doc__ for _, f in cp.STAGES)
    assert os.path.exists(cp.PIECES)


def test_samples_do_not_follow_partitions(spark):
    """Copies of a document are told apart by their number, whatever partitions they stand in."""
    rows = [(i, f"the words of document number {i} are cut into pieces") for i in range(60)] * 3 + [(None, "no id here"), (None, "nor here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["rank"], tuple(r["ids"])) for r in cp.encode(spark, df, "").collect())
    one, many = ids(docs.repartition(1)), ids(docs.repartition(8))
    assert one == many and len({x[1:] for x in one if x[1] == 5}) > 2
