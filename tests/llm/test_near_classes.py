"""Classes of near copies are told apart by their rows, not by ids that may be null or repeated."""

from tidemark.llm.jaccard_join import keep_one_per_class

TEXTS = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}


def test_null_and_repeated_ids_over_different_texts(spark):
    rows = [(None, TEXTS["a"]), (None, TEXTS["b"]), (7, TEXTS["c"]), (7, TEXTS["d"]), (8, TEXTS["c"] + " end"), (None, TEXTS["b"] + " end"), (9, TEXTS["d"])]
    out = keep_one_per_class(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(rows[:4], key=str)
