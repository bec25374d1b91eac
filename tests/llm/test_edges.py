"""Defined results on nulls, empty texts, repeats, long texts, empty tables and clashing columns."""

import hashlib

import pytest

from tidemark.llm import suffix_tree, toxicity
from tidemark.llm.chat_format import format_turns, json_turns, parsed, read_back, table_turns
from tidemark.llm.exact_dedup import exact_dedup, exact_groups
from tidemark.llm.jaccard_join import jaccard_classes, keep_one_per_class
from tidemark.llm.licenses import scan_licenses
from tidemark.llm.media import media_features
from tidemark.llm.mixing import mix_sources
from tidemark.llm.pieces import sample_segmentations
from tidemark.llm.queries import PIECES
from tidemark.llm.url_filter import Rule, filter_urls

#: Edge cases of every operator on documents: nulls, empty and blank texts, ties, repeated rows, a long text, clashing columns.
ROWS = [
    (1, "one two three four five six seven", "en", "a"),
    (2, "one  two three\tfour five six seven", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \n\t ", "en", "b"),
    (6, "One Two three four five six SEVEN", "en", "a"),
    (6, "One Two three four five six SEVEN", "en", "a"),
    (7, "short text", "en", "a"),
    (8, "x" * 50_000 + " ▁ \x00 é😀 " + "lorem ipsum dolor " * 4000, "en", "a"),
    (None, "a text without an id, of more than five words", "en", None),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(*r, i, 1.0, "x", "y", True) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, seq int, score double, id string, sha string, kept boolean")


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")


def test_exact(docs, nothing):
    got = exact_groups(docs).collect()
    assert len(got) == len(ROWS)
    kept = sorted((r["id"] is None, r["id"]) for r in got if r["kept"])
    assert [k[1] for k in kept] == [1, 3, 5, 6, 7, 8, None]
    assert {r["id"]: r["keep_id"] for r in got}[2] == 1 and {r["id"]: r["group_size"] for r in got}[4] == 2
    out = exact_dedup(docs)
    assert out.columns == docs.columns and out.count() == 7
    assert exact_groups(nothing).count() == 0


def test_jaccard(docs, nothing):
    got = {(r["id"], r["n_shingles"], r["component_id"]) for r in jaccard_classes(docs).collect()}
    assert {(1, 3, 1), (2, 3, 1), (6, 3, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (7, 1, 7)} <= got
    out = keep_one_per_class(docs)
    assert out.columns == docs.columns
    assert sorted((r[0] is None, r[0] or 0) for r in out.select("doc_id").collect()) == [(False, k) for k in (1, 3, 4, 5, 7, 8)] + [(True, 0)]
    assert jaccard_classes(nothing).count() == 0


def test_mixing(docs, nothing):
    out = mix_sources(docs, total=40)
    assert out.columns == [*docs.columns, "copy", "shuffle_key"]
    assert mix_sources(nothing).count() == 0
    assert mix_sources(docs, weights={"a": 1.0, "b": 0.0}, total=30).where("source = 'b'").count() == 0


def test_media(docs, nothing):
    got = {r["doc_id"]: r for r in media_features(docs).collect()}
    assert got[3]["payload_bytes"] == got[4]["payload_bytes"] == 64 and got[3]["feature"] == got[4]["feature"]
    assert media_features(nothing).count() == 0


def test_licenses(docs, nothing):
    assert all(r["licenses"] == [] for r in scan_licenses(docs).collect())
    assert scan_licenses(nothing).count() == 0


def test_pieces(docs, nothing):
    got = sample_segmentations(docs, PIECES, k=2).collect()
    assert all(r["exact"] for r in got)
    assert sum(r["doc_id"] == 3 for r in got) == 1 and sum(r["doc_id"] == 1 for r in got) == 2
    assert sample_segmentations(nothing, PIECES).count() == 0


def test_toxicity(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 0), (7, 1), (None, 1), (8, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.reject_toxic(docs, model).columns == docs.columns
    assert toxicity.score_documents(nothing, toxicity.fit(nothing, labels)).count() == 0


def test_suffix_tree(docs, nothing):
    got = suffix_tree.score_documents(docs).collect()
    assert len(got) == len(ROWS)
    assert all(r["n_tokens"] == 1 for r in got if r["id"] in (3, 4, 5))
    assert suffix_tree.score_documents(nothing).count() == 0


@pytest.mark.parametrize("op", [media_features, scan_licenses])
def test_repeated_rows(docs, op):
    assert op(docs).count() == len(ROWS)


#: URL, and whether a rule without a host, with a star in its host, and with a host alone fits it.
URLS = [("http://a.net/ads/1", 1, 0, 0), ("http://a.net/x", 0, 0, 0), ("http://t.bad.org/", 0, 1, 0), ("http://bad.org/", 0, 0, 0), ("http://x.only.com", 0, 0, 1), (None, 0, 0, 0), ("no scheme/ads", 0, 0, 0), ("http:///ads", 1, 0, 0), ("http://a.net/" + "p/" * 50_000 + "ads", 0, 0, 0)]


def test_urls_without_literal_tokens(spark):
    rows = [(i, u, "s", "h", "p", "t") for i, (u, *_) in enumerate(URLS)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, seq string, host string, path string, token string")
    for k, rule in enumerate([Rule("block", "/ads"), Rule("block", "*.bad.org/"), Rule("block", "only.com")], 1):
        got = [(r["page_id"], r["verdict"] == "block") for r in filter_urls(df, [rule, Rule("allow", "net/zzz/")]).collect()]
        assert sorted(got) == sorted((i, bool(u[k])) for i, u in enumerate(URLS) for _ in (0, 1))
    assert filter_urls(df.where("false"), [Rule("block", "/ads")]).count() == 0
    assert {r["verdict"] for r in filter_urls(df, []).collect()} == {"allow"}
    # a rule for everything still fits no URL that has neither host nor path
    assert sum(r["verdict"] == "block" for r in filter_urls(df, [Rule("block", "*")]).collect()) == 2 * 7


RECORDS = [
    ('{"prompt": "a", "completion": null}', "prompt_completion", [("user", "a"), ("assistant", "")]),
    ('{"instruction": "i", "input": null, "output": "o"}', "instruction", [("user", "i"), ("assistant", "o")]),
    ('{"messages": []}', "messages", []),
    ('{"conversations": []}', "conversations", []),
    ('{"prompt": "stray", "messages": [{"role": "user", "content": "m"}, 7]}', "messages", [("user", "m")]),
    ('{"messages": [{"role": null, "content": null}]}', "messages", [("", "")]),
    ('{"system": null, "prompt": "p", "response": "r"}', "prompt_response", [("user", "p"), ("assistant", "r")]),
    ('{"question": "q", "answer": "a", "text": "t"}', "question_answer", [("user", "q"), ("assistant", "a")]),
    ("[1]", None, None),
    ("", None, None),
    (None, None, None),
]


def test_chat_records(spark):
    df = spark.createDataFrame([(i, r[0], "x") for i, r in enumerate(RECORDS)] * 2, "conv_id long, record string, layout string")
    turns = json_turns(df, "conv_id", "record")
    got = {r["conv_id"]: (r["layout"], r["turns"] if r["turns"] is None else [tuple(t) for t in r["turns"]]) for r in turns.collect()}
    assert got == {i: r[1:] for i, r in enumerate(RECORDS)}
    text = {r["conv_id"]: r["formatted"] for r in format_turns(turns).collect()}
    assert all(text[i] is None if r[2] is None else parsed(text[i]) == r[2] for i, r in enumerate(RECORDS))
    back = read_back(format_turns(turns)).collect()
    assert len(back) == 2 * len(RECORDS) and {r["n_turns"] for r in back if r["conv_id"] == 2} == {0} and all(r["n_turns"] is None for r in back if r["conv_id"] > 7)
    assert read_back(format_turns(json_turns(df.where("false"), "conv_id", "record"))).count() == 0


def test_chat_rows(spark):
    """Null roles and texts, ties of turn numbers, repeated rows, clashing columns, a long text, an empty table."""
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, None, None), (2, 1, "assistant", "<s>" * 30_000), (2, 0, "user", "\\l[INST]"), (2, 0, "user", "\\l[INST]")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn int, role string, text string, layout string, turns string")
    turns = table_turns(df)
    got = {r["conv_id"]: parsed(r["formatted"]) for r in format_turns(turns).collect()}
    assert got == {1: [("", ""), ("user", "a"), ("user", "b")], 2: [("user", "\\l[INST]")] * 2 + [("assistant", "<s>" * 30_000)]}
    back = {r["conv_id"]: r for r in read_back(format_turns(turns)).collect()}
    assert back[2]["loss_sha256"] == hashlib.sha256(("<s>" * 30_000).encode()).hexdigest() and back[1]["loss_chars"] == 0
    assert table_turns(df.where("false")).count() == 0
