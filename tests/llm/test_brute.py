"""Operators against brute force, exact round trips and held-out accuracy on the small tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import queries as q
from tidemark.llm.common import mix64
from tidemark.llm.exact_dedup import exact_groups
from tidemark.llm.jaccard_join import jaccard_classes
from tidemark.llm.licenses import TEMPLATES, Scanner
from tidemark.llm.media import from_wav, pad, to_wav
from tidemark.llm.pieces import Lattices, best_block, decode, decode_ids, encode_texts, load, sample_block
from tidemark.llm.url_filter import Rule, filter_urls


def rows(spark, sf, name, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*cols).collect()]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(sets):
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            where[s].append(i)
    pairs = Counter()
    for v in where.values():
        for a in range(len(v)):
            for b in range(a):
                pairs[v[b], v[a]] += 1
    for (a, b), n in pairs.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in ids}


def test_jaccard_classes(spark, sf):
    texts = rows(spark, sf, "documents", "doc_id", "text")
    sets = {i: shingles(t) for i, t in texts}
    want = components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in q.op10_jaccard_join(spark, sf).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_dense_group(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for i in range(300):
        w = list(base)
        for p in rng.integers(0, 120, i % 4):
            w[p] = f"x{rng.integers(1e9)}"
        texts.append((i, " ".join(w) + (" tail" * (i % 3))))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = components({i: shingles(t) for i, t in texts})
    assert {r["id"]: r["component_id"] for r in jaccard_classes(df).collect()} == want


def test_exact_groups(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    df = df.union(df.withColumn("doc_id", df.doc_id + 1000))
    groups = defaultdict(list)
    import re

    for i, t in [tuple(r) for r in df.select("doc_id", "text").collect()]:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"], r["sha"]) for r in exact_groups(df).collect()}
    assert got == {i: (min(v), len(v), i == min(v), hashlib.sha256(t.encode()).hexdigest()) for t, v in groups.items() for i in v}


@pytest.mark.parametrize("url", ["http://a.org/x", "http://org/", "https://EXAMPLE.org/es/1", "http://b.example.org/en/12?x", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/de/#a", "nothing", None, "http://", "http://.org/", "http://notorg/", "a://q.com?x/y/de/"])
def test_url_rules(spark, url):
    got = filter_urls(spark.createDataFrame([(1, url)], "page_id long, url string"), q.URL_RULES).collect()[0]
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.partition(c)[0]
    path = rest[len(host) :].partition("?")[0].partition("#")[0]
    host = host.lower()
    fits = [r for r in q.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.pattern)) if fits else Rule("allow", None)
    assert (got["host"], got["path"], got["rule"], got["verdict"]) == (host, path, best.pattern, best.action)


def test_wildcard_rule(spark):
    df = spark.createDataFrame([(1, "http://a.net/x/track/y"), (2, "http://a.net/x/y")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in filter_urls(df, [Rule("block", "net/*/track/")]).collect()}
    assert got == {1: "block", 2: "allow"}


def test_chat(spark, sf):
    turns = defaultdict(list)
    for c, t, r, x in rows(spark, sf, "conversations", "conv_id", "turn", "role", "text"):
        turns[c].append((t, r or "", x or ""))
    turns[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for c, v in turns.items():
        v.sort()
        loss = "".join(x for _, r, x in v if r == "assistant")
        want[c] = (len(v), sha("".join(f"{r}\n{x}\n" for _, r, x in v)), len(loss), sha(loss))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in q.op2_chat_format(spark, sf).collect()}
    assert got == want


def test_chat_layouts(spark):
    from tidemark.llm.chat_format import format_turns, json_turns, parsed

    records = [
        (1, '{"prompt": "<|turn|>a\\\\b", "completion": "c"}'),
        (2, '{"instruction": "i", "input": "x", "output": "o"}'),
        (3, '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": null}]}'),
        (4, '{"question": "q", "answer": "a", "extra": 1}'),
        (5, "not json"),
        (6, '{"unknown": 1}'),
        (7, None),
    ]
    turns = json_turns(spark.createDataFrame(records, "conv_id long, record string"), "conv_id", "record")
    got = {r["conv_id"]: r["formatted"] for r in format_turns(turns).collect()}
    assert parsed(got[1]) == [("user", "<|turn|>a\\b"), ("assistant", "c")]
    assert parsed(got[2]) == [("user", "i"), ("user", "x"), ("assistant", "o")]
    assert parsed(got[4]) == [("user", "q"), ("assistant", "a")]
    assert got[5] is got[6] is got[7] is None


def test_media(spark, sf):
    texts = dict(rows(spark, sf, "documents", "doc_id", "text"))
    for r in q.op7_media(spark, sf).collect():
        data = texts[r["doc_id"]].encode()
        p = pad(data)
        assert len(p) % 64 == 0 and from_wav(to_wav(p)) == p
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r["media_bytes"] == len(to_wav(p)) and len(r["fp_time"]) == len(r["fp_code"])


def test_licenses(spark, sf):
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    texts = dict(rows(spark, sf, "documents", "doc_id", "text"))
    for r in q.op8_licenses(spark, sf).collect():
        want = sorted({v for k, v in lines.items() if k in texts[r["doc_id"]]})
        assert r["licenses"] == want, texts[r["doc_id"]][-300:]


def test_license_wording():
    scan = Scanner()
    for name, statements in TEMPLATES.items():
        for s in statements:
            assert name in {f["license"] for f in scan.scan(("Some words before.\n" + s + "\nand after").encode())}
    assert [f["license"] for f in scan.scan(b"Licensed under the Apache License, Version 1.1.")] == []


def test_suffix_tree(spark, sf):
    texts = rows(spark, sf, "documents", "doc_id", "text")
    fold = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: [*t.encode().lower().split(), None] for i, t in texts}
    c = Counter(w for i, v in tokens.items() if not fold(i) for w in v)
    total, whole = sum(c.values()), sum(c.values()) + len(c) + 1
    gain = 0.0
    for r in q.op6_lm_scoring(spark, sf).collect():
        v = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(r["doc_id"]), len(v), sum(c[w] > 0 for w in v), total)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / whole) for w in v), rel_tol=1e-9)
        gain += (r["score"] - r["base_score"]) * r["held_out"]
    assert gain > 0


def plain_tree(train, docs, st):
    """Scores by dictionaries: contexts are tuples of words, oldest first; None is the end, "?" a word that is no symbol."""
    c = Counter(w for d in train for w in d)
    total, whole = sum(c.values()), sum(c.values()) + len(c) + 1
    least = st.Least.of(total)
    deepest = max(map(len, docs)) + 1
    symbols = {w for w, n in c.items() if n >= least.symbol or w is None}
    root = {w: (c[w] + 1) / whole for w in symbols}
    root["?"] = max(1 - sum(root.values()), 1e-12)
    marked = lambda d: [None, *(w if w in symbols else "?" for w in d)]
    counts = defaultdict(Counter)
    for d in map(marked, train):
        for i in range(1, len(d)):
            for k in range(1, min(i, deepest) + 1):
                counts[tuple(d[i - k : i])][d[i]] += 1
    live, states = set(), {}

    def chance(context, w):
        p = root[w]
        for k in range(1, len(context) + 1):
            x = tuple(context[len(context) - k :])
            if x in states:
                size, kept, rest = states[x]
                p = (kept.get(w, 0) + (st.PRIOR + rest) * p) / (size + st.PRIOR)
        return p

    for k in range(1, min(deepest, st.DEPTH) + 1):
        if k == 1:
            now = {x for x in counts if len(x) == 1 and x != ("?",)}
        else:
            now = {x for x in counts if len(x) == k and x[:-1] in live and x[1:] in states and x[-1] not in ("?", None) and counts[x[:-1]][x[-1]] >= max(least.context, least.entry)}
        live |= now
        for x in now:
            size = sum(counts[x].values())
            kept = {w: n for w, n in counts[x].items() if n >= least.entry}
            rest = size - sum(kept.values())
            q = {w: chance(x[1:], w) for w in kept}
            gain = sum(n * math.log(n / size / q[w]) for w, n in kept.items())
            if rest > 0 and (left := 1 - sum(q.values())) > 0:
                gain += rest * math.log(rest / size / left)
            if size >= least.context and gain > 0.5 * (len(kept) + 1) * math.log(max(size, 2)):
                states[x] = (size, kept, rest)
    out = []
    for d in docs:
        m, score = marked(d), 0.0
        for i in range(1, len(m)):
            k = max((k for k in range(1, min(i, deepest) + 1) if tuple(m[i - k : i]) in live and all(tuple(m[i - j : i]) in live for j in range(1, k + 1))), default=0)
            score += math.log10((c[d[i - 1]] + 1) / whole) + math.log10(chance(m[i - k : i], m[i]) / root[m[i]])
        out.append(score)
    return out, states


@pytest.mark.parametrize("least", [1e-6, 0.2])
def test_suffix_tree_scores_are_those_of_plain_counts(spark, monkeypatch, least):
    """Phrases of several lengths, so that long contexts pass the test; with and without entries left out."""
    from tidemark.llm import suffix_tree as st

    monkeypatch.setattr(st, "ENTRY", least)
    rng = np.random.default_rng(8)
    phrases = ["a b c d e", "x b c y", "a b z", "q a b c r", "b c", "e e e"]
    docs = [" ".join(phrases[int(k)] if k < len(phrases) else f"rare{k}" for k in rng.integers(0, 9, rng.integers(1, 12))) for _ in range(400)] + ["", "a", "never seen b c"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    fold = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [[*d.split(), None] for d in docs]
    want, states = plain_tree([t for i, t in enumerate(tokens) if not fold(i)], tokens, st)
    assert max(map(len, states)) >= 3
    got = {r["id"]: r["score"] for r in st.score_documents(df).collect()}
    for i, w in enumerate(want):
        assert math.isclose(got[i], w, rel_tol=1e-9, abs_tol=1e-9), (i, docs[i])


def test_suffix_tree_grows_with_the_corpus(spark, sf):
    """Of more text the tree keeps more symbols, contexts and entries."""
    from tidemark.llm import suffix_tree as st

    texts = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "cast(text as binary) as text")
    found = []
    for part in (texts.where("doc_id % 4 = 0"), texts, spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("cast(text as binary) as text")):
        tree, _ = st.fit(part.select("text"))
        found.append((tree.total, tree.other, sum(len(x.size) for x in tree.levels), sum(len(x.entries) for x in tree.levels)))
    assert all(a < b for one, two in zip(found, found[1:]) for a, b in zip(one, two)), found
    assert st.Least.of(10**8).context == 2000 and st.Least.of(4 * 10**8).context == 4000


def test_suffix_tree_sums_to_one(spark):
    """In every state of a small tree the probabilities of all words and of the unknown rest sum to one."""
    from tidemark.llm import suffix_tree as st

    texts = spark.createDataFrame([(f"{a} b c {a} d " * 40,) for a in "axyz"], "text string").selectExpr("cast(text as binary) as text")
    tree, _ = st.fit(texts)
    assert len(tree.levels) > 2 and all((level.size > 0).any() for level in tree.levels[:2])
    every = np.arange(tree.other + 1)
    for n, level in enumerate(tree.levels):
        for context in np.flatnonzero(level.size > 0):
            at = np.full(len(every), context)
            p = tree.mixed(n, at, every, tree.suffix_chances(n, at, every))
            assert math.isclose(p.sum(), 1, rel_tol=1e-9)


def segmentations(vocabulary, unit):
    """Every segmentation of a unit, as ids, with its weight: pieces by rank, bytes where a character has no piece."""
    pieces = {unit_text.replace(" ", "▁"): i for i, unit_text in enumerate(contents(vocabulary)) if unit_text}
    least = min(i for i in pieces.values() if i not in set(vocabulary.byte_ids))

    def rest(at):
        if at == len(unit):
            yield (), 1.0
        for k in range(1, min(vocabulary.longest, len(unit) - at) + 1):
            i = pieces.get(unit[at : at + k])
            if i is not None and i not in set(vocabulary.byte_ids.tolist()):
                head, w = (i,), 1 / (i - least + 10.0)
            elif k == 1:
                raw = unit[at].encode()
                head, w = tuple(vocabulary.byte_ids[b] for b in raw), (1 / (len(vocabulary.width) + 10.0)) ** len(raw)
            else:
                continue
            for tail, x in rest(at + k):
                yield head + tail, w * x

    return dict(rest(0))


def contents(vocabulary):
    return [vocabulary.flat[a : a + n].tobytes().decode("utf-8", "replace") for a, n in zip(vocabulary.start, vocabulary.width, strict=True)]


def test_lattices_against_all_segmentations():
    """Chances of sampled paths, and the best one, for texts with long pieces, runs, bytes, and words beyond a unit."""
    vocabulary = load(public_tokenizers.path("piece_bpe_32k.model"))
    sampling, search = Lattices(vocabulary), Lattices(vocabulary, search=True)
    for text in ["international", "a  b", "é😀x", "zz\nqq", "xxxxxxxxxx", "----------", "the theatre"]:
        every = segmentations(vocabulary, ("▁" + text.replace(" ", "▁")))
        total = sum(every.values())
        assert best_block(search, [text])[0].tolist() == list(max(every, key=every.get))
        got = sample_block(sampling, [text] * 300, mix64(np.arange(300, dtype=np.uint64)), 4)
        seen = {tuple(x[0].tolist()): x[1] for s in got for x in s}
        assert len(seen) > 1
        for path, log_p in seen.items():
            assert math.isclose(log_p, math.log(every[path] / total), abs_tol=1e-4)
    # a long unit is cut only where no piece reaches across, and its chances are those of the whole
    long = "a" + "qzé" * 9 + "x" * 4
    parts = vocabulary.parts("▁" + long)
    assert "".join(parts) == "▁" + long and len(parts) > 3
    pieces = {p.replace(" ", "▁") for p in contents(vocabulary)}
    at = 0
    for p in parts[:-1]:
        at += len(p)
        assert not any(("▁" + long)[i:j] in pieces for i in range(max(0, at - 16), at) for j in range(at + 1, at + 17))
    # a run in which every place is inside a piece, far beyond what doubles hold without scaling
    run = "x" * 3000
    [[(ids, log_p, _)]] = sample_block(sampling, [run], np.array([5], np.uint64), 1)
    assert decode(vocabulary, ids) == run.encode() and -6000 < log_p < 0


def test_pieces_distribution():
    vocabulary = load(public_tokenizers.path("piece_bpe_32k.model"))
    n, text = 4000, "cats"
    got = sample_block(Lattices(vocabulary), [text] * n, mix64(np.arange(n, dtype=np.uint64) + np.uint64(9)), 3)
    chance = {tuple(x[0]): math.exp(x[1]) for s in got for x in s}
    first, second = (Counter(tuple(s[k][0]) for s in got) for k in (0, 1))
    for path, p in chance.items():
        later = sum(c * p / (1 - c) for other, c in chance.items() if other != path)
        for seen, want in ((first[path] / n, p), (second[path] / n, later)):
            assert abs(seen - want) < 5 * math.sqrt(max(want, 1e-4) / n)
    assert all(len({tuple(x[0]) for x in s}) == len(s) for s in got)
    assert abs(np.mean([sum(math.exp(x[1]) / x[2] for x in s) for s in got]) - 1) < 0.02


def test_samples_depend_on_key_and_text_only():
    vocabulary = load(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["one two three", "four five", "six seven eight nine", "one five nine"]
    keys = mix64(np.arange(4, dtype=np.uint64))
    together = sample_block(Lattices(vocabulary), texts, keys, 3)
    lattices = Lattices(vocabulary)
    for i in (3, 1, 0, 2):
        [alone] = sample_block(lattices, [texts[i]], keys[i : i + 1], 3)
        assert [x[0].tolist() for x in alone] == [x[0].tolist() for x in together[i]]


def test_pieces_round_trip(spark, sf):
    got = q.op5_sentencepiece(spark, sf).collect()
    assert all(r["exact"] for r in got)
    vocabulary = load(q.PIECES)
    texts = dict(rows(spark, sf, "documents", "doc_id", "text"))
    assert all(decode(vocabulary, np.array(r["ids"])) == texts[r["doc_id"]].encode() for r in got[:50])


def test_encode_and_decode(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    some = df.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, " ▁ \x00 é😀 " + "x" * 40)], "doc_id long, text string"))
    out = decode_ids(encode_texts(some, q.PIECES), q.PIECES).collect()
    assert len(out) == some.count() and all(r["decoded"] == r["text"] for r in out)
    assert {r["doc_id"]: r["ids"] for r in out}[-1] is None
    assert encode_texts(some.where("false"), q.PIECES).count() == 0
    assert decode_ids(spark.createDataFrame([([None, -5, 10**6],), ([],)], "ids array<int>"), q.PIECES).where("decoded = ''").count() == 2


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = dict(rows(spark, sf, "labels", "doc_id", "toxic"))
    got = [(r["score"], labels[r["doc_id"]]) for r in q.op3_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    pos, neg = ([s for s, y in got if y == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.93
    assert np.mean([s >= 0.5 for s in neg]) < 0.02 and np.mean([s >= 0.5 for s in pos]) > 0.8


def test_mixing_rates(spark, sf):
    df = spark.range(20000).selectExpr("id as doc_id", "cast(id as string) as text", "if(id % 10 < 9, 'big', 'small') as source")
    from tidemark.llm.mixing import mix_sources

    got = {r["source"]: r["count"] for r in mix_sources(df, weights={"big": 0.2, "small": 0.8}, total=60000).groupBy("source").count().collect()}
    assert abs(got["big"] - 12000) < 600 and abs(got["small"] - 48000) < 1200  # rates 0.67 and 24
