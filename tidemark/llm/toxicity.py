"""Toxicity by compression distance: one zstandard dictionary per class, compared window by window.

A window is a lower-cased word, or a piece of at most WIDTH bytes of a longer one, behind a fixed frame
that both dictionaries know, so that the block coder always compresses. Each window is compressed with
the toxic and with the ordinary dictionary. The two lengths, with the window's own, are looked up in
thresholds calibrated on labelled documents: the log-odds that a toxic document has such a window. A
document's evidence is the sum over its windows of log-odds above FIRE, against its length; a calibrated
curve turns it into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import byte_values, free_name, frugal, small_batches, small_side, written

#: Labelled documents that a model is fitted on, at most about so many: rows are taken by a hash of their id.
SAMPLE = 20_000
TRAIN_SHARE = 0.6
WIDTH = 48
FRAME = b"0123456789ABCDEFGHIJKLMNOPQRSTUV "
TOXIC_BYTES, ORDINARY_BYTES = 2048, 65536
#: A word enters the toxic samples when its document frequencies differ by so many standard deviations.
Z_CUT = 4.0
MOST_WORDS = 600
ORDINARY_WORDS = 30_000
REPEAT = 400
LEVEL = 12
FIRE = 1.5
#: Windows whose lengths a worker remembers.
REMEMBERED = 150_000

_WORD = re.compile(r"[^\W_]+")


def held_out(id_: Column, folds: int = 5) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo folds, is 0."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % folds == 0


def windows(text: str) -> list[str]:
    """Words of letters and digits, lower-cased; longer words than WIDTH // 2 characters in pieces that overlap by half."""
    out = []
    half = WIDTH // 4
    for w in _WORD.findall(text.lower()):
        if len(w) <= 2 * half:
            out.append(w)
        else:
            out += [w[k : k + 2 * half] for k in range(0, len(w) - half, half)]
    return out


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=ORDINARY_BYTES, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, min_match=3)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), compression_params=parameters)


class Lengths:
    """Window -> (bytes, length with the ordinary dictionary, length with the toxic one)."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)

    def __call__(self, window: str) -> tuple[int, int, int]:
        raw = window.encode("utf-8", "replace")
        block = FRAME + raw + b" "
        return min(len(raw), 24), len(self.ordinary.compress(block)), len(self.toxic.compress(block))


@dataclass
class Model:
    """toxic and ordinary: dictionaries. odds: log-odds by lengths. cuts, chances: evidence -> probability."""

    toxic: bytes = b""
    ordinary: bytes = b""
    odds: dict[tuple[int, int, int], float] = field(default_factory=dict)
    cuts: list[float] = field(default_factory=list)
    chances: list[float] = field(default_factory=lambda: [0.0])

    def scorer(self):
        lengths = Lengths(self.toxic, self.ordinary) if self.toxic else None
        known: dict[str, float] = {}
        odds, cuts, chances = self.odds, np.array(self.cuts), np.array(self.chances)

        def evidence(text: str) -> float:
            if lengths is None:
                return 0.0
            if len(known) > REMEMBERED:
                known.clear()
            total, n = 0.0, 0
            for w in windows(text):
                v = known.get(w)
                if v is None:
                    v = odds.get(lengths(w), 0.0)
                    v = known[w] = v if v > FIRE else 0.0
                total += v
                n += 1
            return total / math.sqrt(n + 30)

        def score(e: float) -> float:
            k = int(np.searchsorted(cuts, e, "right"))
            lo, hi = (cuts[k - 1] if k else 0.0), (cuts[k] if k < len(cuts) else 2 * cuts[-1] + 1 if len(cuts) else 1.0)
            inside = min(max((e - lo) / (hi - lo), 0.0), 1.0) if hi > lo else 0.0
            below, above = chances[k], chances[min(k + 1, len(chances) - 1)]
            return float(below + (above - below) * inside * 0.5)

        return evidence, score


def _curve(evidence: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Pooled adjacent violators over the ordered evidence: cuts and non-decreasing chances (add-one smoothed)."""
    order = np.argsort(evidence, kind="stable")
    e, t = evidence[order], y[order]
    values, at = np.unique(e, return_index=True)
    ends = np.append(at[1:], len(e))
    pools: list[list[float]] = []
    for v, s, z in zip(values, at, ends, strict=True):
        pools.append([float(t[s:z].sum()), float(z - s), float(v)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            top = pools.pop()
            pools[-1][0] += top[0]
            pools[-1][1] += top[1]
    if not pools:
        return [], [0.0]
    return [p[2] for p in pools[1:]], [(p[0] + 0.5) / (p[1] + 1) for p in pools]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on labelled rows outside the held-out fold.

    At most about `sample` documents (of each id the first label by value) are read, chosen by a hash of
    the id; dictionaries are trained on TRAIN_SHARE of that bounded sample, thresholds calibrated on the rest. Rows with a null
    id or label are left out. Without documents of both classes the model scores everything 0.
    """
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    named = named.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    n = named.count()
    if n > sample:
        named = named.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 20)) < int(sample / n * (1 << 20)))
    trains = F.pmod(F.xxhash64(F.lit(6), "id"), F.lit(1000)) < int(TRAIN_SHARE * 1000)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    # each batch sends counts of its words, not its texts
    rows = texts.join(F.broadcast(named.where(trains)), "id").mapInArrow(frugal(_counted), "y int, word string, docs long, times long")
    counts = rows.groupBy("y", "word").agg(F.sum("docs").alias("docs"), F.sum("times").alias("times"))
    counts = written(counts, "word-counts")
    total = {r["y"]: r["docs"] for r in counts.where("word = ''").collect()}
    toxic_docs, plain_docs = total.get(1, 0), total.get(0, 0)
    if not toxic_docs or not plain_docs:
        return Model()
    share = toxic_docs / (toxic_docs + plain_docs)
    pos = F.coalesce(F.sum(F.when(F.col("y") == 1, F.col("docs"))), F.lit(0))
    neg = F.coalesce(F.sum(F.when(F.col("y") == 0, F.col("docs"))), F.lit(0))
    words = counts.where("word != ''").groupBy("word").agg(pos.alias("a"), neg.alias("b"), F.sum("times").alias("times"))
    z = (F.col("a") - (F.col("a") + F.col("b")) * share) / F.sqrt((F.col("a") + F.col("b")) * share * (1 - share))
    words = words.withColumn("z", z)
    strong = words.where((F.col("a") >= 3) & (F.col("z") > Z_CUT)).orderBy(F.desc("z"), "word").limit(MOST_WORDS).collect()
    common = words.where(F.col("z") < 1).orderBy(F.desc("times"), "word").limit(ORDINARY_WORDS).collect()
    if not strong or not common:
        return Model()
    block = lambda w: FRAME + w.encode() + b" "
    toxic = [block(r["word"]) for r in strong for _ in range(min(r["a"], REPEAT))]
    toxic *= max(1, -(-4000 // len(toxic)))
    ordinary = [block(r["word"]) for r in common for _ in range(max(1, min(50, math.isqrt(r["times"]))))]
    try:
        dictionaries = [zstandard.train_dictionary(size, x, level=19).as_bytes() for size, x in ((TOXIC_BYTES, toxic), (ORDINARY_BYTES, ordinary))]
    except zstandard.ZstdError:  # too few samples for a trained dictionary
        return Model()
    with small_batches(docs.sparkSession):
        return _calibrated(texts.join(F.broadcast(named.where(~trains)), "id"), *dictionaries)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document and occurrence counts of the words of each class, by batch; the word '' counts documents."""
    for batch in batches:
        at = {name: i for i, name in enumerate(batch.schema.names)}
        docs: dict[int, Counter] = {0: Counter(), 1: Counter()}
        times: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for y, raw in zip(batch.column(at["y"]).to_pylist(), byte_values(batch.column(at["text"])), strict=True):
            found = windows(raw.decode("utf-8", "replace"))
            docs[int(y > 0)].update({*found, ""})
            times[int(y > 0)].update(found)
        rows = [(y, w, n, times[y][w]) for y in (0, 1) for w, n in docs[y].items()]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["y", "word", "docs", "times"])


def _calibrated(labelled: DataFrame, toxic: bytes, ordinary: bytes) -> Model:
    """Log-odds of each triple of lengths, then the curve from evidence to probability, on documents that trained no dictionary."""

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, known = Lengths(toxic, ordinary), {}
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            found: Counter = Counter()
            for y, raw in zip(batch.column(at["y"]).to_pylist(), byte_values(batch.column(at["text"])), strict=True):
                keys = {(-1, 0, 0)}
                for w in set(windows(raw.decode("utf-8", "replace"))):
                    k = known.get(w)
                    if k is None:
                        if len(known) > REMEMBERED:
                            known.clear()
                        k = known[w] = lengths(w)
                    keys.add(k)
                found.update((*k, int(y > 0)) for k in keys)
            cols = list(zip(*[(*k, n) for k, n in found.items()], strict=True)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["n", "o", "t", "y", "docs"])

    table = labelled.mapInArrow(frugal(triples), "n long, o long, t long, y long, docs long").groupBy("n", "o", "t", "y").agg(F.sum("docs").alias("docs")).collect()
    seen = {(r["n"], r["o"], r["t"], r["y"]): r["docs"] for r in table}
    all_ = [max(1, seen.get((-1, 0, 0, y), 0)) for y in (0, 1)]
    keys = {k[:3] for k in seen if k[0] >= 0}
    odds = {k: math.log((seen.get((*k, 1), 0) + 0.2) / (all_[1] + 1)) - math.log((seen.get((*k, 0), 0) + 0.5) / (all_[0] + 1)) for k in keys}
    model = Model(toxic, ordinary, odds)

    def evidences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence, _ = model.scorer()
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            e = [round(evidence(raw.decode("utf-8", "replace")), 3) for raw in byte_values(batch.column(at["text"]))]
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.float64()), batch.column(at["y"]).cast(pa.int64())], ["e", "y"])

    pairs = np.array([(r["e"], r["y"] > 0) for r in labelled.mapInArrow(frugal(evidences), "e double, y long").collect()]).reshape(-1, 2)
    model.cuts, model.chances = _curve(pairs[:, 0], pairs[:, 1])
    return model


def text_scores(rows: DataFrame, model: Model) -> DataFrame:
    """key and score, 0 to 1, of each row of (key, text): the chance that its whole text is toxic. Texts go to Python, nothing else comes back."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence, score = held.value.scorer()
        for batch in batches:
            s = [score(evidence(raw.decode("utf-8", "replace"))) for raw in byte_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["key", "score"])

    return rows.select("key", F.col("text").cast("binary")).mapInArrow(frugal(run), StructType([rows.schema["key"], StructField("score", DoubleType())]))


def score_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of each row. A null text is scored as an empty one."""
    scored = text_scores(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")), model).withColumnRenamed("key", "id")
    return scored.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """docs without the rows that score cut or more; the columns stay as they are.

    A score follows from the text alone, so rejected texts are known by a digest of theirs, which is written once.
    """
    key = free_name(docs, "key")
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    scored = text_scores(docs.select(F.md5(text).alias("key"), text.alias("text")), model)
    gone = written(scored.where(F.col("score") >= cut).select(F.col("key").alias(key)).distinct(), "rejected")
    return docs.withColumn(key, F.md5(text)).join(small_side(gone), key, "left_anti").drop(key)
