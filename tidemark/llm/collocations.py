"""Phrase collocation mining: suffix arrays of word ids in each shard, counts merged by phrase, exact scores.

Texts are cut into pieces at punctuation, pieces into words. Tasks gather shards, about SHARD bytes of text in one
language, and write them once as arrays of word ids with the shard's vocabulary. For each phrase length k a task
sorts the suffixes of a shard's pieces by prefix doubling in numpy; the common prefixes of neighbours give the LCP
intervals, and every interval of depth k is a phrase with its count. Counts are merged by (language, phrase).

A phrase of k words is at most as frequent as the two phrases of k - 1 words in it, so only suffixes whose shorter
phrases are frequent somewhere in the corpus are counted at length k. A bit table of fixed size, over hashes of the
frequent shorter phrases, tells them: a collision lets a phrase be counted in vain, and none is ever left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_values, frugal, scratch, small_batches, small_side, written

#: Text bytes of a shard, about; a text is never cut, so a shard may be longer by one text.
SHARD = 3 << 20
#: Bits of the table of frequent phrases, at every size of the corpus: 16 MB. Fewer free bits only cost time.
BITS = 1 << 27
#: Phrases are ranked in so many parts of a language before the parts' first ones are ranked together.
PARTS = 64
#: Tables of frequent phrases are broadcast up to this many rows, some 40 MB.
BROADCAST_PHRASES = 500_000
_END = 0x2E
_FOLD = bytearray(range(256))
_FOLD[65:91] = range(97, 123)
for _c in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_c] = _END


class Shard:
    """Words of texts in one language: ids (0: the end of a piece) and the vocabulary in the order of ids from 1."""

    def __init__(self, texts: list[bytes]):
        known: defaultdict[bytes, int] = defaultdict(lambda: len(known))
        known[b"."] = 0
        words = b" . ".join(texts).translate(bytes(_FOLD)).replace(b".", b" . ").split()
        self.ids = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        self.words = list(known)[1:]
        self.counts = np.bincount(self.ids, minlength=len(known))[1:]


def suffix_order(ids: np.ndarray, room: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes sorted by their first `most` words, and each one's common prefix with the one before it.

    room: words from each position to its piece's end. Ranks by 1, 2, 4, ... words: a suffix that ends earlier
    comes first. Prefixes are counted up to `most` words."""
    rank, width = ids.astype(np.int64), 1
    while width < most:
        ahead = np.zeros(len(rank), np.int64)
        longer = np.flatnonzero(room > width)
        ahead[longer] = rank[longer + width] + 1
        key = rank * (ahead.max(initial=0) + 1) + ahead
        order = np.argsort(key)
        step = np.concatenate(([False], key[order[1:]] != key[order[:-1]])) if len(order) else np.empty(0, bool)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(step)
        width *= 2
    order = np.argsort(rank)
    lcp, same = np.zeros(len(order), np.int64), np.ones(max(0, len(order) - 1), bool)
    for k in range(most):
        a, b = order[:-1] + k, order[1:] + k
        same &= (room[order[:-1]] > k) & (room[order[1:]] > k)
        same[same] = ids[a[same]] == ids[b[same]]
        lcp[1:] += same
    return order, lcp


def intervals(order: np.ndarray, lcp: np.ndarray, room: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The LCP intervals of depth k: a position of each phrase of k words, and its count."""
    whole = room[order] >= k
    first = np.flatnonzero(whole & (lcp < k))
    ends = np.append(first[1:], len(order))
    held = np.concatenate(([0], np.cumsum(whole)))
    return order[first], held[ends] - held[first]


def rooms(ids: np.ndarray) -> np.ndarray:
    """Words from each position to the next 0 (or the end), itself included; 0 at a 0."""
    stops = np.append(np.flatnonzero(ids == 0), len(ids))
    at = np.arange(len(ids))
    return stops[np.searchsorted(stops, at)] - at


class Frequent:
    """A bit table of phrases (language, a space, words joined by spaces) by hash."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, keys: list[bytes]) -> np.ndarray:
        h = np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), np.uint64, len(keys))
        place = (h % np.uint64(8 * len(self.bits))).astype(np.int64)
        return (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _place(bits: int) -> Column:
    """The place of a phrase in the bit table, from the same hash as in tasks (as an unsigned number)."""
    h = F.xxhash64(F.concat_ws(" ", "lang", "phrase"))
    half = F.shiftrightunsigned(h, 1)  # h = 2 * half + the last bit
    return F.pmod(F.pmod(half, F.lit(bits)) * 2 + F.pmod(h, F.lit(2)), F.lit(bits))


def frequent_bits(phrases: DataFrame, bits: int = BITS) -> Frequent:
    """The bit table of phrases (lang, phrase); the driver gets blocks of 4 KB, bits / 8 bytes at most."""
    span = 1 << 15
    place = phrases.select(_place(bits).alias("place")).distinct()
    blocks = place.groupBy(F.floor(F.col("place") / span).cast("long").alias("block")).agg(F.expr(f"bitmap_construct_agg(pmod(place, {span}))").alias("map"))
    out = np.zeros(bits // 8, np.uint8)
    for r in blocks.toLocalIterator():
        out[r["block"] * span // 8 : (r["block"] + 1) * span // 8] = np.frombuffer(r["map"], np.uint8)[: span // 8]
    return Frequent(out)


def shards(docs: DataFrame, text_col: str, lang_col: str, size: int = SHARD) -> DataFrame:
    """lang, words, counts and ids of shards; a task closes its shards together once their texts have `size` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: defaultdict[str, list[bytes]] = defaultdict(list)
        held = 0

        def closed() -> Iterator[pa.RecordBatch]:
            for lang, texts in open_.items():
                s = Shard(texts)
                if len(s.words):
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([s.words], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array([s.counts]), pa.array([s.ids.tobytes()])], ["lang", "words", "counts", "ids"])
            open_.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), byte_values(batch.column(1)), strict=True):
                open_[lang].append(text)
                held += len(text) + 1
                if held >= size:
                    yield from closed()
                    held = 0
        yield from closed()

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(frugal(run), "lang string, words array<string>, counts array<long>, ids binary")


def counted(pieces: DataFrame, k: int, shorter: Frequent) -> DataFrame:
    """lang, phrase, n: the phrases of k words in each shard whose shorter phrases may be frequent."""
    spark = pieces.sparkSession
    table = spark.sparkContext.broadcast(shorter.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent(table.value)
        for batch in batches:
            for lang, words, raw in zip(*(batch.column(c) for c in ("lang", "words", "ids")), strict=True):
                at, n = _phrases(np.frombuffer(raw.as_buffer(), np.int32), words.values, lang.as_py().encode() + b" ", k, frequent)
                ids = np.frombuffer(raw.as_buffer(), np.int32)
                for a in range(0, len(at), 1 << 16):
                    some = at[a : a + (1 << 16)]
                    phrase = pc.binary_join_element_wise(*(words.values.take(pa.array(ids[some + j] - 1)) for j in range(k)), " ")
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang.cast(pa.string()), len(some)), phrase.cast(pa.string()), pa.array(n[a : a + (1 << 16)], pa.int64())], ["lang", "phrase", "n"])

    return pieces.select("lang", "words", "ids").mapInArrow(frugal(run), "lang string, phrase string, n long")


def _phrases(ids: np.ndarray, words: pa.Array, lang: bytes, k: int, frequent: Frequent) -> tuple[np.ndarray, np.ndarray]:
    """Positions and counts of the phrases of k words whose phrases of k - 1 words are all in frequent."""
    word = words.cast(pa.binary()).to_pylist()
    if k == 2:
        good = np.concatenate(([False], frequent.has([lang + w for w in word])))
        cut = np.where(good[ids], ids, 0)
        return intervals(*suffix_order(cut, room := rooms(cut), 2), room, 2)
    room = rooms(ids)
    order, lcp = suffix_order(ids, room, k)
    at, n = intervals(order, lcp, room, k - 1)
    known = [np.empty(0, bool)]
    for a in range(0, len(at), 1 << 15):
        rows = np.stack([ids[at[a : a + (1 << 15)] + j] for j in range(k - 1)], 1).tolist()
        known.append(frequent.has([lang + b" ".join([word[i - 1] for i in row]) for row in rows]))
    # a position is good if the phrase of k - 1 words that begins there may be frequent
    good = np.zeros(len(ids) + 1, bool)
    good[order[room[order] >= k - 1]] = np.repeat(np.concatenate(known), n)
    at, n = intervals(order, lcp, room, k)
    both = good[at] & good[at + 1]
    return at[both], n[both]


def _parts(length: int, k: Column | int) -> tuple[Column, Column]:
    """A phrase's first k words, and the rest."""
    words = F.split("phrase", " ", -1)
    return F.array_join(F.slice(words, 1, k), " "), F.array_join(F.slice(words, k + 1, length), " ")


def _inside(length: int, k: int) -> Column:
    """The phrases of k words inside a phrase."""
    words = F.split("phrase", " ", -1)
    return F.transform(F.sequence(F.lit(1), F.lit(length - k + 1)), lambda i: F.array_join(F.slice(words, i, k), " "))


def collocations(
    docs: DataFrame, *, words: int = 3, least: int = 10, first: int = 2000, inside: int = 50, text_col: str = "text", lang_col: str = "lang", size: int = SHARD, bits: int = BITS
) -> DataFrame:
    """The first phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    Phrases have 2 to `words` words and stand at least `least` times (a) inside pieces of text. A cut after k words
    has l and r, the counts of its two sides, and scores floor(1000000 * a * a / (l * r)); the lowest-scoring cut
    counts, the first of equal ones. A phrase whose words stand inside a longer frequent phrase with at least
    `inside` percent of its count is left out. n is the language's word count. Order: score and a descending, phrase
    ascending by its bytes. Null texts are empty, a null language is `und` (with a language of that name); repeated rows
    count as often as they stand; texts of any length are read whole. Other columns are ignored, whatever their names; an empty
    table, or one without a frequent phrase, gives an empty result. size: bytes of a shard; bits: of the bit table (neither changes
    a result).
    """
    with scratch(docs.sparkSession):
        pieces = written(shards(docs, text_col, lang_col, size), "word-ids")
        every = pieces.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("phrase"), F.col("w.counts").alias("n"))
        totals = pieces.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda acc, c: acc + c)).alias("n"))
        totals = written(totals, "words-of-languages")
        found = []
        for k in range(1, words + 1):
            # a shard has each phrase once, so rows go to their place without being gathered by phrase in the sending task
            rows = every if k == 1 else counted(pieces, k, frequent_bits(found[-1], bits)).repartition("lang", "phrase")
            merged = rows.groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
            with small_batches(docs.sparkSession, 1):  # a shard is a row
                found.append(written(merged.where(F.col("a") >= least), f"phrases-{k}"))
        out = ranked(found, totals, first, inside)
        return written(out, "collocations", keep=True)


def scored(found: list[DataFrame]) -> list[DataFrame]:
    """lang, phrase, a, l, r, score of the frequent phrases of 2, 3, ... words; found: those of 1, 2, 3, ..."""
    out = []
    for k in range(2, len(found) + 1):
        df = found[k - 1]
        for cut in range(1, k):
            head, tail = _parts(k, cut)
            for name, part, length in ((f"l{cut}", head, cut), (f"r{cut}", tail, k - cut)):
                side = found[length - 1].select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("a").alias(name))
                df = df.join(small_side(side, BROADCAST_PHRASES), (F.col("lang") == F.col("_lang")) & (part == F.col("_part"))).drop("_lang", "_part")
            a, left, right = (f"cast({c} AS decimal(16,0))" for c in ("a", f"l{cut}", f"r{cut}"))  # counts under 10^16: 38 digits hold the products
            score = F.expr(f"(1000000BD * ({a} * {a})) div ({left} * {right})")
            df = df.withColumn(f"cut{cut}", F.struct(score.cast("long").alias("score"), F.lit(cut).alias("k"), F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r")))
        lowest = F.least(*(F.col(f"cut{c}") for c in range(1, k))) if k > 2 else F.col("cut1")
        out.append(df.select("lang", "phrase", "a", lowest.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    return out


def ranked(found: list[DataFrame], totals: DataFrame, first: int, inside: int) -> DataFrame:
    kept = []
    for k, phrases in enumerate(scored(found), 2):
        for longer in range(k + 1, len(found) + 1):
            top = found[longer - 1].select("lang", F.explode(_inside(longer, k)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
            covered = top.join(found[k - 1], ["lang", "phrase"]).where(100 * F.col("most") >= inside * F.col("a")).select("lang", "phrase")
            phrases = phrases.join(covered, ["lang", "phrase"], "left_anti")
        kept.append(phrases)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part")
    rows = reduce(DataFrame.unionByName, kept).select("*", part)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return rows.join(small_side(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
