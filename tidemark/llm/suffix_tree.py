"""Language-model scoring with a probabilistic suffix tree.

Symbols are the words with `symbol` training tokens at least (see Least), and one for all others. Contexts are the last
symbols, one and more: one of the next length is looked at if it has `context` tokens at least and what it has without its
oldest symbol is a state, as long as there are any. A context is a state of the tree if a
divergence test finds its next-symbol distribution unlike that of the context without its oldest symbol. Next-symbol counts are smoothed with the shorter context's distribution. A token is scored in the state of
the longest suffix; a rare word's probability is that of the rare symbol times its share among rare words.

All counts cover all training tokens. What must be seen how often to be kept grows as the square root of the
corpus, so what the tree keeps grows as the square root too, at every size alike: twice the corpus keeps more symbols, more
contexts and longer ones. That much is broadcast; word counts, whose number grows with the corpus, are joined by
shuffle but for the commonest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, byte_values, frugal, small_batches, with_seq, written

#: Least counts of symbols, contexts and next-symbol entries, as multiples of the square root of the training tokens.
SYMBOL, CONTEXT, ENTRY = 0.5, 0.2, 0.01
#: Symbols of a context, at most: each length is a pass over the texts, and the divergence test mostly ends earlier.
DEPTH = 6
#: Weight of the shorter context's distribution, in tokens.
PRIOR = 20.0
#: The hash of the token that ends a text; also the context at its start.
END = np.uint64(0xE4D0F7E75A11D0C5)


@dataclass(frozen=True)
class Least:
    """How many training tokens a symbol, a context and a next-symbol entry must have."""

    symbol: int
    context: int
    entry: int

    @staticmethod
    def of(total: int) -> Least:
        return Least(*(max(1, int(np.ceil(c * np.sqrt(total)))) for c in (SYMBOL, CONTEXT, ENTRY)))


def held_out(id_: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % folds == fold


def token_blocks(texts: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token hashes with an end after each text, number of tokens of each text) of blocks of texts."""
    for _, block in blocks(texts):
        words = Words(block)
        ends = np.cumsum(words.count)
        yield np.insert(words.words(), ends, END), words.count + 1


@dataclass
class Level:
    """The contexts of one length. grown: sorted keys (context one symbol shorter, ending one token earlier, and its
    next symbol); at the first length a context is its symbol and grown is None. suffix: each one's context without its oldest
    symbol. keys, entries: kept counts, sorted by key = context * (other + 1) + next symbol. size (0: no state)
    and rest (tokens without a kept count) of each context."""

    grown: np.ndarray | None
    suffix: np.ndarray
    keys: np.ndarray
    entries: np.ndarray
    size: np.ndarray
    rest: np.ndarray


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted number among sorted keys, -1 where it is not there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Tree:
    """total, distinct: N and V. known: sorted hashes of the words with as many tokens as an entry needs, with their
    counts and symbols (other = number of symbols). share: root probability of each symbol. levels: the
    contexts by length."""

    total: int
    distinct: int
    known: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray
    share: np.ndarray
    levels: list[Level]

    @property
    def other(self) -> int:
        return len(self.share) - 1

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0: not among the known) and symbol of each token."""
        at = _found(self.known, hashes)
        hit = at >= 0
        if not len(self.known):
            return np.zeros(len(hashes), np.int64), np.full(len(hashes), self.other)
        return np.where(hit, self.counts[at], 0), np.where(hit, self.symbol[at], self.other)

    def key(self, context: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        return np.where(context >= 0, context * (self.other + 1) + symbols, -1)

    def before(self, symbols: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """For each length of contexts the one before each token, -1 if it is none. Before a text stands an end."""
        end = int(self.look_up(np.array([END]))[1][0])
        first = np.cumsum(lengths) - lengths
        back = lambda x, start: _set(np.concatenate(([start], x[:-1])), first, start)
        one = back(symbols, end)
        out = [np.where(one == self.other, -1, one)]
        for level in self.levels[1:]:
            out.append(_found(level.grown, back(self.key(out[-1], symbols), -1)))
        return out[: len(self.levels)]

    def mixed(self, n: int, context: np.ndarray, symbols: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Next-symbol probabilities in the states of one length; where there is none, the shorter context's."""
        level = self.levels[n]
        if not len(level.size):
            return shorter
        size = np.where(context >= 0, level.size[context], 0)
        at = _found(level.keys, self.key(context, symbols))
        seen = np.where(at >= 0, level.entries[at], 0) if len(level.keys) else 0
        rest = np.where(size > 0, level.rest[context], 0)
        return np.where(size > 0, (seen + (PRIOR + rest) * shorter) / (size + PRIOR), shorter)

    def gains(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 of each token's probability in its longest state over that at the root."""
        root = p = self.share[symbols]
        for n, context in enumerate(self.before(symbols, lengths)):
            p = self.mixed(n, context, symbols, p)
        return np.log10(p / root)

    def suffix_chances(self, n: int, context: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The probability of each symbol in the state that the context, without its oldest symbol, has."""
        chain = []
        for level in reversed(self.levels[1 : n + 1]):
            context = level.suffix[context]
            chain.append(context)
        p = self.share[symbols]
        for k, at in enumerate(reversed(chain)):
            p = self.mixed(k, at, symbols, p)
        return p


def _set(x: np.ndarray, at: np.ndarray, value: int) -> np.ndarray:
    x[at] = value
    return x


def word_counts(texts: DataFrame) -> DataFrame:
    """h, c: every distinct token's hash and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, _ in token_blocks(byte_values(batch.column(0))):
                h, c = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    return texts.select("text").mapInArrow(frugal(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def next_counts(texts: DataFrame, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context, next symbol) of the tree's longest contexts, and their counts, of as many tokens as an entry needs."""
    held = texts.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = held.value
        for batch in batches:
            for hashes, lengths in token_blocks(byte_values(batch.column(0))):
                _, symbols = tree.look_up(hashes)
                key = tree.key(tree.before(symbols, lengths)[-1], symbols)
                k, n = np.unique(key[key >= 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n.astype(np.int64))], ["k", "n"])

    least = Least.of(tree.total).entry
    sums = texts.select("text").mapInArrow(frugal(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    with small_batches(texts.sparkSession):
        kept = sums.where(F.col("n") >= least).toArrow()
    k, n = kept.column("k").to_numpy(), kept.column("n").to_numpy()
    order = np.argsort(k)
    return k[order], n[order]


def _states(keys: np.ndarray, counts: np.ndarray, totals: np.ndarray, shorter: np.ndarray, other: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """size and rest of each context; size is 0 where the count (under least) or the divergence test speaks against a state.

    shorter: the next symbol's probability in the shorter context, for each key. The divergence, in nats
    over all of the context's tokens, must exceed half the logarithm of their number for each kept count.
    """
    context = keys // (other + 1)
    kept = np.bincount(context, counts, len(totals)) if len(keys) else np.zeros(len(totals))
    each = counts * np.log(np.maximum(counts / np.maximum(totals[context], 1), 1e-300) / shorter)
    rest = totals - kept
    left = 1 - (np.bincount(context, shorter, len(totals)) if len(keys) else 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        rare = np.where((rest > 0) & (left > 0), rest * np.log(rest / np.maximum(totals, 1) / np.maximum(left, 1e-300)), 0)
    divergence = (np.bincount(context, each, len(totals)) if len(keys) else np.zeros(len(totals))) + rare
    cost = 0.5 * (np.bincount(context, minlength=len(totals)) + 1) * np.log(np.maximum(totals, 2))
    good = (totals >= least) & (divergence > cost)
    return np.where(good, totals, 0), rest


def fit(texts: DataFrame) -> tuple[Tree, DataFrame]:
    """The tree of the training texts (column text, binary) and the written counts (h, c) of all their words."""
    vocabulary = written(word_counts(texts), "words")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    least = Least.of(total)
    often = vocabulary.where(F.col("c") >= least.entry).toArrow()
    h, c = often.column("h").to_numpy().view(np.uint64), often.column("c").to_numpy()
    order = np.argsort(h)
    h, c = h[order], c[order]
    is_symbol = (c >= least.symbol) | (h == END)
    other = int(is_symbol.sum())
    symbol = np.full(len(h), other)
    symbol[is_symbol] = np.arange(other)
    share = np.append((c[is_symbol] + 1) / (total + distinct + 1), 0.0)
    share[-1] = max(1 - share.sum(), 1e-12)
    none = np.empty(0, np.int64)
    tree = Tree(total, distinct, h, c, symbol, share, [])
    sizes, level = np.append(c[is_symbol], 0), Level(None, none, none, none, none, none)
    while total and len(sizes) and len(tree.levels) < DEPTH:
        n = len(tree.levels)
        tree.levels.append(level)
        level.keys, level.entries = next_counts(texts, tree)
        context, next_ = level.keys // (other + 1), level.keys % (other + 1)
        # a context's own tokens: its ends of text have no next token, so the kept counts may be fewer
        shorter = tree.suffix_chances(n, context, next_)
        level.size, level.rest = _states(level.keys, level.entries, sizes, shorter, other, least.context)
        grow = (next_ != other) & (level.entries >= least.context) & (next_ != int(tree.look_up(np.array([END]))[1][0]))
        suffix = next_[grow] if n == 0 else _found(level.grown, tree.key(level.suffix[context[grow]], next_[grow]))
        stands = (suffix >= 0) & (level.size[suffix] > 0)
        grown, sizes, suffix = level.keys[grow][stands], level.entries[grow][stands], suffix[stands]
        level = Level(grown, suffix, none, none, none, none)
    return tree, vocabulary


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Learns from the rows that are not held out. Null texts are empty; an empty text is its end token alone.
    Without training rows all scores are those of an empty model. Repeated rows are scored one by one;
    other columns are ignored; an empty table gives an empty result.
    """
    rows = with_seq(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")), "seq")
    tree, vocabulary = fit(rows.where(~held_out(F.col("id"))))
    held = docs.sparkSession.sparkContext.broadcast(tree)
    whole = tree.total + tree.distinct + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = held.value
        for batch in batches:
            done = 0
            for hashes, lengths in token_blocks(byte_values(batch.column(2))):
                c, symbols = tree.look_up(hashes)
                of = np.repeat(np.arange(len(lengths)), lengths)
                total = lambda v: np.bincount(of, v, len(lengths))  # noqa: B023, E731
                rare = c == 0
                base = np.where(rare, 0, np.log10((c + 1) / whole))
                ends = np.concatenate(([0], np.cumsum(total(rare)))).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[rare].view(np.int64)))
                ids = batch.slice(done, len(lengths))
                done += len(lengths)
                yield pa.RecordBatch.from_arrays([ids.column(0), ids.column(1), pa.array(lengths.astype(np.int64)), pa.array(total(~rare).astype(np.int64)), pa.array(total(base)), pa.array(total(tree.gains(symbols, lengths))), tail], ["id", "seq", "n_tokens", "known", "base", "gain", "tail"])

    kind = rows.schema["id"].dataType.simpleString()
    scored = written(rows.select("id", "seq", "text").mapInArrow(frugal(run), f"id {kind}, seq long, n_tokens long, known long, base double, gain double, tail array<long>"), "scored")
    log = lambda c: F.log10((c + 1) / F.lit(float(whole)))
    tail = scored.select("seq", F.explode("tail").alias("h"))
    found = tail.join(vocabulary, "h").groupBy("seq").agg(F.count(F.lit(1)).alias("more"), F.sum(log(F.col("c"))).alias("sum"))
    out = scored.select("id", "seq", "n_tokens", "known", "base", "gain", F.size("tail").alias("rare")).join(found, "seq", "left")
    more = F.coalesce("more", F.lit(0).cast("long"))
    base = F.col("base") + F.coalesce("sum", F.lit(0.0)) + (F.col("rare") - more) * float(np.log10(1 / whole))
    return out.select("id", held_out(F.col("id")).alias("held_out"), "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(tree.total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"))
