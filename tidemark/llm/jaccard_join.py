"""N-gram Jaccard join with set-relation skipping.

Texts become sets of hashed word shingles, ordered by corpus frequency (rare first) so that two sets that
link share a token in a short prefix of each. Work is skipped by relations between sets:

* equal sets are one set;
* answers of one set serve highly similar ones: sets that share a minimum hash are checked against the
  most central of them, and what links to it takes over its class: pairs inside a class never become rows;
* index lists (token -> sets) with one class are dropped; the others are sorted by size and position, and
  blocks whose size or position rules a link out are skipped, as are pairs whose parity sketches do.

What remains is checked exactly on the whole sets. Classes are the connected components of all links.
Links inside a class are counted from each set's differences to what most of its class have: two sets differ
by the symmetric difference of those differences, and sizes alone settle the pairs whose differences are few.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, byte_values, free_name, frugal, mix64, numbered, scratch, small_batches, small_side, written
from .exact_dedup import tree_groups

WORDS = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Slots of the frequency sketch (one byte each when broadcast); a token's order depends on its slot's count.
SLOTS = 1 << 21
_SLOT = np.uint64(64 - 21)
#: Minimum hashes by which a set finds leaders.
STARS = 12
#: Turns in which sets look for leaders before the index lists are built.
TURNS = 2
#: Slots of the shortest sketch, which the index lists carry.
SHORTEST = 512
#: A list longer than this is dealt out in chunks, each pair of chunks a piece of work of its own.
CHUNK = 20_000
#: Sets of neighbouring lists that are looked at together.
DEAL = 40_000
#: Pairs that a task holds at most before it sends them on.
HELD_PAIRS = 1_000_000
#: Lists with several classes are broadcast up to this many (a token each, some 60 MB), else joined by shuffle.
BROADCAST_LISTS = 1_000_000
#: Sets and tokens of a chunk of a class when the links inside it are counted, and columns counted at once.
CLASS_SETS, CLASS_TOKENS, COLUMNS = 512, 1 << 19, 2048

_HASH = np.uint64((1 << 56) - 1)
_SHORT = np.uint64((1 << 48) - 1)


def least_overlap(a, b):
    """Smallest intersection with which sets of sizes a and b link."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_length(n):
    return n - (-(-PERCENT * n // 100)) + 1


def shingle_blocks(texts: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(shingle hashes, first position of each text, number of texts) of blocks of texts."""
    for _, block in blocks(texts):
        hashes, of = Words(block).shingles(WORDS)
        yield hashes, np.searchsorted(of, np.arange(len(block) + 1)), len(block)


def frequency_levels(texts: DataFrame) -> np.ndarray:
    """For each slot a level: 0 for slots that stand out in no task, else a logarithm of the count over all texts.

    Each task sends the slots whose count is clearly above its own mean; the sums of those make the levels.
    Any level gives a valid order, so the sketch decides only how short the lists are.
    """

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for hashes, _, _ in shingle_blocks(byte_values(batch.column(0))):
                total += np.bincount(hashes >> _SLOT, minlength=SLOTS)
        mean = total.mean()
        slot = np.flatnonzero(total >= mean + 3 * np.sqrt(mean) + 2)
        for k in range(0, len(slot), 1 << 16):
            part = slot[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part], pa.int64())], ["slot", "n"])

    with small_batches(texts.sparkSession):
        sums = texts.select("text").mapInArrow(frugal(slots), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    levels = np.zeros(SLOTS, np.uint8)
    n = sums.column("n").to_numpy()
    levels[sums.column("slot").to_numpy()] = np.minimum(1 + 2 * np.log2(np.maximum(n, 1)), 120).astype(np.uint8)
    return levels


def ordered(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Tokens as numbers whose order is frequency level, then hash."""
    return (levels[(hashes >> _SLOT).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (hashes & _HASH)


def token_sets(hashes: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct tokens of each text."""
    for a, b in zip(at[:-1], at[1:], strict=True):
        x = np.sort(hashes[a:b])
        yield x[np.append(True, x[1:] != x[:-1])] if len(x) > 1 else x


def sketch(tokens: np.ndarray) -> bytes:
    """A bitmap of the parities of token counts by slot: n / 2 slots or more, a power of two of at least SHORTEST.

    Two bitmaps differ in at most as many slots as the sets differ in tokens, which bounds the overlap.
    """
    slots = max(SHORTEST, 1 << (len(tokens) // 2).bit_length())
    return np.packbits(np.bincount((tokens & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1).tobytes()


def difference(a: bytes, b: bytes) -> int:
    """Slots in which two sketches differ; the longer one is folded to the length of the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):  # slot i of the shorter sketch has the tokens of slots i and i + half
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def shortest(bitmap: bytes) -> bytes:
    """A sketch folded to SHORTEST slots."""
    return np.bitwise_xor.reduce(np.frombuffer(bitmap, np.uint8).reshape(-1, SHORTEST // 8), 0).tobytes()


def packed(tokens: np.ndarray) -> bytes:
    """Sorted tokens in six bytes each."""
    return tokens.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: memoryview) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


_STAR = mix64(np.arange(1, STARS + 3, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def described_sets(texts: DataFrame, levels: np.ndarray) -> DataFrame:
    """id, seq, n, k1, k2 (equal for equal sets only, but for 128-bit collisions), stars, prefix of each text."""
    held = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for hashes, at, texts_here in shingle_blocks(byte_values(batch.column(2))):
                n, k1, k2, stars, prefix, bitmap, short = [], [], [], [], [], [], []
                empty = np.empty(0, np.uint64)
                for x in token_sets(ordered(hashes, held.value), at):
                    n.append(len(x))
                    k1.append(mix64(x * _STAR[-1]).sum() if len(x) else np.uint64(0))
                    k2.append(mix64(x * _STAR[-2]).sum() if len(x) else np.uint64(0))
                    h = x & _HASH
                    stars.append(np.array([mix64(h * s).min() ^ s for s in _STAR[:STARS]], np.uint64) if len(x) else empty)
                    bitmap.append(sketch(h))
                    short.append(shortest(bitmap[-1]))
                    prefix.append(x[: prefix_length(len(x))] if len(x) else empty)
                ids = batch.slice(done, texts_here)
                done += texts_here
                longs = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (n, k1, k2)]
                yield pa.RecordBatch.from_arrays([ids.column(0), ids.column(1), *longs, _lists(stars), _lists(prefix), pa.array(bitmap, pa.binary()), pa.array(short, pa.binary())], ["id", "seq", "n", "k1", "k2", "stars", "prefix", "sketch", "short"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "seq", "text").mapInArrow(frugal(run), f"id {kind}, seq long, n long, k1 long, k2 long, stars array<long>, prefix array<long>, sketch binary, short binary")


def full_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """seq, tokens (sorted, 48 bits of each hash) of the texts whose seq is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for hashes, at, texts_here in shingle_blocks(byte_values(batch.column(1))):
                sets = [packed(x) for x in token_sets(hashes & _SHORT, at)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, texts_here), pa.array(sets, pa.binary())], ["seq", "tokens"])
                done += texts_here

    some = texts.select("seq", "text").join(small_side(wanted), "seq", "left_semi")
    return some.select("seq", "text").mapInArrow(frugal(run), "seq long, tokens binary")


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches leave a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, sa, sb = batch.columns
            n, m = na.to_numpy(), nb.to_numpy()
            most = n + m - 2 * least_overlap(n, m)
            keep = np.array([difference(x, y) <= k for x, y, k in zip(sa.to_pylist(), sb.to_pylist(), most, strict=True)], bool)
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep))

    side = {c: sets.select(F.col("seq").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab"}
    both = pairs.join(side["b"], "b").join(side["a"], "a")
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(frugal(run), "a long, b long")


def links_of(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link, with the size of their intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, common = [], []
            for k in range(batch.num_rows):
                a, b = (unpacked(batch.column(c)[k].as_buffer()) for c in (2, 3))
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                i = int((b[at] == a).sum())
                if 100 * i >= PERCENT * (len(a) + len(b) - i):
                    keep.append(k)
                    common.append(i)
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(common, pa.int64())], ["a", "b", "common"])

    pairs = written(possible(pairs, sets), "pairs")
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("seq")).distinct(), "wanted")
    tokens = full_sets(texts, wanted)
    both = pairs.join(tokens.withColumnsRenamed({"seq": "b", "tokens": "tb"}), "b").join(tokens.withColumnsRenamed({"seq": "a", "tokens": "ta"}), "a")
    return written(both.select("a", "b", "ta", "tb").mapInArrow(frugal(run), "a long, b long, common long"), "links")


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of the edges (a, b); root is the same for all nodes that edges connect.

    Each round every node moves to its least neighbour and edges follow, until none is left. Even rounds order
    nodes by id, which ends a star at once; odd rounds by a hash of their own, by which a chain, however its
    ids lie, loses a share of its nodes: the rounds are logarithmic in a component's length. Hot nodes are
    pre-aggregated, and joins on them are split by AQE.
    """
    edges = edges.select("a", "b").where("a != b").distinct()
    labels = None
    for r in count():
        edges = written(edges, "edges")
        if edges.isEmpty():
            break
        place = lambda c: F.xxhash64(F.lit(r), c) if r % 2 else F.col(c)  # noqa: B023, E731
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("e")).select("e.*")
        nearest = ends.groupBy("node").agg(F.min(F.struct(place("to").alias("at"), "to")).alias("least"))
        moves = written(nearest.select("node", F.least(F.struct(place("node").alias("at"), F.col("node").alias("to")), "least")["to"].alias("root")), "moves")
        if labels is None:
            labels = moves
        else:
            step = moves.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            if r % 4 == 3:
                labels = written(labels, "labels")
        ma, mb = (moves.select(F.col("node").alias(c), F.col("root").alias(f"m{c}")) for c in "ab")
        edges = edges.join(ma, "a").join(mb, "b").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).where("a != b").distinct()
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def shared_stars(sets: DataFrame) -> DataFrame:
    """seq, n, star of the minimum hashes that several sets have, with rank: how many share a set's hashes, negated."""
    each = sets.select("seq", "n", F.explode("stars").alias("star"))
    sizes = written(each.groupBy("star").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "star-sizes")
    each = written(each.join(small_side(sizes), "star"), "stars")
    ranks = written(each.groupBy("seq").agg((-F.sum("size")).alias("rank")), "star-ranks")
    return written(each.join(small_side(ranks), "seq").select("seq", "n", "star", "rank"), "ranked-stars")


def star_pairs(each: DataFrame, classes: DataFrame | None, turn: int) -> DataFrame:
    """Pairs (leader, set) of sets of different classes that share a minimum hash, at most one for each hash of a set.

    The first leader of a hash is the set whose own hashes the most sets share: among near copies, one that few
    edits have touched. In later turns any set may lead, by a hash of its own for the turn.
    """
    if classes is None:
        each = each.withColumn("class", F.col("seq"))
    else:
        each = each.join(small_side(classes), "seq", "left").withColumn("class", F.coalesce("class", "seq"))
        live = each.groupBy("star").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi")
        each = written(each.join(small_side(written(live.select("star"), "live-stars")), "star"), "open-stars")
    place = F.xxhash64(F.lit(turn), "seq") if turn else F.col("rank")
    lead = each.groupBy("star").agg(F.min(F.struct(place.alias("at"), "seq", "n", "class")).alias("lead"))
    pairs = each.join(small_side(written(lead, "leaders")), "star")
    pairs = pairs.where((F.col("lead.class") != F.col("class")) & (F.least("lead.n", "n") * 100 >= F.greatest("lead.n", "n") * PERCENT))
    return pairs.select(F.col("lead.seq").alias("a"), F.col("seq").alias("b")).distinct()


def star_links(single: DataFrame, sets: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of sets to leaders, and the classes (seq, class) that they make, in TURNS turns or until one finds none.

    Each turn costs at most STARS pairs for each set that shares a hash with another class. What the turns do
    not link is left to the index lists: they only decide how few classes those have to compare.
    """
    each = shared_stars(single)
    links = classes = None
    for turn in range(TURNS):
        found = links_of(star_pairs(each, classes, turn), sets, texts)
        if links is not None and found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        classes = written(components(links).withColumnsRenamed({"node": "seq", "root": "class"}), "star-classes")
    return links.select("a", "b"), classes


def list_postings(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """The index lists (token -> sets) that have sets of several classes, with what list_pairs needs.

    Lists are found and picked with narrow rows; sizes, classes and sketches join what is left of them. Lists with
    the same smallest class are dealt out together, about DEAL sets at most, so that pairs which share many tokens
    meet in one place; each chunk of a very long list is dealt out by itself.
    """
    named = sets.join(small_side(classes), "seq", "left").withColumn("class", F.coalesce("class", "seq"))
    lists = named.select("class", F.explode("prefix").alias("token")).groupBy("token").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo != hi")
    lists = written(lists.select("token", "lo", "size", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks")), "lists")
    large = lists.where("chunks = 1").groupBy("lo").agg(F.ceil(F.sum("size") / DEAL).alias("splits")).where("splits > 1")
    lists = lists.join(small_side(written(large, "splits")), "lo", "left")
    live = lists.select("token", "chunks", F.xxhash64("lo", F.pmod(F.xxhash64("token"), F.coalesce("splits", F.lit(1).cast("long")))).alias("deal"))
    live = written(live, "live-lists")
    narrow = sets.select("seq", F.posexplode("prefix").alias("pos", "token")).join(small_side(live.select("token"), BROADCAST_LISTS), "token", "left_semi")
    found = narrow.join(live, "token").join(named.select("seq", "n", "short", "class"), "seq").withColumn("chunk", F.pmod(F.xxhash64("seq"), F.col("chunks")).cast("int"))
    found = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    part = F.least("chunk", "other") * 100_000 + F.greatest("chunk", "other")
    found = found.withColumn("part", part).withColumn("whole", F.col("chunk") == F.col("other"))
    return found.withColumn("deal", F.when(F.col("chunks") > 1, F.xxhash64("token", "part")).otherwise(F.col("deal")))


def list_pairs(postings: DataFrame) -> DataFrame:
    """Candidate pairs from index lists: classes differ, and sizes, positions and sketches allow a link.

    Lists stream through in order of size and position; of a list only the sets that are large enough for
    the current one are looked at. A pair that several lists of a deal have is sent once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            x = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(names[:-1])}
            flat = b"".join(batch.column(len(names) - 1).to_pylist())
            x["short"] = np.frombuffer(flat, np.uint64).reshape(-1, SHORTEST // 64)
            if rest is not None:
                x = {c: np.concatenate((rest[c], x[c])) for c in names}
            last = x["deal"] == x["deal"][-1]
            cut = len(last) - int(last[::-1].argmin()) if not last.all() else 0
            rest = {c: v[cut:] for c, v in x.items()}
            yield from pairs({c: v[:cut] for c, v in x.items()})
        if rest is not None:
            yield from pairs(rest)

    def different(found: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.unique(np.concatenate(found, 1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def pairs(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        room = x["n"] - x["pos"]  # tokens that a set and one not before its position can have in common
        left = np.flatnonzero(room >= least_overlap(x["n"], x["n"]))
        step = held = 0
        found: list[np.ndarray] = []
        while len(left):
            step += 1
            left = left[left + step < len(x["n"])]
            right = left + step
            n, m = x["n"][left], x["n"][right]
            # sizes only grow along a list: a set that fails here skips the rest of it
            same = (x["token"][left] == x["token"][right]) & (x["part"][left] == x["part"][right]) & (100 * n >= PERCENT * m) & (room[left] >= least_overlap(n, m))
            left, right, n, m = left[same], right[same], n[same], m[same]
            good = (room[right] >= least_overlap(n, m)) & (x["class"][left] != x["class"][right]) & ((x["chunk"][left] != x["chunk"][right]) | x["whole"][left])
            i, j = left[good], right[good]
            apart = np.bitwise_count(x["short"][i] ^ x["short"][j]).sum(1, dtype=np.int64)
            good = apart <= n[good] + m[good] - 2 * least_overlap(n[good], m[good])
            if good.any():
                a, b = x["seq"][i[good]], x["seq"][j[good]]
                found.append(np.stack((np.minimum(a, b), np.maximum(a, b))))
                held += len(a)
            if held > HELD_PAIRS:
                yield different(found)
                found, held = [], 0
        if found:
            yield different(found)

    names = ["deal", "token", "part", "n", "pos", "seq", "class", "chunk", "whole", "short"]
    dealt = postings.repartition("deal").sortWithinPartitions("deal", "token", "part", "n", "pos").select(*names)
    return dealt.mapInArrow(frugal(run), "a long, b long").distinct()


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each pair of sorted sets whether it links; a set does not link to itself.

    Sets are described by their differences to the tokens that most of them have. The sums of two sets'
    differences, and their distance, bound how far the sets are apart; rows with a pair that this leaves open
    have their common differences counted.
    """
    n = np.array([len(x) for x in sets], np.int64)
    tokens, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(n)), n)
    have = np.bincount(column, minlength=len(tokens))
    usual = 2 * have > len(n)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    held = usual[column]
    # differences: the rare tokens of each set, and the usual ones it lacks
    far = np.bincount(row[~held], minlength=len(n)) + usual.sum() - np.bincount(row[held], minlength=len(n))
    most = n[:, None] + n - 2 * least_overlap(n[:, None], n)
    sure = far[:, None] + far <= most
    unsure = ~sure & (np.abs(far[:, None] - far) <= most)
    np.fill_diagonal(unsure, False)
    some = np.flatnonzero(unsure.any(1))
    if len(some):
        place = np.full(len(n), -1)
        place[some] = np.arange(len(some))
        ok = place[row] >= 0
        r, c = place[row[ok]], column[ok]
        # a difference that one of these sets has is common to no two of them
        here = np.bincount(c, minlength=len(tokens))
        shared = np.flatnonzero(np.where(usual, len(some) - here, here) > 1)
        common = np.zeros((len(some), len(some)), np.float64)
        for k in range(0, len(shared), COLUMNS):
            part = shared[k : k + COLUMNS]
            a, b = np.searchsorted(c, [part[0], part[-1] + 1])
            at = np.searchsorted(part, c[a:b])
            real = part[at] == c[a:b]
            bits = np.zeros((len(some), len(part)), np.float32)
            bits[r[a:b][real], at[real]] = 1
            bits[:, usual[part]] = 1 - bits[:, usual[part]]
            common += bits @ bits.T
        pair = np.ix_(some, some)
        sure[pair] |= far[some][:, None] + far[some] - 2 * common.astype(np.int64) <= most[pair]
    np.fill_diagonal(sure, False)
    return sure


def inner_links(links: DataFrame, classes: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """seq, n_links (to sets of the same class) of the sets of classes, which links connect.

    A class all of whose pairs are in links is done. The sets of another one are dealt out in chunks; each pair
    of chunks is counted whole, and no pair of sets is ever a row.
    """
    ends = links.select(F.explode(F.array("a", "b")).alias("seq")).groupBy("seq").agg(F.count(F.lit(1)).alias("n_links"))
    known = written(classes.join(ends, "seq").join(sets.select("seq", "n"), "seq"), "inner")
    size = known.groupBy("class").agg(F.count(F.lit(1)).alias("size"), F.sum("n_links").alias("ends"), F.sum("n").alias("tokens"))
    chunks = F.ceil(F.greatest(F.col("size") / CLASS_SETS, F.col("tokens") / CLASS_TOKENS)).cast("int")
    open_ = written(size.where("ends < size * (size - 1)").select("class", chunks.alias("chunks")), "open")
    todo = written(known.join(small_side(open_), "class").select("seq", "class", "chunks"), "members")

    def counted_links(group: pa.Table) -> pa.Table:
        seq, chunk = (group.column(c).to_numpy() for c in ("seq", "chunk"))
        yes = linked([unpacked(v.as_buffer()) for v in group.column("tokens")])
        if (chunk != chunk[0]).any():  # pairs inside a chunk are counted where it stands alone
            yes &= chunk[:, None] != chunk
        return pa.table({"seq": pa.array(seq, pa.int64()), "n": pa.array(yes.sum(1), pa.int64())})

    tokens = todo.join(full_sets(texts, todo.select("seq")), "seq").withColumn("chunk", F.pmod(F.xxhash64("seq"), F.col("chunks")).cast("int"))
    dealt = tokens.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("seq", "chunk", "tokens", "class", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
    counted = dealt.groupBy("class", "lo", "hi").applyInArrow(counted_links, "seq long, n long").groupBy("seq").agg(F.sum("n").alias("n_links"))
    return known.join(small_side(open_), "class", "left_anti").select("seq", "n_links").unionByName(counted)


def set_classes(texts: DataFrame, count_links: bool) -> DataFrame:
    """jaccard_classes of a written table (id, seq, text), with or without the count of links."""
    with scratch(texts.sparkSession):
        return _set_classes(texts, count_links)


def _set_classes(texts: DataFrame, count_links: bool) -> DataFrame:
    sets = written(described_sets(texts, frequency_levels(texts)), "shingles", keep=True)
    keyed = sets.where("n > 0").select("id", "seq", F.struct("k1", "k2").alias("sha"), F.struct("n").alias("check"))
    groups = written(tree_groups(keyed).select("seq", "id", "keep_id", "keep_seq", "kept"), "equal", keep=True)
    copies = groups.where("not kept").select("seq")
    single = sets.where("n > 0").join(small_side(copies), "seq", "left_anti")

    stars, classes = star_links(single, sets, texts)
    across = links_of(list_pairs(list_postings(single, classes)), sets, texts)
    links = stars.unionByName(across.select("a", "b"))
    roots = components(links).withColumnsRenamed({"node": "keep_seq", "root": "root"})
    rooted = groups.where("kept").select(F.col("seq").alias("keep_seq"), "keep_id").join(roots, "keep_seq")
    if count_links:
        ends = across.select(F.explode(F.array("a", "b")).alias("seq"), F.lit(1).cast("long").alias("n_links"))
        degree = ends.unionByName(inner_links(stars, classes, sets, texts)).groupBy(F.col("seq").alias("keep_seq")).agg(F.sum("n_links").alias("n_links"))
        rooted = rooted.join(degree, "keep_seq")
    else:
        rooted = rooted.withColumn("n_links", F.lit(None).cast("long"))
    least = rooted.groupBy("root").agg(F.min("keep_id").alias("least_id"))
    named = written(rooted.join(least, "root").select("keep_seq", "root", "least_id", "n_links"), "classes", keep=True)
    joined = groups.join(small_side(named), "keep_seq", "left").select("seq", F.coalesce("least_id", "keep_id").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "keep_seq").alias("class_seq"), F.lit(True).alias("known"))
    return sets.select("id", "seq", "n").join(joined, "seq", "left").select(
        "id", "seq", F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("class_seq", "seq").alias("class_seq")
    )


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, seq, n_shingles, component_id (the smallest id in its class), n_links, class_seq.

    n_links counts the other sets that a row's set links to; rows with equal sets count as one set. Null and
    empty texts have no set and are alone in their class, as is a row that nothing links to; rows with equal
    sets are one class. Null ids count as larger than any other; an id that is null or repeated may stand in
    several classes, so component_id does not tell classes apart: class_seq does. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return set_classes(numbered(rows, "seq"), True)


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: the first row read whose id is the class's smallest (null last). Columns stay as they are."""
    seq = free_name(docs, "seq")
    rows = numbered(docs, seq)
    with scratch(docs.sparkSession):
        classes = set_classes(rows.select(F.col(id_col).alias("id"), F.col(seq).alias("seq"), F.col(text_col).cast("binary").alias("text")), False)
        first = classes.groupBy("class_seq").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "seq")).alias("first"))
        kept = classes.select("seq").join(first.select(F.col("first.seq").alias("seq")), "seq", "left_anti")
        gone = written(kept.select(F.col("seq").alias(seq)), "near-copies", keep=True)
    return rows.join(small_side(gone), seq, "left_anti").drop(seq)
