"""SentencePiece encoding and decoding with sampled segmentations, drawn without replacement.

A text's pieces form a lattice: every way to cut it into vocabulary pieces, with bytes for characters
that have none. Path probabilities are products of piece weights, normalised by a backward pass. Samples
are drawn by Gumbel top-k: each node of the search holds the largest perturbed log-probability of the
paths below it. The search always opens the node with the largest bound; its best child inherits the
bound and the other children share a truncated one, so a first path comes straight from the lattice and
each further path leaves an earlier one where the largest remaining bound is. The k+1-th bound gives the
inclusion scores. Texts are units (a word with the spaces before it), and long units are cut where no piece
of the vocabulary reaches across; so each unit has a lattice of its own, which a task keeps for the texts
that follow, and all units of a block of texts are handled at once in arrays.

A unit of more than LONG characters without a cut (rules, padding) has no arrays of its own lattice: sums over its paths are
carried backwards from stretch to stretch, and stretches are solved again where paths are drawn.

encode_texts gives the most probable segmentation of the same lattice, decode_ids the text of ids.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import byte_values, free_name, frugal, mix64, powers

SPACE = "▁"
#: Units of more characters are cut where no piece reaches across.
UNIT = 24
#: A piece's weight is exp(-SCALE * ln(rank + SHIFT)): Zipf's law over the vocabulary's order, sharpened.
SCALE, SHIFT = 1.0, 10.0
#: Texts with a unit of more characters that cannot be cut are solved in stretches of STRETCH characters.
LONG, STRETCH = 1 << 13, 1 << 12
#: Weights are multiplied by this for each byte of text, all paths of a unit alike, which keeps sums near one.
GAIN = 8000.0
BLOCK = 1 << 20
#: Positions of units that a task keeps lattices of (some 60 bytes each) before it starts afresh.
KEPT = 2 << 20
#: Units whose lattices are built at once.
TOGETHER = 4096
#: Products that differ by a smaller share are equal.
TIED = 1e-9
_BASE = 0xC2B2AE3D27D4EB4F | 1
_INV = pow(_BASE, -1, 1 << 64)
_U = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _code_points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Vocabulary:
    """Pieces of a model file: a hash table of the pieces and their beginnings, byte ids, and each id's bytes (flat from start, width of them).

    slots holds, for the low bits of a hash, the first entry to compare (probes on the next slots follow);
    an entry has the hash, the piece's id (-1: only the beginning of pieces) and its weight.
    longest: characters of the longest piece.
    """

    slots: np.ndarray
    hashes: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    byte_ids: np.ndarray
    flat: np.ndarray
    start: np.ndarray
    width: np.ndarray
    longest: int

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        mask = np.uint64(len(self.slots) - 1)
        out = np.full(len(hashes), -1, np.int32)
        open_ = np.arange(len(hashes))
        probe = 0
        while len(open_):
            entry = self.slots[((hashes[open_] + np.uint64(probe)) & mask).astype(np.int64)]
            full = entry >= 0
            open_, entry = open_[full], entry[full]
            hit = self.hashes[entry] == hashes[open_]
            out[open_[hit]] = entry[hit]
            open_ = open_[~hit]
            probe += 1
        return out

    def edges(self, chars: np.ndarray, to_end: np.ndarray, bare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, entry) of every piece that stands in the text, shorter ones first, and where those of each
        length begin; to_end: characters left in each position's unit. Positions with bare set have none."""
        n = len(chars)
        up, down = powers(_BASE, n), powers(_INV, n)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(chars.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)))
        at, found = np.flatnonzero(~bare), []
        for k in range(1, self.longest + 1):
            at = at[to_end[at] >= k]
            entry = self.find((sums[at + k] - sums[at]) * down[at])
            at, entry = at[entry >= 0], entry[entry >= 0]  # longer pieces begin where a beginning was found
            real = self.ids[entry] >= 0
            found.append((at[real], entry[real]))
        return *(np.concatenate(x) for x in zip(*found, strict=True)), np.cumsum([0, *(len(x[0]) for x in found)])

    def parts(self, unit: str) -> list[str]:
        """The unit cut wherever no piece reaches across: its segmentations are those of the parts, side by side."""
        chars = _code_points(unit)
        n = len(chars)
        across = np.zeros(n + 1, np.int64)
        for a in range(0, n, LONG):  # pieces that begin in a stretch end at most `longest` behind it
            some = chars[a : a + LONG + self.longest]
            pos, _, begin = self.edges(some, len(some) - np.arange(len(some)), np.arange(len(some)) >= LONG)
            k = np.repeat(np.arange(1, self.longest + 1), np.diff(begin))
            np.add.at(across, a + pos + 1, 1)
            np.add.at(across, a + pos + k, -1)
        cuts = np.flatnonzero(np.cumsum(across)[:n] == 0)
        return [unit[a:b] for a, b in zip(cuts, [*cuts[1:], n], strict=True)]


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """The vocabulary of a model file, kept by each worker for its next tasks."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    byte_ids, content, found = np.zeros(256, np.int64), [b""] * n, {}
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:-1], 16)] = i
            content[i] = bytes([int(piece[3:-1], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            content[i] = piece.replace(SPACE, " ").encode()
            found[piece] = i
            for k in range(1, len(piece)):
                found.setdefault(piece[:k], -1)
    longest = max(map(len, found))
    ids = np.array([*found.values()], np.int64)
    chars = [_code_points(p) for p in found]
    at = np.cumsum([0, *map(len, chars)])
    inside = np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at))
    terms = mix64(np.concatenate(chars).astype(np.uint64) + np.uint64(1)) * powers(_BASE, longest)[inside]
    hashes = np.add.reduceat(terms, at[:-1])
    least = ids[ids >= 0].min(initial=n)
    gain = np.array([GAIN ** len(p.encode()) for p in found])
    weights = np.where(ids >= 0, (np.maximum(ids - least, 0) + SHIFT) ** -SCALE * gain, 0.0)
    slots = np.full(1 << max(4, (16 * len(ids)).bit_length()), -1, np.int32)
    for i, h in enumerate(hashes.tolist()):
        at = h & (len(slots) - 1)
        while slots[at] >= 0:
            at = (at + 1) & (len(slots) - 1)
        slots[at] = i
    width = np.array([len(c) for c in content])
    return Vocabulary(slots, hashes, ids.astype(np.int32), weights, byte_ids, np.frombuffer(b"".join(content), np.uint8), np.cumsum(width) - width, width, longest)


def units_of(vocabulary: Vocabulary, text: str, known: dict[str, list[str]]) -> list[str]:
    """The text, with the leading space that encoding adds, in units; a literal U+2581 stays a unit of bytes.

    known: the parts of long units seen before."""
    marked = " " + text
    out: list[str] = []
    for k, part in enumerate(marked.split(SPACE)):
        if k:
            out.append(f"\0{SPACE}")
        out += _U.findall(part.replace(" ", SPACE))
    if max(map(len, out)) <= UNIT:
        return out
    cut = []
    for u in out:
        if len(u) <= UNIT:
            cut.append(u)
            continue
        if u not in known:
            known[u] = vocabulary.parts(u)
        cut += known[u]
    return cut


def is_long(units: list[str]) -> bool:
    return max(map(len, units)) > LONG


class LongText:
    """The lattice of a whole text, solved in stretches: nothing is held for its positions but where it is worked on.

    windows: for the end of each stretch the sums over paths from there and the next positions to the text's end, up to a
    common factor; tops: the same for the largest product instead of the sum."""

    def __init__(self, vocabulary: Vocabulary, units: list[str]):
        self.v = vocabulary
        literal = [u[0] == "\0" for u in units]
        texts = [u[1:] if bare else u for u, bare in zip(units, literal, strict=True)]
        length = np.array([len(t) for t in texts])
        self.chars = _code_points("".join(texts))
        self.n = len(self.chars)
        self.stop = np.repeat(np.cumsum(length), length)
        self.bare = np.repeat(np.array(literal), length)
        self.starts = list(range(0, self.n, STRETCH))
        reach = vocabulary.longest + 1
        window = np.zeros(reach)
        window[0] = 1.0
        self.windows, self.tops = [window] * len(self.starts), [window] * len(self.starts)
        self.held: tuple[int, tuple] | None = None
        for j in range(len(self.starts) - 1, 0, -1):
            _, _, _, _, _, self.windows[j - 1] = self._solved(j)

    def _edges(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """at (first edge of each position from a to b), size, ids, weights, shorter pieces first."""
        end = min(self.n, b + self.v.longest)
        place = np.arange(a, end)
        pos, entry, begin = self.v.edges(self.chars[a:end], np.minimum(self.stop[a:end], end) - place, self.bare[a:end] | (place >= b))
        size = np.repeat(np.arange(1, self.v.longest + 1), np.diff(begin))
        ids, weight = self.v.ids[entry].astype(np.int64), self.v.weights[entry]
        char = self.chars[a:b]
        alone = np.ones(b - a, bool)
        alone[pos[size == 1]] = False
        rest = np.flatnonzero(alone)  # a character without a piece is its bytes
        width = 1 + (char[rest] > 0x7F) + (char[rest] > 0x7FF) + (char[rest] > 0xFFFF)
        pos, size = np.concatenate((pos, rest)), np.concatenate((size, np.ones(len(rest), np.int64)))
        ids = np.concatenate((ids, np.where(char[rest] < 0x80, self.v.byte_ids[np.minimum(char[rest], 0x7F)], -1)))
        weight = np.concatenate((weight, ((len(self.v.width) + SHIFT) ** -SCALE * GAIN) ** width))
        order = np.lexsort((size, pos))
        return np.searchsorted(pos[order], np.arange(b - a + 1)), size[order], ids[order], weight[order]

    def _solved(self, j: int, best: bool = False) -> tuple:
        """at, size, ids and chances of the edges of stretch j, the first's place in its own position's edges of the best path
        (with best), and the window at its beginning."""
        a, b = self.starts[j], min(self.n, self.starts[j] + STRETCH)
        at, size, ids, weight = self._edges(a, b)
        reach = self.v.longest + 1
        sums = np.zeros(b - a + reach)
        sums[b - a :] = (self.tops if best else self.windows)[j][: len(sums) - (b - a)]
        chance, choice = np.empty(len(size)), np.zeros(b - a, np.int64)
        for i in range(b - a - 1, -1, -1):
            s, e = at[i], at[i + 1]
            part = weight[s:e] * sums[i + size[s:e]]
            if best:
                total = part.max()
                choice[i] = s + (part >= total * (1 - TIED)).argmax()
            else:
                total = part.sum()
                chance[s:e] = part / total
            sums[i] = total
            if not 1e-60 < total < 1e60:
                sums[i : i + reach] /= total
        return at, size, ids, chance, choice, sums[:reach] / sums[0]

    def stretch(self, position: int) -> tuple[int, tuple]:
        """The number of a position's stretch, and the stretch solved (the last one is kept)."""
        j = position // STRETCH
        if self.held is None or self.held[0] != j:
            self.held = j, self._solved(j)
        return self.held

    def drawn(self, position: int, key: np.uint64) -> tuple[np.ndarray, ...]:
        """A path from a position to the end: positions, sizes, ids, log-probabilities and logarithms of what each piece leaves."""
        rows: list[tuple] = []
        while position < self.n:
            j, (at, size, ids, chance, _, _) = self.stretch(position)
            a, b = self.starts[j], min(self.n, self.starts[j] + STRETCH)
            u = _uniform(key + np.arange(position, b).astype(np.uint64) * _STEP)
            first, mine = position, []
            while position < b:
                s, e = at[position - a], at[position - a + 1]
                k = s + min(int(np.searchsorted(chance[s:e].cumsum(), u[position - first], "right")), e - s - 1)
                mine.append(k)
                position += int(size[k])
            edge = np.array(mine)
            where = np.searchsorted(at, edge, "right") - 1
            p, alone = chance[edge], at[where + 1] - at[where] == 1
            with np.errstate(divide="ignore"):
                rows.append((a + where, size[edge], ids[edge], np.log(p), np.where(alone, -np.inf, np.log1p(-np.minimum(p, 1.0)))))
        return tuple(np.concatenate(x) for x in zip(*rows, strict=True)) if rows else tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, float, float))

    def samples(self, key: np.uint64, k: int) -> list[tuple[np.ndarray, float, float]]:
        """As sample_block, for this text."""
        paths: list[dict[str, np.ndarray]] = []
        used: dict[tuple[int, int], set[int]] = {}

        def add(head: dict[str, np.ndarray] | None, begin: int, base: float, value: float, r: int) -> None:
            pos, size, ids, log_p, rest = self.drawn(begin, mix64(np.array([key + np.uint64(r)]))[0])
            before = base + np.concatenate(([0.0], np.cumsum(log_p)))
            u = _uniform((key ^ np.uint64(r * 977 + 13)) + pos.astype(np.uint64) * _STEP)
            tail = {"pos": pos, "size": size, "ids": ids, "before": before[:-1], "bound": truncated(before[:-1] + rest, value, u)}
            path = tail if head is None else {c: np.concatenate((head[c], tail[c])) for c in tail}
            paths.append(path | {"log_p": before[-1]})

        root = float(-np.log(-np.log(_uniform(np.array([key ^ np.uint64(0x51ED270B)]))))[0])
        add(None, 0, 0.0, root, 0)
        for r in range(1, k):
            tops = [p["bound"].max(initial=-np.inf) for p in paths]
            best = int(np.argmax(tops))
            if not np.isfinite(top := tops[best]):
                break
            path = paths[best]
            t = int(path["bound"].argmax())
            here = int(path["pos"][t])
            j, (at, size, ids, chance, _, _) = self.stretch(here)
            s, e = at[here - self.starts[j]], at[here - self.starts[j] + 1]
            taken = used.setdefault((best, t), {int(path["size"][t])})
            p = np.where(np.isin(size[s:e], list(taken)), 0.0, chance[s:e])
            upto = p.cumsum()
            draw_key = key ^ np.uint64((r << 40) + 0x2545F491)
            i = min(int(np.searchsorted(upto, _uniform(np.array([draw_key]))[0] * upto[-1], "right")), len(p) - 1)
            i = i if p[i] > 0 else int(p.argmax())
            taken.add(int(size[s + i]))
            left = p.sum() - p[i]
            base = float(path["before"][t])
            again = _uniform(np.array([draw_key + np.uint64(7)]))
            path["bound"][t] = truncated(np.array([base + np.log(left)]) if left > 1e-12 else np.array([-np.inf]), top, again)[0]
            head = {c: path[c][:t] for c in ("pos", "size", "ids", "before")} | {"bound": np.full(t, -np.inf)}
            step = {"pos": [here], "size": [size[s + i]], "ids": [ids[s + i]], "before": [base], "bound": [-np.inf]}
            head = {c: np.append(head[c], step[c]) for c in step}
            add(head, here + int(size[s + i]), base + float(np.log(chance[s + i])), float(top), r)
        limit = max(p["bound"].max(initial=-np.inf) for p in paths)
        score = lambda x: 1.0 if not np.isfinite(limit) else float(-np.expm1(-np.exp(min(x - limit, 700.0))))
        return [(self._whole(p["pos"], p["ids"]), float(p["log_p"]), score(p["log_p"])) for p in paths]

    def best(self) -> np.ndarray:
        """The ids of the most probable segmentation."""
        for j in range(len(self.starts) - 1, 0, -1):
            *_, self.tops[j - 1] = self._solved(j, True)
        pos, found, position = [], [], 0
        for j, a in enumerate(self.starts):
            if position >= self.n:
                break
            b = min(self.n, a + STRETCH)
            if position < b:
                _, size, ids, _, choice, _ = self._solved(j, True)
            while position < b:
                k = choice[position - a]
                pos.append(position)
                found.append(ids[k])
                position += int(size[k])
        return self._whole(np.array(pos), np.array(found))

    def _whole(self, pos: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return _with_bytes(self.v, ids, lambda b: self.chars[pos[b]])


class Lattices:
    """The lattices of the units seen so far, one row for each position of each unit and one for each edge.

    index: unit -> number. first, last: positions of each unit. edge_at: first edge of each position. Edges
    have ids (-1: bytes), size in characters, log_p of a path taking it at its position, rest: the logarithm of
    what it leaves to the others, upto: the sum of chances up to it. With search, best is each position's edge in
    the most probable path to the unit's end.
    """

    def __init__(self, vocabulary: Vocabulary, search: bool = False, kept: int = KEPT):
        self.vocabulary, self.search, self.kept = vocabulary, search, kept
        self.clear()

    def clear(self) -> None:
        self.index: defaultdict[str, int] = defaultdict(count().__next__)
        self.parts: dict[str, list[str]] = {}
        none = np.empty(0, np.int64)
        self.first, self.last, self.best, self.edge_at = none, none, none, np.zeros(1, np.int64)
        self.chars = np.empty(0, np.uint32)
        self.ids, self.size = np.empty(0, np.int32), np.empty(0, np.uint8)
        self.log_p, self.rest, self.upto = (np.empty(0, np.float32) for _ in range(3))

    def refresh(self) -> None:
        """Start afresh if more positions are held than may be."""
        if len(self.chars) > self.kept:
            self.clear()

    def sequences(self, texts: list[str]) -> list[np.ndarray]:
        """The unit numbers of each text, after lattices of new units are added."""
        self.refresh()
        return self.numbers([units_of(self.vocabulary, t, self.parts) for t in texts])

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """sequences of texts given in units, none of them long."""
        number, before = self.index.__getitem__, len(self.index)
        out = [np.fromiter(map(number, u), np.int64, len(u)) for u in texts]
        if len(self.index) > before:
            new = [*islice(self.index, before, None)]
            self._add([self._built(new[k : k + TOGETHER]) for k in range(0, len(new), TOGETHER)])
        return out

    def _add(self, built: list[dict[str, np.ndarray]]) -> None:
        """Append lattices, whose positions and edges count from their own first."""
        chars, edges = len(self.chars), self.edge_at[-1]
        self.edge_at = self.edge_at[:-1]
        more: dict[str, list[np.ndarray]] = {name: [getattr(self, name)] for name in built[0]}
        for x in built:
            for name, values in x.items():
                shift = {"first": chars, "last": chars, "best": edges, "edge_at": edges}.get(name, 0)
                more[name].append((values + shift if shift else values).astype(more[name][0].dtype, copy=False))
            chars, edges = chars + len(x["chars"]), edges + len(x["ids"])
        for name, parts in more.items():
            setattr(self, name, np.concatenate(parts))
        self.edge_at = np.append(self.edge_at, edges)

    def _built(self, units: list[str]) -> dict[str, np.ndarray]:
        """Lattices of some units. Positions with the same number of characters left in their unit stand together
        (a layer), in the order of falling unit length, so that a layer's pieces of one length lead into the front of
        an earlier layer: sums over the paths to the unit's end are slices times slices."""
        v = self.vocabulary
        literal = np.array([u[0] == "\0" for u in units], bool)
        texts = [u[1:] if b else u for u, b in zip(units, literal, strict=True)]
        chars = _code_points("".join(texts))
        length = np.array([len(t) for t in texts], np.int64)
        last = np.cumsum(length)
        n, deep = len(chars), int(length.max())
        to_end = np.repeat(last, length) - np.arange(n)
        rank = np.empty(len(units), np.int64)
        rank[np.argsort(-length, kind="stable")] = np.arange(len(units))
        wide = np.searchsorted(np.sort(-length), -np.arange(1, deep + 1), "right")  # units of a layer
        layer = np.concatenate(([0], np.cumsum(wide)))
        place = layer[to_end - 1] + np.repeat(rank, length)
        pos, entry, begin = v.edges(chars, to_end, np.repeat(literal, length))
        most_chars = max(1, int(np.flatnonzero(np.diff(begin)).max(initial=0)) + 1)
        weight = np.zeros((most_chars, n))
        ids = np.full((n, most_chars), -2, np.int32)
        for k in range(most_chars):
            p, e = pos[begin[k] : begin[k + 1]], entry[begin[k] : begin[k + 1]]
            weight[k][place[p]] = v.weights[e]
            ids[:, k][p] = v.ids[e]
        rest = np.flatnonzero(ids[:, 0] == -2)  # a character without a piece is its bytes
        char = chars[rest]
        width = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
        weight[0, place[rest]] = ((len(v.width) + SHIFT) ** -SCALE * GAIN) ** width
        ids[rest, 0] = np.where(char < 0x80, v.byte_ids[np.minimum(char, 0x7F)], -1)
        total, best, choice = np.empty(n), np.empty(n), np.zeros(n, np.uint8)
        for d in range(deep):
            at = slice(layer[d], layer[d + 1])
            sums, most = np.zeros(wide[d]), np.zeros(wide[d])
            for k in range(min(d + 1, most_chars)):
                ahead = slice(layer[d - k - 1], layer[d - k - 1] + wide[d]) if k < d else None
                if self.search:
                    part = weight[k, at] * (best[ahead] if ahead else 1.0)
                    choice[at][part > most * (1 + TIED)] = k
                    most = np.maximum(most, part)
                if ahead:
                    weight[k, at] *= total[ahead]
                sums += weight[k, at]
            weight[: d + 1, at] /= sums
            total[at], best[at] = sums, most
            for x in (total, best) if self.search else (total,):
                if x[at].max() > 1e100 or x[at].min() < 1e-100:  # scale what the next layers look at
                    scale = x[at].copy()
                    for j in range(max(0, d + 1 - most_chars), d + 1):
                        x[layer[j] : layer[j] + wide[d]] /= scale
        upto = weight.copy()
        for k in range(1, most_chars):
            upto[k] += upto[k - 1]
        edge = np.flatnonzero(ids.ravel() != -2)  # by position, shorter pieces first
        pos, k = edge // most_chars, edge % most_chars
        edge_at = np.searchsorted(pos, np.arange(n + 1))
        flat = k * n + place[pos]
        chance, upto = weight.ravel()[flat], upto.ravel()[flat]
        upto[edge_at[1:] - 1] = 2.0  # a number under one always ends at the last edge
        alone = np.diff(edge_at) == 1
        with np.errstate(divide="ignore"):
            log_p, left = np.log(chance), np.where(alone[pos], -np.inf, np.log1p(-chance))
        out = {"first": last - length, "last": last, "edge_at": edge_at[:-1], "chars": chars, "ids": ids.ravel()[edge], "size": k + 1, "log_p": log_p, "rest": left, "upto": upto}
        return out | {"best": np.searchsorted(edge, np.arange(n) * most_chars + choice[place])} if self.search else out


def _uniform(key: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from mixed keys."""
    return ((mix64(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def draw(lattices: Lattices, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A path through each piece of lattice from start to end: (which, position, edge), in order."""
    which, at = np.arange(len(start)), start
    steps = np.zeros(len(start), np.int64)
    rows: list[tuple] = []
    live = at < end
    which, at, stop, key = which[live], at[live], end[live], key[live]
    while len(which):
        u = _uniform(key + np.uint64(len(rows) * int(_STEP) % (1 << 64)))
        edge = lattices.edge_at[at]
        more = np.flatnonzero(u > lattices.upto[edge])
        while len(more):
            edge[more] += 1
            more = more[u[more] > lattices.upto[edge[more]]]
        rows.append((which, at, edge))
        steps[which] += 1
        at = at + lattices.size[edge]
        live = at < stop
        which, at, stop, key = which[live], at[live], stop[live], key[live]
    first = np.cumsum(steps) - steps
    out = np.empty((2, int(steps.sum())), np.int64)
    for k, (w, p, e) in enumerate(rows):
        out[0, first[w] + k], out[1, first[w] + k] = p, e
    return np.repeat(np.arange(len(start)), steps), out[0], out[1]


def truncated(location: np.ndarray, most: float | np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers at a location, given that they are at most `most`."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        g = location - np.log(np.exp(location - most) - np.log(u))
    return np.where(np.isneginf(location), -np.inf, np.minimum(g, most))


@dataclass
class Path:
    """A sampled path: positions, edges and units of its pieces, the log-probability before each, and the
    bound of what each piece leaves open."""

    at: np.ndarray
    edge: np.ndarray
    unit: np.ndarray
    before: np.ndarray
    bound: np.ndarray
    log_p: float
    value: float


def sample_block(lattices: Lattices, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text its samples, best perturbed first: (piece ids, log-probability, inclusion score)."""
    lattices.refresh()
    units = [units_of(lattices.vocabulary, t, lattices.parts) for t in texts]
    long = [i for i, u in enumerate(units) if is_long(u)]
    if long:
        rest = [i for i in range(len(texts)) if i not in set(long)]
        lattices.parts.clear()
        out = dict(zip(rest, _sample_units(lattices, [units[i] for i in rest], keys[rest], k), strict=True)) if rest else {}
        return [out[i] if i in out else LongText(lattices.vocabulary, units[i]).samples(keys[i], k) for i in range(len(texts))]
    return _sample_units(lattices, units, keys, k)


def _sample_units(lattices: Lattices, units: list[list[str]], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    sequences = lattices.numbers(units)
    n = len(units)
    # round 0: a path through every unit of every text
    size = np.array([len(s) for s in sequences])
    flat = np.concatenate(sequences) if n else np.empty(0, np.int64)
    doc = np.repeat(np.arange(n), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    paths: list[list[Path]] = [[] for _ in range(n)]
    taken: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(n)]
    root = -np.log(-np.log(_uniform(keys ^ np.uint64(0x51ED270B))))
    _extend(lattices, paths, range(n), [None] * n, doc, place, lattices.first[flat], lattices.last[flat], keys, 0, root)
    for r in range(1, k):
        starts, ends, docs, places, heads, who, values = [], [], [], [], [], [], []
        for d in range(n):
            tops = [p.bound.max(initial=-np.inf) for p in paths[d]]
            best = int(np.argmax(tops)) if tops else 0
            if not tops or not np.isfinite(top := tops[best]):
                continue
            path = paths[d][best]
            t = int(path.bound.argmax())
            a, b = lattices.edge_at[path.at[t] : path.at[t] + 2]
            used = taken[d].setdefault((best, t), [int(path.edge[t])])
            p = np.exp(lattices.log_p[a:b].astype(np.float64))
            p[np.array(used) - a] = 0
            key = keys[d] ^ np.uint64((r << 40) + 0x2545F491)
            at = np.cumsum(p)
            i = int(np.searchsorted(at, _uniform(np.array([key]))[0] * at[-1], "right"))
            i = i if i < len(p) and p[i] > 0 else int(p.argmax())
            used.append(int(a) + i)
            p[i] = 0
            left = p.sum()
            again = _uniform(np.array([key + np.uint64(7)]))
            path.bound[t] = truncated(np.array([path.before[t] + np.log(left)]) if left > 1e-12 else np.array([-np.inf]), top, again)[0]
            u = int(path.unit[t])
            tail = sequences[d][u + 1 :]
            starts += [np.array([path.at[t] + int(lattices.size[a + i])]), lattices.first[tail]]
            ends += [lattices.last[sequences[d][u : u + 1]], lattices.last[tail]]
            docs.append(np.full(len(tail) + 1, len(who)))
            places.append(np.arange(u, u + 1 + len(tail)))
            heads.append((path, t, int(a) + i))
            who.append(d)
            values.append(top)
        if not who:
            break
        _extend(lattices, paths, who, heads, np.concatenate(docs), np.concatenate(places), np.concatenate(starts), np.concatenate(ends), keys, r, np.array(values))
    out = []
    for d in range(n):
        limit = max((p.bound.max(initial=-np.inf) for p in paths[d]), default=-np.inf)
        samples = []
        for p in paths[d]:
            score = 1.0 if not np.isfinite(limit) else float(-np.expm1(-np.exp(min(p.log_p - limit, 700.0))))
            samples.append((_ids(lattices, p.at, p.edge), p.log_p, score))
        out.append(samples)
    return out


def _extend(lattices, paths, who, heads, doc, place, start, end, keys, r, values) -> None:
    """Draw the rest of each text's new path behind its head and append the path, with bounds of what it leaves open.

    Numbers are hashed from the text's key, the round, and the unit's and the piece's place in the text alone.
    """
    who = np.asarray(who, np.int64)
    key = mix64(keys[who[doc]] + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(r)) if len(doc) else np.empty(0, np.uint64)
    w, at, edge = draw(lattices, start, end, key)
    step_doc = doc[w]
    cut = np.searchsorted(step_doc, np.arange(len(who) + 1))
    log_p, rest = lattices.log_p[edge].astype(np.float64), lattices.rest[edge]
    unit = place[w]
    nth = np.arange(len(at), dtype=np.uint64) - cut[step_doc].astype(np.uint64)
    u = _uniform((keys[who[step_doc]] ^ np.uint64(r * 977 + 13)) + (nth + np.uint64(1)) * _STEP)
    base = np.array([0.0 if h is None else h[0].before[h[1]] + float(lattices.log_p[h[2]]) for h in heads])
    sums = np.concatenate(([0.0], np.cumsum(log_p)))
    before = sums[:-1] - sums[cut[step_doc]] + base[step_doc]
    bound = truncated(before + rest, values[step_doc], u)
    last = base + sums[cut[1:]] - sums[cut[:-1]]
    for i, (d, a, b) in enumerate(zip(who.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        parts = at[a:b], edge[a:b], unit[a:b], before[a:b], bound[a:b]
        if heads[i] is not None:
            path, t, chosen = heads[i]
            front = path.at[: t + 1], np.append(path.edge[:t], chosen), path.unit[: t + 1], path.before[: t + 1], np.full(t + 1, -np.inf)
            parts = tuple(np.concatenate(x) for x in zip(front, parts, strict=True))
        paths[d].append(Path(*parts, float(last[i]), float(values[i])))


def _ids(lattices: Lattices, at: np.ndarray, edge: np.ndarray) -> np.ndarray:
    return _with_bytes(lattices.vocabulary, lattices.ids[edge], lambda b: lattices.chars[at[b]])


def _with_bytes(vocabulary: Vocabulary, ids: np.ndarray, char: Callable[[int], int]) -> np.ndarray:
    """ids with the byte ids of the characters (by place) where they are -1."""
    bare = np.flatnonzero(ids == -1)
    if not len(bare):
        return ids
    parts, done = [], 0
    for b in bare:
        raw = chr(char(b)).encode("utf-8", "surrogatepass")
        parts += [ids[done:b], vocabulary.byte_ids[np.frombuffer(raw, np.uint8)]]
        done = b + 1
    return np.concatenate([*parts, ids[done:]])


def best_block(lattices: Lattices, texts: list[str]) -> list[np.ndarray]:
    """The ids of each text's most probable segmentation (of equal ones the one with the shorter first piece)."""
    lattices.refresh()
    units = [units_of(lattices.vocabulary, t, lattices.parts) for t in texts]
    sequences = lattices.numbers([[] if is_long(u) else u for u in units])
    held: dict[int, np.ndarray] = {}

    def of_unit(u: int) -> np.ndarray:
        at, path = int(lattices.first[u]), []
        while at < lattices.last[u]:
            path.append((at, e := int(lattices.best[at])))
            at += int(lattices.size[e])
        return _ids(lattices, *np.array(path).T)

    out = []
    for s, own in zip(sequences, units, strict=True):
        if is_long(own):
            out.append(LongText(lattices.vocabulary, own).best())
            continue
        for u in np.unique(s).tolist():
            if u not in held:
                held[u] = of_unit(u)
        out.append(np.concatenate([held[u] for u in s.tolist()]))
    return out


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> bytes:
    """The text, in UTF-8, that a sequence of ids stands for, without the leading space that encoding adds."""
    width = vocabulary.width[ids]
    start = np.cumsum(width) - width
    raw = vocabulary.flat[np.repeat(vocabulary.start[ids] - start, width) + np.arange(width.sum())].tobytes()
    return raw.removeprefix(b" ")


def _blocks(texts: list[str], block: int) -> Iterator[tuple[int, int]]:
    """Spans of texts with about block characters each."""
    sizes = np.cumsum([len(t) + 200 for t in texts])
    inner = np.searchsorted(sizes, np.arange(block, sizes[-1] if len(sizes) else 0, block)) + 1
    cuts = np.unique(np.concatenate(([0], inner, [len(texts)])).clip(max=len(texts)))
    return zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _list_array(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _nth(met: Counter, row: tuple[int, int]) -> int:
    """How often row was met before."""
    met[row] += 1
    return met[row] - 1


def sample_segmentations(docs: DataFrame, model_path: str, *, k: int = 2, seed: int = 11, block: int = BLOCK, kept: int = KEPT, id_col: str = "doc_id", text_col: str = "text", apart: bool = False) -> DataFrame:
    """k distinct sampled segmentations of each whole text: id_col, rank, ids, n_pieces, log_prob, inclusion, exact.

    rank counts from 1 by perturbed log-probability; a text with fewer than k segmentations gives all of
    them, with inclusion 1. exact tells that decoding the ids gives the text back. Samples depend on seed
    and id only; rows that repeat an id and text draw alike. With apart they are brought together and numbered, and
    draw by id and number. A null id is hashed as the word null. Null and empty texts are the one segmentation of the leading
    space. Other columns are ignored; an empty table gives an empty result. The file at model_path must be on
    every executor. block: characters handled at once; kept: positions of lattices that a task keeps (neither
    changes a result).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "rank", "ids", "n_pieces", "log_prob", "inclusion", "exact"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices, met = Lattices(load(model_path), kept=kept), Counter()
        for batch in batches:
            texts = [b.decode("utf-8", "replace") for b in byte_values(batch.column(2))]
            keys = batch.column(1).to_numpy().view(np.uint64)
            if apart:
                keys = keys + np.array([_nth(met, x) for x in zip(keys.tolist(), batch.column(3).to_pylist(), strict=True)], np.uint64) * _STEP
            for a, b in _blocks(texts, block):
                got = sample_block(lattices, texts[a:b], keys[a:b], k)
                row = [i for i, s in enumerate(got) for _ in s]
                flat = [x for s in got for x in s]
                ids = _list_array([x[0] for x in flat])
                exact = [decode(lattices.vocabulary, x[0]) == texts[a + i].encode() for i, x in zip(row, flat, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(row, pa.int64())), pa.array([j + 1 for s in got for j in range(len(s))], pa.int32()), ids,
                        pa.array([len(x[0]) for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.float64()), pa.array([x[2] for x in flat], pa.float64()), pa.array(exact, pa.bool_()),
                    ],
                    names,
                )

    parts = [F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))]
    rows = docs.select(F.col(id_col), F.xxhash64(*parts).alias("__key"), F.col(text_col).cast("binary").alias("__text"))
    if apart:
        rows = rows.withColumn("__hash", F.xxhash64("__text")).repartition("__key", "__hash")
    return rows.mapInArrow(frugal(run), f"`{id_col}` {kind}, rank int, ids array<int>, n_pieces long, log_prob double, inclusion double, exact boolean")


def encode_texts(docs: DataFrame, model_path: str, *, text_col: str = "text", ids_col: str = "ids", block: int = BLOCK) -> DataFrame:
    """docs with ids_col added: the ids of each whole text's most probable segmentation.

    A null text has null ids; an empty one is the leading space. If docs has a column named as the added one,
    underscores are appended to the added name. An empty table stays empty.
    """
    ids_col = free_name(docs, ids_col)
    at, names = docs.columns.index(text_col), [*docs.columns, ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(load(model_path), search=True)
        for batch in batches:
            texts = [b.decode("utf-8", "replace") for b in byte_values(batch.column(at))]
            for a, b in _blocks(texts, block):
                some, none = batch.slice(a, b - a), batch.column(at).slice(a, b - a).is_null()
                ids = _list_array(best_block(lattices, texts[a:b]))
                yield pa.RecordBatch.from_arrays([*some.columns, pc.if_else(none, pa.scalar(None, ids.type), ids)], names)

    return docs.mapInArrow(frugal(run), StructType([*docs.schema.fields, StructField(ids_col, ArrayType(IntegerType()))]))


def decode_ids(df: DataFrame, model_path: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with text_col added: the text that each list of ids stands for, without the leading space that encoding adds.

    Null ids give a null text, an empty list an empty one; null, negative and unknown ids stand for nothing. If df
    has a column named as the added one, underscores are appended to the added name. An empty table stays empty.
    """
    text_col = free_name(df, text_col)
    at, names = df.columns.index(ids_col), [*df.columns, text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(model_path)
        for batch in batches:
            texts = []
            for ids in batch.column(at):
                known = np.array([i for i in ids.as_py() or () if i is not None and 0 <= i < len(vocabulary.width)], np.int64)
                texts.append(decode(vocabulary, known).decode("utf-8", "replace") if ids.is_valid else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return df.mapInArrow(frugal(run), StructType([*df.schema.fields, StructField(text_col, StringType())]))
