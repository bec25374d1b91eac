"""Vector code compression: product codes whose codebooks are fitted by Lloyd's method with Elkan's bounds.

A vector's components become integers and are cut into equal parts; each part position has a codebook of its own.
All distances are whole squared numbers, so assignments, means and errors are exact. After the first assignment
each part of each vector keeps an upper bound of the distance to its entry and a lower bound for every entry, in a
table that is written anew in each round. When entries move, bounds move with them: the upper bound by what the
assigned entry moved, each lower bound by what its entry moved. An entry is left out only where a bound shows
that it is strictly farther than the assigned one (its lower bound, or half the way between the two entries, is
above the upper bound), so ties are always decided on whole numbers, and to the lower index.

A lower bound is one byte, rounded down to a multiple of STEP: 16 parts of 64 entries take 1 KB a vector. The
driver holds the codebooks and their sums, which do not grow with the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, small_side, written

#: Components become floor(SCALE * x).
SCALE = 256
#: Components beyond this size count as this size, so that errors fit in 64 bits: half a million as a vector's component.
LARGEST = 1 << 27
#: Lower bounds are kept as multiples of this many units of distance, up to 255 of them: a cut at 255 only prunes less.
STEP = 4.0
#: Vectors that a task handles at once.
ROWS = 2048
_SLACK = 1e-9


@dataclass
class Codebooks:
    """entries: parts x entries x components, whole numbers."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def moved(self, to: Codebooks) -> np.ndarray:
        """How far each entry is from its place in `to`, rounded up."""
        return _root((to.entries - self.entries) ** 2) * (1 + _SLACK)

    def apart(self) -> np.ndarray:
        """Half the distance of any two entries of a part, rounded down."""
        e = self.entries
        return _root((e[:, :, None] - e[:, None]) ** 2) * (0.5 - _SLACK)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.sum(-1).astype(np.float64))


def assigned_all(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every distance of n x parts x components: (codes, squared distances, lower bounds as bytes)."""
    n, parts, _ = x.shape
    codes, error = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
    lower = np.empty((n, parts, books.entries.shape[1]), np.uint8)
    for p in range(parts):
        d = np.zeros((n, books.entries.shape[1]), np.int64)
        for k in range(x.shape[2]):
            d += (x[:, p, k, None] - books.entries[p, :, k]) ** 2
        codes[:, p] = d.argmin(1)
        error[:, p] = d[np.arange(n), codes[:, p]]
        lower[:, p] = _bytes(np.sqrt(d.astype(np.float64)) * (1 - _SLACK))
    return codes, error, lower


def _bytes(bound: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(bound / STEP), 0, 255).astype(np.uint8)


def reassigned(x: np.ndarray, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: Codebooks, new: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """codes, squared distances and lower bounds after the entries moved from old to new, and how many distances that took.

    upper: distances to the assigned entries of old, rounded up; lower: bounds as bytes. Both are moved first."""
    n, parts, _ = x.shape
    move, half = old.moved(new), new.apart()
    codes, error, lower, took = codes.copy(), np.empty((n, parts), np.int64), lower.copy(), 0
    every = np.arange(n)
    for p in range(parts):
        e, a = new.entries[p], codes[:, p]
        bound = lower[:, p] * STEP - move[p]
        above = upper[:, p] + move[p][a]
        open_ = (bound <= above[:, None]) & (half[p][a] <= above[:, None])
        open_[every, a] = False
        some = np.flatnonzero(open_.any(1))
        # the bound of the parts that stay open is tightened to the distance itself
        exact = ((x[:, p] - e[a]) ** 2).sum(1)
        above[some] = np.sqrt(exact[some].astype(np.float64)) * (1 + _SLACK)
        open_[some] &= (bound[some] <= above[some][:, None]) & (half[p][a[some]] <= above[some][:, None])
        row, entry = np.nonzero(open_)
        far = ((x[row, p] - e[entry]) ** 2).sum(1)
        took += len(row) + n
        best, which = exact.copy(), a.copy()
        np.minimum.at(best, row, far)
        tied = far == best[row]  # the lowest index of the nearest entries, the assigned one among them
        which[best < exact] = len(e)
        np.minimum.at(which, row[tied], entry[tied])
        bound[row, entry] = np.sqrt(far.astype(np.float64)) * (1 - _SLACK)
        bound[every, a] = np.sqrt(exact.astype(np.float64)) * (1 - _SLACK)
        codes[:, p], error[:, p], lower[:, p] = which, best, _bytes(bound)
    return codes, error, lower, took


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor has null or non-finite components."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: finite(c.cast("double"))), F.lit(False))


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> DataFrame:
    """id, label, x (whole components) of the rows that fit: see compress_vectors."""
    scaled = lambda c: F.least(F.greatest(F.floor(c.cast("double") * SCALE), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")
    v = F.col(vector_col)
    kept = rows.where(usable(v)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(v, scaled).alias("x"))
    return kept.where((F.size("x") > 0) & (F.size("x") % parts == 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    flat = np.ascontiguousarray(rows).reshape(len(rows), -1).view(np.uint8)
    ends = np.arange(len(rows) + 1, dtype=np.int64) * flat.shape[1]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(flat)]).cast(pa.binary())


def _unpacked(column: pa.Array, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def assign(state: DataFrame, old: Codebooks | None, new: Codebooks, keep_bounds: bool) -> DataFrame:
    """state (id, label, x, and with old: code, upper, lower) with code and error by new, and with keep_bounds the bounds of all entries."""
    parts, entries, width = new.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            x = _matrix(b.column(2), parts * width).astype(np.int64).reshape(-1, parts, width)
            if old is None:
                codes, error, lower = assigned_all(x, new)
            else:
                codes = _unpacked(b.column(3), np.uint8, (parts,)).astype(np.int64)
                upper = _matrix(b.column(4), parts)
                codes, error, lower, _ = reassigned(x, codes, upper, _unpacked(b.column(5), np.uint8, (parts, entries)), old, new)
            out = [*b.columns[:3], _binary(codes.astype(np.uint8))]
            if keep_bounds:
                upper = np.nextafter((np.sqrt(error.astype(np.float64)) * (1 + _SLACK)).astype(np.float32), np.float32(np.inf))
                out += [pa.FixedSizeListArray.from_arrays(pa.array(upper.ravel()), parts).cast(pa.list_(pa.float32())), _binary(lower)]
            else:
                out.append(pa.array(error.sum(1), pa.int64()))
            yield pa.RecordBatch.from_arrays(out, names)

    last = "upper array<float>, lower binary" if keep_bounds else "error long"
    names = ["id", "label", "x", "code", *(["upper", "lower"] if keep_bounds else ["error"])]
    kinds = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    given = ["id", "label", "x"] if old is None else ["id", "label", "x", "code", "upper", "lower"]
    return state.select(*given).mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, x array<int>, code binary, {last}")


def moved_means(state: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry at the floored mean of its parts; entries without a part stay. Tasks send one row for each entry."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for b in _blocks(batches):
            x = _matrix(b.column(0), parts * width).astype(np.int64).reshape(-1, width)
            at = (_unpacked(b.column(1), np.uint8, (parts,)).astype(np.int64) + np.arange(parts) * entries).ravel()
            count += np.bincount(at, minlength=len(count))
            np.add.at(sums, at, x)
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), *(pa.array(sums[used, k]) for k in range(width))], names)

    names = ["entry", "n", *(f"s{k}" for k in range(width))]
    found = state.select("x", "code").mapInArrow(run, ", ".join(f"{c} long" for c in names)).groupBy("entry").agg(*(F.sum(c).alias(c) for c in names[1:]))
    out = books.entries.reshape(-1, width).copy()
    for e, n, *s in found.collect():  # at most parts x entries rows
        out[e] = [v // n for v in s]
    return Codebooks(out.reshape(books.entries.shape))


def compress_vectors(rows: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per usable vector: id, code (two hex digits a part), error, label_error, codebooks_sha256.

    Codebooks start from the vectors with the smallest ids and move `rounds` times. Rows whose vector is null or
    has a null or non-finite component are left out, as are those whose length is no multiple of parts (empty ones
    too) or not that of the kept row with the smallest id. Null ids come after all others; rows that repeat an id are
    rows of their own, started from in the order of their components. With fewer kept rows than entries there are
    as many entries as rows. Nearest entries that tie give the lower index. label_error sums errors over equal
    labels, nulls together. Components beyond LARGEST count as LARGEST. Other columns are ignored, whatever their
    names; a table without usable rows gives an empty result.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    spark = rows.sparkSession
    kept = whole_vectors(rows, id_col, vector_col, label_col, parts)
    smallest = lambda of, n: of.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(n).collect()
    size = len(one[0]["x"]) if (one := smallest(kept, 1)) else parts
    state = kept.where(F.size("x") == size)
    first = smallest(state, entries)
    start = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, size // parts)
    old, books = None, Codebooks(start.transpose(1, 0, 2))
    if not first:
        return spark.createDataFrame([], f"id {kept.schema['id'].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string")
    with scratch(spark):
        for k in range(rounds):
            before, state = state, written(assign(state, old, books, True), "bounds")
            if k:
                discard(before)
            old, books = books, moved_means(state, books)
        out = written(assign(state, old, books, False).select("id", "label", "code", "error"), "codes", keep=True)
    totals = out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = out.join(small_side(totals), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
