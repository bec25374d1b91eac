"""Media columns: payloads stored as WAV, short-time Fourier transforms and spectral-peak pair fingerprints.

A payload becomes 8-bit mono samples written and read by the wave module. Frames of FRAME samples, HOP
apart, are transformed; in each of a few frequency bands a frame's strongest bin is a peak when it stands
above the band in the frames around it. Each peak is paired with the next peaks in time; a pair's code
holds both frequencies and their distance, and pairs are stored as time-coded arrays.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values

RATE = 8000
FRAME = 256
HOP = 128
#: The edges of the frequency bands, in bins of the transform.
BANDS = (2, 10, 24, 48, 80, 129)
#: A peak is paired with so many of the peaks that follow it, at most SPAN frames later.
FAN_OUT = 3
SPAN = 63
#: Frames transformed at once; long payloads are taken in blocks of this many.
BLOCK = 1 << 13

_WINDOW = np.hanning(FRAME).astype(np.float32)


def pad(data: bytes, to: int = 64) -> bytes:
    """data with zero bytes appended, up to a positive multiple of `to`."""
    return data + bytes(-len(data) % to if data else to)


def framed(samples: int) -> int:
    """Frames of a payload: a hop of silence or more follows the last sample, so that no sample is left out."""
    return max(1, -(-samples // HOP) + 2 - FRAME // HOP)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def band_maxima(samples: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """For frames first to last-1: the strongest bin of each band and its power."""
    at = np.arange(first, last)[:, None] * HOP + np.arange(FRAME)
    power = np.abs(np.fft.rfft((samples[at].astype(np.float32) - 128) * _WINDOW, axis=1)) ** 2
    cut = [(lo + power[:, lo:hi].argmax(1), power[:, lo:hi].max(1)) for lo, hi in zip(BANDS, BANDS[1:], strict=False)]
    return np.stack([c[0] for c in cut], 1), np.stack([c[1] for c in cut], 1)


def peaks(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the peaks in time order; payloads are padded with silence (128) to whole frames."""
    samples = np.frombuffer(payload, np.uint8)
    n = framed(len(samples))
    samples = np.concatenate((samples, np.full((n - 1) * HOP + FRAME - len(samples), 128, np.uint8)))
    parts = [band_maxima(samples, k, min(k + BLOCK, n)) for k in range(0, n, BLOCK)]
    bins, power = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    around = np.pad(power, ((2, 2), (0, 0)))
    local = np.maximum.reduce([around[k : k + n] for k in range(5)])
    frame, band = np.nonzero((power >= local) & (power > 0))
    return frame, bins[frame, band]


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (frames) and codes of the peak pairs: code = bin << 14 | later bin << 6 | frames between."""
    t, f = peaks(payload)
    times, codes = [], []
    for k in range(1, FAN_OUT + 1):
        dt = t[k:] - t[:-k]
        near = dt <= SPAN
        times.append(t[:-k][near])
        codes.append((f[:-k][near] << 14) | (f[k:][near] << 6) | dt[near])
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return time[order].astype(np.int32), code[order].astype(np.int32)


_OUT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fp_time array<int>, fp_code array<int>"


def _described(data: bytes) -> tuple:
    media = to_wav(pad(data))
    payload = from_wav(media)
    time, code = fingerprint(payload)
    digest = hashlib.sha256(time.astype("<i4").tobytes() + code.astype("<i4").tobytes()).hexdigest()
    feature = f"{framed(len(payload))}:{len(time)}:{digest}"
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, time, code


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_rows: int = 256) -> DataFrame:
    """One row per row of docs: id_col, the stored form's sizes and digests, the fingerprint and its digest.

    A null text is empty; an empty text stores 64 zero bytes. Equal texts give equal values; repeated
    rows are described one by one; other columns are ignored. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for k in range(0, big.num_rows, batch_rows):
                batch = big.slice(k, batch_rows)
                rows = list(zip(*[_described(v) for v in byte_values(batch.column(1))], strict=True))
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                flat = [pa.array(v, t) for v, t in zip(rows[:7], types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *flat, _lists(rows[7]), _lists(rows[8])], names)

    names = [id_col, *[x.split()[0] for x in _OUT.split(", ")]]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, {_OUT}")
