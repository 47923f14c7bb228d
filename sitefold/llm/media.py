"""Media columns: WAV bytes, short-time Fourier transforms, and spectral-peak pair fingerprints.

A WAV column is read by the wave module (8, 16, 24 and 32 bit, channels averaged). Frames of FRAME samples, HOP apart
and Hann-windowed, are transformed; a peak is a bin above its frame's mean that is the highest among NEAR bins and
frames around it. Each peak is paired with the FAN next ones within SPAN frames; a pair is coded as (first bin, second
bin, frames between) in one number, and stored with the time of its first peak: array<struct<t: int, code: int>>, in
order of time and code.

The tables hold no recordings, so tone_column() makes some: each number of an embedding is a tone of TONE seconds.

Defined results: null bytes, and bytes that aren't a WAV file, have null duration, rate and fingerprint, as have those
with a rate of 0, without channels or with samples of more than 32 bits; recordings shorter than a frame, or silent ones,
have an empty fingerprint; long ones are read whole; neighbours that are equally high are peaks each; null or empty
embeddings have null bytes, null and non-finite numbers in one are silence; repeated rows are read each; an empty table gives
an empty table; other columns stay, and new ones that would clash get an underscore in front.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name

RATE, TONE = 8000, 0.02
FRAME, HOP, NEAR, FAN, SPAN = 256, 128, 3, 5, 32


def tone(values: list[float | None] | None) -> bytes | None:
    """A 16-bit mono WAV file with one tone for each value: -1 to 1 are spread over 200 to 3,800 Hz."""
    if not values:
        return None
    v = np.array([np.nan if x is None else x for x in values], np.float64)
    loud = np.isfinite(v)
    hertz = 2000 + 1800 * np.tanh(3 * np.where(loud, v, 0))
    t = np.arange(int(RATE * TONE)) / RATE
    sound = np.sin(2 * np.pi * hertz[:, None] * t) * loud[:, None] * 20000
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes(np.round(sound.ravel()).astype("<i2").tobytes())
    return out.getvalue()


def samples(data: bytes) -> tuple[np.ndarray, int]:
    """Samples between -1 and 1, and the rate."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        if rate <= 0 or channels < 1 or not 1 <= width <= 4:
            raise ValueError("no such recording")
        raw = w.readframes(w.getnframes())
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
        x = x / 8388608
    else:
        x = np.frombuffer(raw, "<i2" if width == 2 else "<i4").astype(np.float64) / (1 << 8 * width - 1)
    return x.reshape(-1, channels).mean(1), rate


def spectrogram(x: np.ndarray) -> np.ndarray:
    """Magnitudes by frame and bin, in steps that hide the last digits of a transform."""
    n = (len(x) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, FRAME // 2 + 1))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
    return np.round(np.abs(np.fft.rfft(frames * np.hanning(FRAME))), 6)


def peaks(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the peaks, in order of both."""
    n, m = s.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.full((n + 2 * NEAR, m + 2 * NEAR), -1.0)
    padded[NEAR : NEAR + n, NEAR : NEAR + m] = s
    best = padded
    for axis in (0, 1):  # the highest of 1, 2, 4, ... in a row, and then of all
        width = 1
        while width < 2 * NEAR + 1:
            step = min(width, 2 * NEAR + 1 - width)
            best = np.maximum(best[:-step], best[step:]) if axis == 0 else np.maximum(best[:, :-step], best[:, step:])
            width += step
    return np.nonzero((s == best) & (s > s.mean(1, keepdims=True)) & (s > 1e-4))


def pair_codes(t: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of the pairs."""
    times, codes = [], []
    for k in range(1, FAN + 1):
        if len(t) <= k:
            break
        gap = t[k:] - t[:-k]
        ok = gap <= SPAN
        times.append(t[:-k][ok])
        codes.append((f[:-k][ok] << 16) | (f[k:][ok] << 6) | gap[ok])
    if not times:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, a))
    return a[order], c[order]


def fingerprint(data: bytes | None):
    """(seconds, rate, times, codes), or None."""
    if data is None:
        return None
    try:
        x, rate = samples(data)
    except (wave.Error, EOFError, ValueError):
        return None
    t, c = pair_codes(*peaks(spectrogram(x)))
    return len(x) / rate, rate, t, c


def _sliced(batches):
    """A few rows at a time, as recordings are large; an empty batch passes."""
    for b in batches:
        for a in range(0, max(b.num_rows, 1), 256):
            yield b.slice(a, 256)


def with_tones(df: DataFrame, values: str = "embedding", out: str = "wav", keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in keep) and a WAV file of each embedding."""
    names = df.columns if keep is None else keep
    name, given = free_name(names, out), free_name(names, "_values")
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(name, T.BinaryType())])

    def run(batches):
        for b in _sliced(batches):
            made = pa.array([tone(v) for v in b.column(b.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=[*names, name])

    return df.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{values}`").alias(given)).mapInArrow(run, schema)


def with_fingerprints(df: DataFrame, wav: str = "wav", keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in keep) and seconds, rate, fingerprint of each WAV file."""
    names = df.columns if keep is None else keep
    new = []
    for x in ("seconds", "rate", "fingerprint"):
        new.append(free_name([*names, *new], x))
    given = free_name([*names, *new], "_wav_bytes")
    pairs = T.ArrayType(T.StructType([T.StructField("t", T.IntegerType(), False), T.StructField("code", T.IntegerType(), False)]), False)
    schema = T.StructType([*(df.schema[c] for c in names), *(T.StructField(n, t) for n, t in zip(new, (T.DoubleType(), T.IntegerType(), pairs)))])

    def run(batches):
        for b in _sliced(batches):
            found = [fingerprint(x) for x in b.column(b.num_columns - 1).to_pylist()]
            none = np.array([x is None for x in found], bool)
            size = np.array([0 if x is None else len(x[2]) for x in found], np.int64)
            t, c = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found if x is not None)]).astype(np.int32) for k in (2, 3))
            flat = pa.StructArray.from_arrays([pa.array(t), pa.array(c)], fields=[pa.field("t", pa.int32(), False), pa.field("code", pa.int32(), False)])
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array(none))
            seconds = pa.array([None if x is None else x[0] for x in found], pa.float64())
            rate = pa.array([None if x is None else x[1] for x in found], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], seconds, rate, lists], names=[*names, *new])

    return df.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{wav}`").alias(given)).mapInArrow(run, schema)


def fingerprint_embeddings(embeddings: DataFrame) -> DataFrame:
    """vec_id, seconds, rate, fingerprint of the recording of every embedding."""
    return with_fingerprints(with_tones(embeddings, keep=["vec_id"]), keep=["vec_id"])
