"""Media columns: audio kept as WAV, short-time spectra, and fingerprints of paired spectral peaks as time-coded arrays."""

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

from .common import small_batches

RATE = 8000
FRAME, HOP = 192, 96
#: A peak pairs with so many later ones, at most so many frames on.
FAN, REACH = 3, 63
#: Frames whose spectra are held at once.
SLAB = 2048
#: Payloads are padded with spaces to a multiple of this.
PAD = 192
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (-len(data) % PAD or (0 if data else PAD))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as w:
        return w.readframes(w.getnframes())


def spectra(samples: np.ndarray) -> np.ndarray:
    """Magnitudes [frames, bins]; input shorter than a frame is filled with silence."""
    x = (samples.astype(np.float32) - 128) / 128
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    return np.abs(np.fft.rfft(frames * _WINDOW, axis=1)).astype(np.float32)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(frame, bin, frames): each frame's loudest bin, the lowest of equals, where neighbours aren't louder in it."""
    frames = max(1, (len(samples) - FRAME) // HOP + 1)
    at, bins = [], []
    for lo in range(0, frames, SLAB):
        hi = min(frames, lo + SLAB)
        a, b = max(0, lo - 1), min(frames, hi + 1)
        s = spectra(samples[a * HOP : (b - 1) * HOP + FRAME])
        own = s[lo - a : hi - a]
        top = own[:, 2:].argmax(1) + 2
        rows = np.arange(lo - a, hi - a)
        here = s[rows, top]
        ok = (here > 0) & (here >= s[np.maximum(rows - 1, 0), top]) & (here >= s[np.minimum(rows + 1, len(s) - 1), top])
        at.append(np.flatnonzero(ok) + lo)
        bins.append(top[ok])
    return np.concatenate(at), np.concatenate(bins), frames


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(time codes, hashes, peaks, frames): hash = first bin, second bin, frames between; ordered by (time, hash)."""
    t, f, frames = peaks(samples)
    when, code = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for j in range(1, FAN + 1):
        gap = t[j:] - t[:-j]
        near = gap <= REACH
        when.append(t[:-j][near])
        code.append((f[:-j][near] << 16) | (f[j:][near] << 8) | gap[near])
    when, code = np.concatenate(when), np.concatenate(code)
    order = np.lexsort((code, when))
    return when[order].astype(np.int32), code[order].astype(np.int32), len(t), frames


_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, fp_time array<int>, fp_hash array<int>"
)


def _columns(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = payload(text.as_py())
                n = len((text.as_py() or "").encode("utf-8", "surrogatepass"))
                media = to_wav(data)
                back = from_wav(media)
                when, code, loud, frames = fingerprint(np.frombuffer(back, np.uint8))
                digest = hashlib.sha256(when.tobytes() + code.tobytes()).hexdigest()[:16]
                row = (
                    doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media),
                    hashlib.sha256(media).hexdigest(), f"frames={frames};peaks={loud};pairs={len(code)};id={digest}", when, code,
                )
                out.append((*row, media) if keep else row)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            types += [pa.list_(pa.int32()), pa.list_(pa.int32())] + [pa.binary()] * keep
            names = [c.split()[0] for c in _SCHEMA.split(", ")] + ["media"] * keep
            cols = list(zip(*out, strict=True)) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def media_columns(df: DataFrame, keep: bool = True) -> DataFrame:
    """One row per row of df: sizes and digests of payload and WAV, feature, fingerprint arrays; with keep, the WAV too.

    Every value but doc_id depends on the text alone.

    * null or empty text: a payload of 192 spaces; n_bytes 0. A steady tone or silence may have no peaks: empty arrays.
    * null doc_id and repeated rows: rows of their own. Empty table: empty. Other columns are ignored.
    """
    small_batches(df.sparkSession, 500)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(_columns(keep), _SCHEMA + ", media binary" * keep)
