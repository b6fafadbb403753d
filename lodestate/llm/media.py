"""Media columns: texts as WAV, short-time Fourier transforms, and fingerprints of spectral-peak pairs.

The payload is stored as 8-bit mono samples in a WAV container made and read by the wave module. The fingerprint of
the samples that come back is an array of (hash, time) codes: a peak is a bin that is the largest of its frame and
the frames next to it; each peak is paired with the next peaks, and a pair's code holds both bins, their distance in
time and the time of the first.
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

from ._batches import bounded_arrow, blocks

RATE = 8000
ALIGN = 64
FRAME = 128
HOP = 64
#: Peaks of a frame, and following peaks that each is paired with.
PEAKS, FAN = 2, 3
#: Frames of one transform call; a longer payload goes through in parts.
FRAMES_AT_ONCE = 4096

_WINDOW = np.hanning(FRAME)


def to_wav(payload: bytes) -> bytes:
    """8-bit mono WAV of the payload."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """All samples of an 8-bit mono WAV."""
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the spectral peaks, in order of time. Magnitudes are rounded, so that ties have one outcome."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64) - 128
    if len(x) < FRAME:
        x = np.concatenate([x, np.zeros(FRAME - len(x))])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    times, bins = [], []
    for first in range(0, len(frames), FRAMES_AT_ONCE):
        # the frames next to a part are needed to judge its edges
        low, high = max(0, first - 1), min(len(frames), first + FRAMES_AT_ONCE + 1)
        size = np.round(np.abs(np.fft.rfft(frames[low:high] * _WINDOW)), 3)[:, 1:]
        near = size.copy()
        near[1:] = np.maximum(near[1:], size[:-1])
        near[:-1] = np.maximum(near[:-1], size[1:])
        side = np.zeros_like(size, bool)
        side[:, 1:-1] = (size[:, 1:-1] > size[:, :-2]) & (size[:, 1:-1] >= size[:, 2:])
        value = np.where(side & (size >= near) & (size > 0), size, -1.0)
        top = np.argsort(-value, axis=1, kind="stable")[:, :PEAKS]
        frame, rank = np.nonzero(np.take_along_axis(value, top, 1) > 0)
        inside = (frame + low >= first) & (frame + low < first + FRAMES_AT_ONCE)
        times.append(frame[inside] + low)
        bins.append(top[frame[inside], rank[inside]] + 1)
    return np.concatenate(times), np.concatenate(bins)


def fingerprint(samples: bytes) -> np.ndarray:
    """Sorted 64-bit codes of peak pairs: time of the first peak << 32 | its bin << 20 | the other's bin << 8 | distance (at most 255)."""
    time, bin_ = peaks(samples)
    codes = []
    for step in range(1, FAN + 1):
        if len(time) > step:
            apart = time[step:] - time[:-step]
            ok = apart < 256
            codes.append((time[:-step][ok] << 32) | (bin_[:-step][ok] << 20) | (bin_[step:][ok] << 8) | apart[ok])
    return np.sort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)


def payload_of(text: bytes) -> bytes:
    """Zero bytes behind the text, up to a positive multiple of ALIGN."""
    return text + bytes(-len(text) % ALIGN if text else ALIGN)


_COLUMNS = "n_bytes long, media binary"


def store_media(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """All columns of docs inside ``row``, n_bytes of the text and its WAV (``media``). Null counts as empty."""
    bounded_arrow(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            texts = [(x or "").encode() for x in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("row"), pa.array([len(x) for x in texts], pa.int64()), pa.array([to_wav(payload_of(x)) for x in texts], pa.binary())], ["row", "n_bytes", "media"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {_COLUMNS}")


def media_features(df: DataFrame, *, keep: list[str], media: str = "media", codes: bool = True) -> DataFrame:
    """Read each WAV back: the columns in keep, facts of its payload, its digest, the fingerprint's digest (``feature``) and codes.

    A null media is read as an empty recording. codes=False leaves the code arrays out.
    """
    bounded_arrow(df.sparkSession)
    rows = df.select(*keep, F.col(media).alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "media"):
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            arrays = []
            for stored in block.column("media").to_pylist():
                stored = stored or to_wav(b"")
                payload = from_wav(stored)
                code = fingerprint(payload)
                values = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), hashlib.sha256(code.astype("<i8").tobytes()).hexdigest()[:32]
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
                arrays.append(code)
            made = [block.column(k) for k in keep] + [pa.array(x, pa.int64() if isinstance(x[0], int) else pa.string()) for x in out.values()]
            yield pa.RecordBatch.from_arrays(made + [pa.array(arrays, pa.list_(pa.int64()))] * codes, [*keep, *out, *["codes"] * codes])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(run, f"{kinds}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", codes array<bigint>" if codes else ""))
