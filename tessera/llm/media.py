"""Media columns: bytes stored as WAV, read by the wave module, with short-time
Fourier transforms and spectral-peak pair fingerprints as time-coded arrays."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import slices

#: Payloads are padded to a multiple of this.
UNIT = 64
RATE = 8000
#: Samples of a frame, and frames transformed at a time.
FRAME, AT_ONCE = 256, 4096
#: A peak is the largest of its neighbours: so many frames and bins to either side. It
#: rises over a floor that silence and rounding stay under.
FRAMES_BY, BINS_BY, FLOOR = 1, 6, 1.0
#: Pairs of peaks are at most so many frames and bins apart.
SPAN, REACH = 3, 31


def to_wav(payload: bytes) -> bytes:
    """8-bit mono WAV that holds `payload` as its samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if w.getsampwidth() != 1 or w.getnchannels() != 1:
            raise ValueError("8-bit mono is expected")
        return w.readframes(w.getnframes())


def frames_of(samples: int) -> int:
    """Frames by half-frame hops that cover all samples, the last one padded."""
    return 1 if samples <= FRAME else -(-(samples - FRAME) // (FRAME // 2)) + 1


def spectrum(samples: bytes, at: int, stop: int) -> np.ndarray:
    """Magnitudes of frames at..stop: a row for each, by frequency bin. The mean of a
    frame is taken off, so that steady samples are silence."""
    hop = FRAME // 2
    x = np.frombuffer(samples[at * hop : (stop - 1) * hop + FRAME], dtype=np.uint8).astype(np.float32)
    short = (stop - at - 1) * hop + FRAME - len(x)
    if short:
        x = np.append(x, np.full(short, x[-1] if len(x) else 128, dtype=np.float32))
    cut = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::hop]
    return np.abs(np.fft.rfft((cut - cut.mean(axis=1, keepdims=True)) * np.hanning(FRAME).astype(np.float32), axis=1))


def highest(x: np.ndarray, by: int, axis: int) -> np.ndarray:
    """The largest of each value and its neighbours, `by` to either side; windows of
    twice the width come from two of the last, which overlap at the end."""
    part = lambda a, lo, hi: a[:, lo:hi] if axis else a[lo:hi]
    edge = [(by, by) if k == axis else (0, 0) for k in range(2)]
    out, wide = np.pad(x, edge), 1
    while wide < 2 * by + 1:
        step = min(wide, 2 * by + 1 - wide)
        n = out.shape[axis]
        out, wide = np.maximum(part(out, 0, n - step), part(out, step, n)), wide + step
    return out


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the local maxima of the spectrum, in order; equal neighbours
    are both peaks."""
    total = frames_of(len(samples))
    at_frame, at_bin = [], []
    for at in range(0, total, AT_ONCE):
        stop = min(total, at + AT_ONCE)
        low, high = max(0, at - FRAMES_BY), min(total, stop + FRAMES_BY)
        power = spectrum(samples, low, high)
        top = (power > FLOOR) & (power == highest(highest(power, BINS_BY, 1), FRAMES_BY, 0))
        f, b = np.nonzero(top[at - low : at - low + stop - at])
        at_frame.append(f + at)
        at_bin.append(b)
    return np.concatenate(at_frame), np.concatenate(at_bin)


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of all pairs of a peak with one up to `SPAN` frames later (in the
    same frame: of a higher bin) and `REACH` bins off, in order. A code holds both
    bins and the frames between; the time is the first peak's frame."""
    frame, bin_ = peaks(samples)
    times, codes = [], []
    last = np.searchsorted(frame, frame + SPAN, side="right")
    for lag in range(1, int((last - np.arange(len(frame))).max(initial=1))):
        a = np.flatnonzero(np.arange(len(frame)) + lag < last)
        b = a + lag
        ok = np.abs(bin_[b] - bin_[a]) <= REACH
        a, b = a[ok], b[ok]
        times.append(frame[a])
        codes.append(bin_[a] << 16 | bin_[b] << 4 | frame[b] - frame[a])
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


NAMES = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "times", "codes"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]


def media_columns(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, media, times, codes) of every row: media is the WAV, times
    and codes the time-coded arrays.

    The payload is the text's UTF-8 (null: empty) with zero bytes up to a positive
    multiple of 64; its digest, the CRC-32 of its last 64 bytes and the features
    are of the bytes read back. feature names the number of pairs and a digest of
    the time-coded arrays, which are empty for silence. Equal texts have equal values.
    Repeated rows each give a row; an empty table gives none; further columns are
    ignored.
    """
    kind = docs.schema[ident].dataType.simpleString()
    schema = f"`{ident}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, times array<int>, codes array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            rows = []
            for t in b.column(1).to_pylist():
                raw = (t or "").encode("utf-8")
                media = to_wav(raw + bytes(-len(raw) % UNIT if raw else UNIT))
                back = from_wav(media)
                times, codes = fingerprint(back)
                digest = hashlib.sha256(times.astype("<i4").tobytes() + codes.astype("<i4").tobytes()).hexdigest()
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(codes)}:{digest[:32]}", media, times, codes))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(zip(*rows), KINDS))], names=[ident, *NAMES])

    return docs.select(ident, text).mapInArrow(run, schema)
