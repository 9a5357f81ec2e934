"""Audio columns: texts stored as WAV, read back, and fingerprinted by pairs of spectral peaks.

The payload is the UTF-8 text, filled with bytes 0 up to a positive multiple of 64, stored as 8-bit mono samples. The
stored bytes are read by the wave module; a short-time Fourier transform (Hann window) gives the strongest bin in each
of four bands of each frame. A peak is a bin no weaker than those of its band in the frames around it; each peak is
paired with the next few of later frames. A pair is one 64-bit code: the time of the first peak in the upper half, then both bins and
the time between them, so an array of codes is in the order of time and can be searched by time or by pair.

Frames are transformed in blocks, so memory is that of the text whatever its length. Ties between bins of a band go to the
lowest, those between frames to the earliest. Other columns are not read. Null texts count as empty (64 zero
samples). Equal texts give equal bytes and codes. Repeated rows and null ids are kept; an empty table gives no rows.
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

from ..session import bound_batches, ship

RATE, UNIT = 8000, 64
FRAME, HOP, BANDS, BLOCK = 256, 128, 4, 2048
#: Frames before and after a peak that it must not fall below; partners of a peak and the most frames between them.
AROUND, PARTNERS, APART = 3, 3, 63


def stored(text: bytes) -> bytes:
    """The WAV file of a text."""
    payload = text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def samples(media: bytes) -> bytes:
    """The samples of a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times and bins of the spectral peaks in order of time. Strengths are rounded logarithms, so that the last bits of
    floating-point sums don't decide."""
    x = np.frombuffer(data, np.uint8)
    n, window = 1 + max(0, -(-(len(x) - FRAME) // HOP)), np.hanning(FRAME).astype(np.float32)
    if len(x) < (whole := FRAME + (n - 1) * HOP):  # silence fills the last frame
        x = np.concatenate((x, np.full(whole - len(x), 128, np.uint8)))
    bins, power = np.empty((n, BANDS), np.int64), np.empty((n, BANDS), np.int64)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for at in range(0, n, BLOCK):
        spectrum = np.abs(np.fft.rfft((frames[at : at + BLOCK].astype(np.float32) - 128) * window, axis=1)[:, 1:])
        level = np.rint(16 * np.log2(1 + spectrum)).astype(np.int64).reshape(len(spectrum), BANDS, -1)
        best = level.argmax(2)
        power[at : at + BLOCK] = np.take_along_axis(level, best[:, :, None], 2)[:, :, 0]
        bins[at : at + BLOCK] = best + np.arange(BANDS) * level.shape[2] + 1
    high = power > 0
    for d in range(1, min(AROUND, n - 1) + 1):
        high[d:] &= power[d:] > power[:-d]
        high[:-d] &= power[:-d] >= power[d:]
    t, band = np.nonzero(high)
    return t, bins[t, band]


def codes(data: bytes) -> np.ndarray:
    """Pairs of peaks as 64-bit codes: time << 32 | bin << 16 | other bin << 8 | frames between."""
    t, f = peaks(data)
    out = []
    later = np.searchsorted(t, t, "right")  # the first peak of a later frame
    for k in range(PARTNERS):
        own = np.flatnonzero(later + k < len(t))
        other = later[own] + k
        gap = t[other] - t[own]
        out.append((t[own] << 32 | f[own] << 16 | f[other] << 8 | gap)[gap <= APART])
    return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media, payload_bytes, payload_sha256, tail_crc32, fingerprint): the WAV bytes, what was read back from
    them, and the time-coded array of pairs."""
    bound_batches(docs.sparkSession, 256)
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "fingerprint"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            media = [stored(t) for t in texts]
            back = [samples(m) for m in media]
            columns = [
                b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary()), pa.array(map(len, back), pa.int64()),
                pa.array([hashlib.sha256(d).hexdigest() for d in back], pa.string()),
                pa.array([zlib.crc32(d[-UNIT:]) for d in back], pa.int64()),
                pa.array([codes(d) for d in back], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("_text"))
    schema = "n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, fingerprint array<long>"
    return rows.mapInArrow(of, f"`{id_col}` {kind}, {schema}")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lengths and digests of what is stored and read back, the digest of the time-coded array and the array itself."""
    pairs = F.col("fingerprint")
    feature = F.concat_ws(":", F.size(pairs).cast("string"), F.sha2(F.array_join(pairs.cast("array<string>"), ","), 256))
    return encoded(docs, id_col, text_col).select(
        id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "fingerprint",
    )
