"""Media columns: texts stored as WAV, read back by the wave module, with spectral fingerprints (operator 4).

A text's UTF-8 bytes, padded with blanks to a positive multiple of 192, are the 8-bit
samples of a mono WAV file. The file is read again by the wave module; what it returns is
the payload. Short-time Fourier transforms over frames of 192 samples, half overlapping,
give four bands' strongest bins. One that also exceeds its band in both neighbouring
frames is a peak, and each peak is paired with the peaks of the next three frames. The
fingerprint is the array of pair codes beside the array of their frames.

Defined results
---------------
Null and empty texts: 192 blanks. Equal texts give equal columns, whatever stands beside
them. Texts are stored whole; a file may hold up to 4 GB. Repeated rows are each stored.
Columns of the documents named as a result give way to it.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at

UNIT, RATE = 192, 8000
FRAME, HOP = 192, 96
BANDS = ((1, 8), (8, 20), (20, 45), (45, 97))
REACH = 3
_WINDOW = np.hanning(FRAME).astype(np.float32)


def stored(data: bytes) -> bytes:
    """The WAV file of the padded bytes."""
    padded = data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b" ")
    file = io.BytesIO()
    with wave.open(file, "wb") as out:
        out.setnchannels(1)
        out.setsampwidth(1)
        out.setframerate(RATE)
        out.writeframes(padded)
    return file.getvalue()


def payload(media: bytes) -> bytes:
    """The samples of a WAV file, byte by byte."""
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


def fingerprints(samples: np.ndarray, offsets: np.ndarray, most: int = 1 << 13) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frame and code of all pairs, row by row, and how many each row has; rows are multiples of UNIT."""
    first = offsets // HOP
    frames = int(offsets[-1]) // HOP - 1
    places = np.zeros((max(0, frames), len(BANDS)), np.int16)
    powers = np.zeros((max(0, frames), len(BANDS)), np.float32)
    view = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for lo in range(0, frames, most):
        part = (view[lo : lo + most].astype(np.float32) - 128) * _WINDOW
        spectrum = np.fft.rfft(part)
        power = spectrum.real**2 + spectrum.imag**2
        for b, (low, high) in enumerate(BANDS):
            own = power[:, low:high]
            best = own.argmax(1)
            places[lo : lo + len(part), b] = best + low
            powers[lo : lo + len(part), b] = own[np.arange(len(own)), best]
    row = np.searchsorted(first, np.arange(frames), "right") - 1
    whole = np.arange(frames) + 1 < first[row + 1]  # the frame doesn't reach into the next row
    powers[~whole] = -1
    around = np.full((frames + 2, len(BANDS)), -1, np.float32)
    around[1:-1] = powers
    peak = (powers > around[:-2]) & (powers >= around[2:]) & whole[:, None]
    at_, band = np.nonzero(peak)
    code = places[at_, band].astype(np.int64)
    begin = np.searchsorted(at_, np.arange(frames + REACH + 2))
    times, codes = [], []
    for step in range(1, REACH + 1):
        near, stop = begin[at_ + step], begin[at_ + step + 1]
        same = row[np.minimum(at_ + step, frames - 1)] == row[at_] if len(at_) else np.zeros(0, bool)
        for j in range(len(BANDS)):
            ok = np.flatnonzero(same & (near + j < stop))
            times.append(at_[ok])
            codes.append(code[ok] << 16 | code[near[ok] + j] << 8 | step)
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    times, codes = times[order], codes[order]
    owner = row[times] if len(times) else times
    return (times - first[owner]).astype(np.int32), codes.astype(np.int32), np.bincount(owner, minlength=len(offsets) - 1)


SCHEMA = "n_bytes long, media binary, payload binary, peak_times array<int>, peak_pairs array<int>"


def media_columns(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns with n_bytes, the WAV file as `media`, its samples read back as `payload`,
    and the fingerprint: codes of peak pairs in `peak_pairs`, their frames in `peak_times`."""

    def setup():
        def work(texts):
            files = [stored(texts.data[a:b].tobytes()) for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist())]
            back = [payload(f) for f in files]
            offsets = np.zeros(len(back) + 1, np.int64)
            np.cumsum([len(b) for b in back], out=offsets[1:])
            times, codes, counts = fingerprints(np.frombuffer(b"".join(back), np.uint8), offsets)
            return {
                "n_bytes": np.diff(texts.offsets), "media": pa.array(files, pa.binary()), "payload": pa.array(back, pa.binary()),
                "peak_times": at.lists(times, counts), "peak_pairs": at.lists(codes, counts),
            }

        return work

    return at.map_text(docs, setup, SCHEMA, text, carry, most=1 << 20)


def digests(columns: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """What tells the media columns apart, without the media."""
    return columns.select(
        F.col(doc_id).alias("doc_id"), "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("peak_pairs").cast("string"), F.lower(F.hex(F.xxhash64("peak_times", "peak_pairs")))).alias("feature"),
    )
