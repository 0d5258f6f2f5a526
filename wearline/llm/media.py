"""Media columns: texts' bytes kept as 8-bit WAV, and spectral-peak pair fingerprints of the read-back samples.

store() appends zero bytes up to a positive multiple of BLOCK and writes the wave file; fingerprint() reads the stored
bytes with the wave module, runs a short-time Fourier transform and pairs the strongest bins of near frames into a
time-coded array.  A null or empty text is one block of zeros; a long text is transformed in blocks of frames, so
memory doesn't grow with it; equal bytes give equal fingerprints; repeated rows each get their own; extra input
columns are not carried; an empty table gives an empty table.  A null media value gives nulls.
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

from .common import emit, schema_of, sliced, texts_of

BLOCK, RATE = 64, 8000
#: Samples a frame, samples between frames, and the frames ahead with which a peak is paired.
FRAME, HOP, REACH = 256, 128, 3
#: Frames transformed at once.
AT_ONCE = 4096
#: Lowest bin that can be a peak: the first ones hold the level of the text's letters.
LOWEST = 2
WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    held = io.BytesIO()
    with wave.open(held, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return held.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if r.getsampwidth() != 1 or r.getnchannels() != 1:
            raise ValueError("8-bit mono is expected")
        return r.readframes(r.getnframes())


def peaks(samples: np.ndarray) -> np.ndarray:
    """The strongest bin of each frame; the last frame is filled up with the middle level."""
    frames = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    full = np.full((frames - 1) * HOP + FRAME, 128, np.uint8)
    full[: len(samples)] = samples
    cut = np.lib.stride_tricks.sliding_window_view(full, FRAME)[::HOP]
    found = []
    for at in range(0, frames, AT_ONCE):
        part = (cut[at : at + AT_ONCE].astype(np.float32) - 128) * WINDOW
        power = np.abs(np.fft.rfft(part, axis=1))
        found.append(LOWEST + np.argmax(power[:, LOWEST:], axis=1))
    return np.concatenate(found).astype(np.int64)


def pairs(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Frame numbers and codes (bin, later bin, distance) of all peak pairs by time, and the number of frames."""
    p = peaks(samples)
    time = np.concatenate([np.arange(max(0, len(p) - d)) for d in range(1, REACH + 1)])
    code = np.concatenate([p[:-d] | p[d:] << 8 | d << 16 for d in range(1, REACH + 1) if len(p) > d] or [np.empty(0, np.int64)])
    order = np.argsort(time, kind="stable")
    return time[order], code[order], len(p)


def store(df: DataFrame, keys: list[str], text: str = "text", media: str = "media") -> DataFrame:
    """The key columns, n_bytes of the text and the wave file that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            raw = [t.encode("utf-8") for t in texts_of(batch, text)]
            files = [to_wav(r + bytes(-len(r) % BLOCK if r else BLOCK)) for r in raw]
            yield emit(batch, keys, {"n_bytes": pa.array(map(len, raw), pa.int64()), media: pa.array(files, pa.binary())})

    return df.select(*keys, text).mapInArrow(run, schema_of(df, keys, f"n_bytes bigint, `{media}` binary"))


def fingerprint(df: DataFrame, media: str = "media") -> DataFrame:
    """df with what its media hold: payload_bytes, payload_sha256, tail_crc32, n_frames and marks, an array by time of (frame << 20) + code."""
    keep = [c for c in df.columns if c not in ("payload_bytes", "payload_sha256", "tail_crc32", "n_frames", "marks")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, media):
            rows: list[tuple] = []
            for file in batch.column(batch.schema.get_field_index(media)).to_pylist():
                if file is None:
                    rows.append((None,) * 5)
                    continue
                payload = from_wav(file)
                time, code, frames = pairs(np.frombuffer(payload, np.uint8))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), frames, (time << 20) + code))
            size, sha, tail, frames, marks = zip(*rows, strict=True) if rows else ((),) * 5
            yield emit(batch, keep, {"payload_bytes": pa.array(size, pa.int64()), "payload_sha256": pa.array(sha, pa.string()), "tail_crc32": pa.array(tail, pa.int64()), "n_frames": pa.array(frames, pa.int64()), "marks": pa.array(marks, pa.list_(pa.int64()))})

    more = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, n_frames bigint, marks array<bigint>"
    return df.select(*keep).mapInArrow(run, schema_of(df, keep, more))


def described(df: DataFrame, keys: list[str], media: str = "media") -> DataFrame:
    """Lengths and digests of media, payload and marks, one row per row of fingerprint()."""
    marks = F.sha2(F.array_join(F.col("marks").cast("array<string>"), " "), 256)
    return df.select(
        *keys, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length(media).cast("long").alias("media_bytes"), F.sha2(media, 256).alias("media_sha256"),
        F.concat_ws(":", F.col("n_frames").cast("string"), F.size("marks").cast("string"), F.substring(marks, 1, 32)).alias("feature"),
    )
