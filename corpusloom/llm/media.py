"""Operator 12: media columns. WAV bytes in a column, read by the wave module, with spectral-peak fingerprints.

A table of payloads becomes a table with a media column (8-bit mono WAV, one byte a sample). The
media are read back, cut into overlapping frames and transformed (short-time Fourier transform);
in each frame and band the strongest bin is a peak unless the frame before or after has a stronger
one in the band; each peak is paired with the next ones. A pair's code holds both bins and the
frames between them, and is stored with the first peak's frame: an array of (time, code). Two media
share a passage where they have the same codes at one constant distance in time.

Every row is done by itself: there is no shuffle, and a long medium is transformed in blocks of
BLOCK frames, so that a task holds the medium, its peaks and one block.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Payloads are filled with zero bytes to a multiple of UNIT; samples a second as stored.
UNIT, RATE = 64, 8_000
#: Samples of a frame, from one frame to the next, and frames that are transformed at once.
FRAME, HOP, BLOCK = 256, 128, 2_048
#: Powers are counted in steps of one STEPSth, so that rounding does not decide between bins that are equal.
STEPS = 16
#: Edges of the bands in bins; the lowest bins only have the mean.
BANDS = (2, 12, 32, 64, 129)
#: Peaks that a peak is paired with, and the most frames between them.
FAN, REACH = 3, 32


def to_wav(payload: bytes) -> bytes:
    """payload as the samples of a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of an 8-bit mono WAV file."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


def strongest(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x bands) of the strongest bin in each band and its power; the first of equal ones."""
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    window = np.hanning(FRAME + 1)[:-1]
    bins, powers = np.empty((n, len(BANDS) - 1), np.int32), np.empty((n, len(BANDS) - 1))
    for at in range(0, n, BLOCK):
        m = min(BLOCK, n - at)
        part = samples[at * HOP : (at + m - 1) * HOP + FRAME].astype(np.float64) - 128
        part = np.concatenate([part, np.zeros((m - 1) * HOP + FRAME - len(part))])
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        spectrum = np.fft.rfft((frames - frames.mean(1, keepdims=True)) * window, axis=1)
        power = np.rint((spectrum.real**2 + spectrum.imag**2) * STEPS)
        for k, (low, high) in enumerate(zip(BANDS, BANDS[1:], strict=False)):
            best = power[:, low:high].argmax(1)
            bins[at : at + m, k], powers[at : at + m, k] = best + low, np.take_along_axis(power[:, low:high], best[:, None], 1)[:, 0]
    return bins, powers


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of each peak, by frame and bin."""
    bins, powers = strongest(samples)
    edge = np.zeros((1, powers.shape[1]))
    top = (powers >= np.concatenate([edge, powers[:-1]])) & (powers > np.concatenate([powers[1:], edge])) & (powers > 0)
    frame, band = np.nonzero(top)
    return frame, bins[frame, band]


def pairs(frame: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, code) of each pair of peaks, by time and code; a code is the two bins and the frames between, a byte each."""
    times, codes = [], []
    for step in range(1, FAN + 1):
        gap = frame[step:] - frame[:-step]
        near = gap <= REACH
        times.append(frame[:-step][near])
        codes.append((at[:-step][near].astype(np.int64) << 16) | (at[step:][near].astype(np.int64) << 8) | gap[near])
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return time[order], code[order]


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(time, code) arrays of a payload's samples."""
    return pairs(*peaks(np.frombuffer(payload, np.uint8)))


def with_media(payloads: DataFrame, key: str) -> DataFrame:
    """(key, n_bytes, media): WAV of each payload (binary; null: empty), filled with zero bytes to a positive multiple of UNIT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [p or b"" for p in b.column("payload").to_pylist()]
            media = [to_wav(p + bytes(max(UNIT, -(-len(p) // UNIT) * UNIT) - len(p))) for p in raw]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([len(p) for p in raw], pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    small_batches(payloads.sparkSession)
    return payloads.select(key, "payload").mapInArrow(run, f"{key} {payloads.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def with_fingerprints(media: DataFrame, key: str) -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, fingerprint) of what is read back from media; fingerprint is array<struct<time, code>>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            time, code, ends = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [0]
            for m in b.column("media").to_pylist():
                payload = from_wav(m)
                for c, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest()), strict=True):
                    c.append(v)
                t, c = fingerprint(payload)
                time.append(t.astype(np.int32))
                code.append(c)
                ends.append(ends[-1] + len(t))
            both = pa.StructArray.from_arrays([pa.array(np.concatenate(time)), pa.array(np.concatenate(code))], names=["time", "code"])
            columns = [b.column(key), b.column("n_bytes"), *map(pa.array, out, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fingerprint"])

    schema = f"{key} {media.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprint array<struct<time:int,code:long>>"
    return media.select(key, "n_bytes", "media").mapInArrow(run, schema)


def op12_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_pairs of every document; feature is the sha256 of its fingerprint."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("payload"))
    rows = with_fingerprints(with_media(docs, "doc_id"), "doc_id")
    said = F.array_join(F.transform("fingerprint", lambda p: F.concat(p["time"].cast("string"), F.lit(":"), p["code"].cast("string"))), ",")
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.sha2(said.cast("binary"), 256).alias("feature"), F.size("fingerprint").cast("long").alias("n_pairs"))
