"""Media columns: WAV payloads, short-time Fourier transforms, spectral-peak pairs.

A payload is kept without loss as unsigned 8-bit mono samples in a WAV file inside
a binary column.  Features are the time-coded fingerprints of a recording: peaks of
its spectrogram are paired with a few later peaks, and each pair gives a hash of both
frequencies and their distance in time, stored with the time of the first peak.
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

from . import common

BLOCK = 64
RATE = 8000
FRAME = 512
HOP = 256
#: Peaks kept in a band of frequencies and a group of frames, and later peaks paired with each.
BANDS, GROUP, FAN = 4, 4, 3
_ROWS = 2048


def pad_payload(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


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


def stft_blocks(samples: np.ndarray, frame: int = FRAME, hop: int = HOP, rows: int = _ROWS) -> Iterator[np.ndarray]:
    """Power spectra, a bounded number of frames at a time; the last frame is padded with silence."""
    frames = max(1, -(-(len(samples) - frame) // hop) + 1)
    padded = np.full((frames - 1) * hop + frame, 128, np.uint8)
    padded[: len(samples)] = samples
    window = np.hanning(frame).astype(np.float32)
    views = np.lib.stride_tricks.sliding_window_view(padded, frame)[::hop]
    for at in range(0, frames, rows):
        spectrum = np.fft.rfft((views[at : at + rows].astype(np.float32) - np.float32(128)) * window, axis=1)
        yield np.square(spectrum.real) + np.square(spectrum.imag)


def fingerprints(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and times of the spectral-peak pairs of one recording.

    A peak is the strongest bin of its band within a group of frames (the first of
    equals); each is paired with the next ``FAN`` peaks in order of time.
    """
    times, bins = [], []
    at = 0
    for power in stft_blocks(samples):
        rows, width = len(power), (power.shape[1] - 1) // BANDS
        groups = -(-rows // GROUP)
        room = np.full((groups * GROUP, width * BANDS), -1, np.float32)
        room[:rows] = power[:, 1 : 1 + width * BANDS]
        flat = room.reshape(groups, GROUP, BANDS, width).transpose(0, 2, 1, 3).reshape(groups, BANDS, GROUP * width)
        best = flat.argmax(axis=2)
        alive = np.take_along_axis(flat, best[:, :, None], 2)[:, :, 0] > 0
        t = at + np.arange(groups)[:, None] * GROUP + best // width
        f = 1 + np.arange(BANDS)[None, :] * width + best % width
        times.append(t[alive])
        bins.append(f[alive])
        at += rows
    t, f = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((f, t))
    t, f = t[order], f[order]
    hashes, starts = [], []
    for k in range(1, min(FAN, len(t) - 1) + 1):
        apart = np.minimum(t[k:] - t[:-k], 4095)
        hashes.append((f[:-k] << 21 | f[k:] << 12 | apart).astype(np.int64))
        starts.append(t[:-k].astype(np.int32))
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    h, s = np.concatenate(hashes), np.concatenate(starts)
    order = np.lexsort((h, s))
    return h[order], s[order]


MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, pair_hashes array<long>, pair_times array<int>"


def encode_media(docs: DataFrame) -> DataFrame:
    """A media column: each whole text as UTF-8 bytes in a WAV file (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part["text"].to_pylist()
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(map(len, texts), pa.int64()), pa.array([to_wav(pad_payload(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text")).mapInArrow(run, MEDIA_SCHEMA)


def read_media(media: DataFrame) -> DataFrame:
    """Payload checks, stored size and spectral-peak pairs of a media column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_frames", pa.int64()), ("pair_hashes", pa.list_(pa.int64())), ("pair_times", pa.list_(pa.int32()))])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, n, media in zip(part["doc_id"].to_pylist(), part["n_bytes"].to_pylist(), part["media"].to_pylist(), strict=True):
                    payload = from_wav(media)
                    hashes, times = fingerprints(np.frombuffer(payload, np.uint8))
                    frames = max(1, -(-(len(payload) - FRAME) // HOP) + 1)
                    rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), frames, hashes, times))
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURE_SCHEMA)


def media_features(docs: DataFrame) -> DataFrame:
    """Store the media column in the shared folder, read it back and compute its features.

    An empty or null text is 64 zero bytes; long texts are stored and transformed whole, a
    bounded number of frames at a time; equal texts give equal rows, repeated ones too; an
    empty table gives no rows.  Of equally strong bins the first is the peak.  Only doc_id
    and text are read, so other columns may have any name.  The time-coded arrays are
    columns of a stored table, which the result reads.
    """
    spark = docs.sparkSession
    with common.scratch(spark) as scratch, common.small_batches(spark):
        stored = scratch.table(encode_media(docs), "media", **{"parquet.block.size": 16 << 20})
        return common.materialize(read_media(stored), "features")


def feature_digest(features: DataFrame) -> DataFrame:
    """One string for the time-coded arrays."""
    joined = F.concat_ws("|", F.array_join("pair_hashes", ","), F.array_join("pair_times", ","))
    text = F.concat_ws(":", F.lit("stft512"), F.col("n_frames"), F.size("pair_hashes"), F.sha2(joined, 256))
    return features.withColumn("feature", text).drop("n_frames", "pair_hashes", "pair_times")
