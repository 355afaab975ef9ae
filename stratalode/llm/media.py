"""Media columns: texts as WAV samples, and spectral-peak pair fingerprints of them."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, only, read, small_batches, stage


@dataclass(frozen=True)
class Sound:
    """8-bit samples at rate. Frames of frame samples, hop apart; a peak is a band's largest bin, larger than in the
    frames beside; each peak is paired with the next fan ones that are at most reach frames away."""

    rate: int = 8000
    unit: int = 64
    frame: int = 256
    hop: int = 128
    bands: int = 4
    fan: int = 3
    reach: int = 63


def to_wav(payload: bytes, s: Sound) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(s.rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if w.getsampwidth() != 1 or w.getnchannels() != 1:
            raise ValueError("not 8-bit samples of one channel")
        return w.readframes(w.getnframes())


def _encode(s: Sound):
    def run(batches):
        for batch in batches:
            sizes, media = [], []
            for text in column(batch, "text").to_pylist():
                raw = (text or "").encode()
                sizes.append(len(raw))
                media.append(to_wav(raw + bytes(-len(raw) % s.unit if raw else s.unit), s))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return run


def fingerprint(payload: bytes, s: Sound, window: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(codes, frames) of the peak pairs in order of time: code = bin, partner's bin, frames between, 8 bits each."""
    x = np.frombuffer(payload, np.uint8).astype(np.float32) - np.float32(128)
    n = max(0, -(-(len(x) - s.frame) // s.hop)) + 1  # the last frame ends at or after the last sample, in silence
    x = np.concatenate([x, np.zeros((n - 1) * s.hop + s.frame - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, s.frame)[:: s.hop][:n]
    width = s.frame // 2 // s.bands
    bins, power = np.empty((n, s.bands), np.int64), np.empty((n, s.bands), np.float32)
    for at in range(0, n, block):  # a long text's spectrum is never whole in memory
        spectrum = np.fft.rfft(frames[at : at + block] * window, axis=1)[:, 1:]
        energy = (spectrum.real**2 + spectrum.imag**2).astype(np.float32).reshape(-1, s.bands, width)
        best = energy.argmax(2)
        bins[at : at + block] = best + np.arange(s.bands) * width + 1
        power[at : at + block] = np.take_along_axis(energy, best[:, :, None], 2)[:, :, 0]
    beside = np.zeros((n + 2, s.bands), np.float32)
    beside[1:-1] = power
    t, band = np.nonzero((power > beside[:-2]) & (power >= beside[2:]))
    f = bins[t, band]
    codes, times = [], []
    for step in range(1, s.fan + 1):
        gap = t[step:] - t[:-step]
        near = gap <= s.reach
        codes.append(((f[:-step] << 16) | (f[step:] << 8) | gap)[near])
        times.append(t[:-step][near])
    codes, times = np.concatenate(codes), np.concatenate(times)
    order = np.lexsort((codes, times))
    return codes[order].astype(np.int32), times[order].astype(np.int32)


def _features(s: Sound):
    def run(batches):
        window = np.hanning(s.frame).astype(np.float32)
        for batch in batches:
            rows = []
            for value in column(batch, "media"):
                media = value.as_py()
                payload = from_wav(media)
                codes, times = fingerprint(payload, s, window)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), codes, times))
            payload_bytes, sha, tail, media_bytes, media_sha, codes, times = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "n_bytes"), pa.array(payload_bytes, pa.int64()), pa.array(sha, pa.string()), pa.array(tail, pa.int64()), pa.array(media_bytes, pa.int64()), pa.array(media_sha, pa.string()), pa.array(codes, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "pair_codes", "pair_frames"],
            )

    return run


def store_media(docs: DataFrame, s: Sound = Sound()) -> DataFrame:
    """(doc_id, n_bytes, media), written as Parquet in the shared folder and read back: each text's UTF-8 bytes, with
    zeros up to a positive multiple of the unit, as samples of a WAV file. Null and empty texts are one unit of zeros."""
    small_batches(docs.sparkSession)
    return stage(only(docs, "doc_id", "text").mapInArrow(_encode(s), "doc_id long, n_bytes long, media binary"), "media")


def fingerprints(media: DataFrame, s: Sound = Sound()) -> DataFrame:
    """Reads a media column (doc_id, n_bytes, media) by the wave module: checksums, and the peak pairs as time-coded
    arrays pair_codes and pair_frames. Rows are independent of each other; equal samples give equal values."""
    small_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features(s), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pair_codes array<int>, pair_frames array<int>")


def op9_media(spark, sf_dir):
    found = fingerprints(store_media(read(spark, sf_dir, "documents")))
    pairs = F.concat_ws(",", F.zip_with("pair_codes", "pair_frames", lambda c, t: F.concat_ws("@", F.hex(c), t)))
    feature = F.concat_ws(":", F.size("pair_codes").cast("string"), F.sha2(pairs.cast("binary"), 256))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
