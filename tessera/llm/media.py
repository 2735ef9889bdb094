"""Operator 1, media columns: WAV payloads, short-time Fourier transforms, spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import lean, read_documents, slices

SAMPLE_RATE = 8000
FRAME = 256
HOP = 128
BANDS = ((1, 8), (8, 24), (24, 64), (64, 128))
#: A peak is paired with the first peaks of later frames, so many and so many frames later at most.
FAN_OUT, ZONE = 3, 64
FRAMES_AT_ONCE = 4096
BLOCK = 64


def pad_payload(data: bytes) -> bytes:
    """Append bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def wav_bytes(payload: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """The payload as 8-bit mono samples of a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(rate)
        file.writeframes(payload)
    return out.getvalue()


def wav_samples(media: bytes) -> bytes:
    """The stored samples of a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


def spectral_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the spectral peaks, in the order of frames.

    Hann-windowed frames that overlap by half, the last one zero-filled; in each frame the strongest bin of
    each band is a peak if it stands above the band's mean power over the whole signal.
    """
    n = 1 + max(0, -(-(len(samples) - FRAME) // HOP))
    filled = np.full((n - 1) * HOP + FRAME, 128, np.uint8)
    filled[: len(samples)] = samples
    frames = np.lib.stride_tricks.sliding_window_view(filled, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32) / 128
    best = np.zeros((n, len(BANDS)), np.int64)
    power = np.zeros((n, len(BANDS)))
    total = np.zeros(len(BANDS))
    for first in range(0, n, FRAMES_AT_ONCE):
        spectrum = np.fft.rfft((frames[first : first + FRAMES_AT_ONCE].astype(np.float32) - 128) * window, axis=1)
        energy = spectrum.real**2 + spectrum.imag**2
        for b, (low, high) in enumerate(BANDS):
            part = energy[:, low:high]
            at = part.argmax(axis=1)
            best[first : first + len(part), b] = at + low
            power[first : first + len(part), b] = part[np.arange(len(part)), at]
            total[b] += part.mean(axis=1).sum()
    frame, band = np.nonzero(power > total / n)
    return frame, best[frame, band]


def peak_pairs(frame: np.ndarray, peak: np.ndarray, fan_out: int = FAN_OUT, zone: int = ZONE) -> np.ndarray:
    """Time-coded pair fingerprints, sorted: frame << 32 | first bin << 24 | second bin << 16 | frames between.

    Peaks come in the order of frames. Each is paired with the first fan_out peaks of later frames, at most zone
    frames later; never with one of its own frame.
    """
    later = np.searchsorted(frame, frame, side="right")
    codes = []
    for step in range(fan_out):
        mine = np.flatnonzero(later + step < len(frame))
        other = later[mine] + step
        between = frame[other] - frame[mine]
        near = between <= zone
        codes.append((frame[mine][near] << 32) | (peak[mine][near] << 24) | (peak[other][near] << 16) | between[near])
    return np.sort(np.concatenate(codes))


def describe(data: bytes) -> tuple[bytes, bytes, np.ndarray, str]:
    """Media file, payload read back from it, fingerprints and feature of a text's bytes."""
    media = wav_bytes(pad_payload(data))
    payload = wav_samples(media)
    frame, peak = spectral_peaks(np.frombuffer(payload, np.uint8))
    pairs = peak_pairs(frame, peak)
    digest = hashlib.blake2b(pairs.astype("<i8").tobytes(), digest_size=8).hexdigest()
    return media, payload, pairs, f"stft{FRAME}:{len(frame)}:{len(pairs)}:{digest}"


def media_columns(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_media: bool = True, keep_fingerprints: bool = True) -> DataFrame:
    """Store each whole text as a WAV file's samples and fingerprint what is read back.

    Columns: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and,
    if asked for, media (binary) and fingerprint (array<bigint>, sorted by time). A null text counts as
    empty; rows are judged one by one, so repeated or null ids, ties and extra columns don't matter; an
    empty table gives no rows. One narrow pass without a shuffle; spectra are computed a block of frames at
    a time.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    schema += ", media binary" * keep_media + ", fingerprint array<bigint>" * keep_fingerprints

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2_000_000):
            rows = []
            for data in part.column("text").cast(pa.binary()).to_pylist():
                data = data or b""
                media, payload, pairs, feature = describe(data)
                row = [len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature]
                rows.append((*row, *[media] * keep_media, *[pairs] * keep_fingerprints))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * keep_media, *[pa.list_(pa.int64())] * keep_fingerprints]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media"] * keep_media, *["fingerprint"] * keep_fingerprints]
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[id_column, *names])

    return docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).mapInArrow(lean(run), schema)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read_documents(spark, sf_dir))
