"""WAV files: header, measurements and samples, in Arrow batches over binary columns.

Only PCM in WAV containers is read, with the standard library. A file that can't be read gives a row
with its error.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 16_000
MEASURES = "ok boolean, sr int, ch int, frames bigint, dur double, peak double, clip_frac double, rms_db double, dc double, hash string, error string"


def files(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """``path`` and ``content`` of all files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "content")


def decode(data: bytes) -> tuple[np.ndarray, int, int]:
    """Samples as floats in -1..1, one column for each channel; rate; channels."""
    with wave.open(io.BytesIO(data)) as f:
        width, channels, rate, n = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.getnframes()
        raw = f.readframes(n)
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 2:
        x = np.frombuffer(raw, "<i2").astype(np.float32) / 32768
    elif width == 4:
        x = np.frombuffer(raw, "<i4").astype(np.float32) / 2147483648
    else:
        raise ValueError(f"samples of {width} bytes")
    return x.reshape(-1, channels), rate, channels


def mono(data: bytes, rate: int = RATE, strict: bool = False) -> np.ndarray:
    """Mean of the channels at ``rate``; strict refuses empty or non-finite audio."""
    x, have, _ = decode(data)
    x = x.mean(axis=1)
    if strict and (not len(x) or not np.isfinite(x).all()):
        raise ValueError("empty or non-finite audio")
    if have != rate and len(x):
        n = round(len(x) * rate / have)
        x = np.interp(np.arange(n) * have / rate, np.arange(len(x)), x).astype(np.float32)
    return x


def measure(data: bytes | None) -> dict:
    out: dict = dict.fromkeys(("sr", "ch", "frames", "dur", "peak", "clip_frac", "rms_db", "dc", "hash", "error"))
    if data is None:
        return out | {"ok": False, "error": "missing"}
    try:
        x, rate, channels = decode(data)
    except Exception as e:  # any malformed file
        return out | {"ok": False, "error": f"{type(e).__name__}: {str(e)[:200]}"}
    out |= {"ok": True, "sr": rate, "ch": channels, "frames": len(x), "dur": len(x) / rate}
    if len(x):
        flat = x.astype(np.float64).ravel()
        rms = float(np.sqrt((flat**2).mean()))
        pcm = np.clip(np.round(flat * 32768), -32768, 32767).astype("<i2").tobytes()
        out |= {"peak": float(np.abs(flat).max()), "clip_frac": float((np.abs(flat) >= 0.999).mean()), "rms_db": 20 * float(np.log10(rms)) if rms > 0 else -200.0, "dc": float(flat.mean()), "hash": hashlib.md5(pcm).hexdigest()}
    return out


def measured(df: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Key and measurements of every file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in MEASURES.split(", ")]
        kinds = {"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
        types = [kinds[x.split(" ")[1]] for x in MEASURES.split(", ")]
        for batch in batches:
            rows = [measure(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True))], ["key", *names])

    return df.select(F.col(key).cast("string").alias("key"), content).mapInArrow(run, f"key string, {MEASURES}").withColumnRenamed("key", key)


def header_problems(df: DataFrame) -> DataFrame:
    """Measured files that aren't readable, mono, at 16 kHz and non-empty, with the problem."""
    problem = F.when(~F.col("ok"), "unreadable").when(F.col("sr") != RATE, "sample rate").when(F.col("ch") != 1, "channels").when(F.col("frames") <= 0, "empty")
    return df.withColumn("problem", problem).filter("problem is not null")


def log_mel(x: np.ndarray, mels: int = 80, n_fft: int = 400, hop: int = 160) -> np.ndarray:
    """Logarithmic mel spectrum (base 10, floor 1e-10), frames by mels."""
    if len(x) < n_fft:
        x = np.pad(x, (0, n_fft - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop] * np.hanning(n_fft + 1)[:-1]
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(to_mel(0), to_mel(RATE / 2), mels + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(n_fft, 1 / RATE)
    up = (bins - edges[:-2, None]) / (edges[1:-1, None] - edges[:-2, None])
    down = (edges[2:, None] - bins) / (edges[2:, None] - edges[1:-1, None])
    bank = np.maximum(0, np.minimum(up, down))
    return np.log10(np.maximum(power @ bank.T, 1e-10))


def normalized(x: np.ndarray) -> np.ndarray:
    """Zero mean and unit variance over the utterance."""
    return (x - x.mean()) / np.sqrt(x.var() + 1e-5)


def peak_normalized(x: np.ndarray) -> np.ndarray:
    peak = float(np.abs(x).max()) if len(x) else 0.0
    return x / peak if peak > 0 else x
