"""WAV files as rows of samples, and a voice gate over windows of them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 16_000


def chunks(blob: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The RIFF chunks of a WAVE file; sizes and padding must add up."""
    if blob[:4] != b"RIFF" or blob[8:12] != b"WAVE" or len(blob) != 8 + struct.unpack("<I", blob[4:8])[0]:
        raise ValueError("not a whole RIFF/WAVE file")
    at = 12
    while at < len(blob):
        if at + 8 > len(blob):
            raise ValueError("broken chunk")
        name, size = struct.unpack_from("<4sI", blob, at)
        if at + 8 + size > len(blob):
            raise ValueError("truncated chunk")
        yield name, blob[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def samples_of(blob: bytes, rate: int = RATE) -> np.ndarray:
    """Samples in [-1, 1] of a mono file at ``rate`` in 32-bit float or 16-bit integer; anything else is an error."""
    parts = list(chunks(blob))
    formats, data = [c for n, c in parts if n == b"fmt "], [c for n, c in parts if n == b"data"]
    if len(data) != 1 or not formats or len(formats[0]) < 16:
        raise ValueError("one format and one data chunk are needed")
    code, channels, hertz, _, _, bits = struct.unpack_from("<HHIIHH", formats[0])
    if channels != 1 or hertz != rate or (code, bits) not in ((3, 32), (1, 16)):
        raise ValueError(f"unexpected format {(code, channels, hertz, bits)}")
    if len(data[0]) % (bits // 8):
        raise ValueError("ragged data")
    return np.frombuffer(data[0], "<f4") if code == 3 else np.frombuffer(data[0], "<i2").astype(np.float32) / 32768


def read_wav(spark: SparkSession, path: str, window: int = 1600) -> DataFrame:
    """(path, window_no, samples) of the files below ``path``, read wherever Spark reads."""

    @F.pandas_udf("array<struct<window_no:int,samples:array<float>>>")
    def cut(contents: pd.Series) -> pd.Series:
        def windows(blob: bytes) -> list[dict]:
            x = samples_of(blob)
            return [{"window_no": i // window, "samples": x[i : i + window].tolist()} for i in range(0, len(x), window)]

        return contents.map(windows)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.explode(cut("content")).alias("w")).select("path", "w.*")


class VoiceGate:
    """Forwards speech with what came shortly before it, up to and with the window in which it ended."""

    def __init__(self, rate: int = RATE, preroll_s: float = 0.35, window: int | None = None):
        self.keep = max(1, round(preroll_s * rate / window)) if window else round(preroll_s * rate)
        self.by_window, self.active, self.before = window is not None, False, []

    def accept(self, samples: np.ndarray, speech: bool) -> dict:
        x = np.asarray(samples, np.float32).reshape(-1)
        if not x.size:
            return {"forward": None, "started": False, "ended": False}
        started, ended = speech and not self.active, self.active and not speech
        forward = np.concatenate([*self.before, x]) if started else x if self.active else None
        if started:
            self.before = []
        self.before.append(x)
        if self.by_window:
            self.before = self.before[-self.keep :]
        elif self.keep:
            self.before = [np.concatenate(self.before)[-self.keep :]]
        else:
            self.before = []
        self.active = speech
        return {"forward": forward, "started": started, "ended": ended}
