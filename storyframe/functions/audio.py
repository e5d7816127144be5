"""Audio samples: WAV bytes, resampling and level."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

RATE = 24_000


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Mono float samples in [-1, 1] and the rate, of 8, 16 or 32-bit WAV."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(np.float64) / float(1 << (8 * width - 1))
    else:
        raise ValueError(f"samples of {8 * width} bits aren't supported")
    return x.reshape(-1, channels).mean(1).astype(np.float32), rate


def write_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def pcm_bytes(samples) -> bytes:
    return np.asarray(samples).astype("<i2").tobytes()


def levelled(samples: Column, gain: float = 1.0, level: float = 0.75) -> Column:
    """Samples at ``level`` of their peak, times gain, clipped, as truncated 16-bit integers."""
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    scale = F.when(peak > 0, F.lit(level * gain) / peak).otherwise(0.0)
    return F.transform(samples, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * scale)) * 32767).cast("int"))


def resampled(samples: Column, source: int, target: int) -> Column:
    """Samples at another rate, between neighbours in a straight line; one sample at least of any that are there."""
    if source == target:
        return samples
    n = F.size(samples)
    m = F.greatest(F.lit(1), F.rint(n / source * target).cast("int"))
    step = F.when(m > 1, (n - 1) / (m - 1)).otherwise(F.lit(0.0))

    def between(k: Column) -> Column:
        place = F.when((k == m - 1) & (m > 1), (n - 1).cast("double")).otherwise(k * step)
        low = F.least(F.floor(place), n - 1).cast("int")
        a, b = F.get(samples, low).cast("double"), F.get(samples, F.least(low + 1, n - 1)).cast("double")
        return ((b - a) * (place - low) + a).cast("float")

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), m - 1), between)).otherwise(samples)


@pandas_udf(ArrayType(FloatType()))
def wav_samples(s: pd.Series) -> pd.Series:
    return s.map(lambda b: None if b is None else read_wav(bytes(b))[0].tolist())
