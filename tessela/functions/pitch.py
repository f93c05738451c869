"""Arrow-batched numeric kernels that have no expression form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Gates of the autocorrelation detector.
QUIET, TRIM, LOWEST, HIGHEST = 0.004, 0.2, 60.0, 700.0
#: Log-mel features (16 kHz, 30 s).
N_FFT, HOP, MELS, FRAMES, RATE = 400, 160, 80, 3000, 16000


def pitch_of(samples: np.ndarray, rate: float) -> tuple[float, float, float]:
    """(freq, clarity, rms) by autocorrelation; freq is -1 where no pitch is found."""
    x = np.asarray(samples, dtype=np.float64)
    n = len(x)
    loud = float(np.sqrt(np.mean(x * x))) if n else 0.0
    if n == 0 or loud < QUIET:
        return -1.0, 0.0, loud
    half = (n + 1) // 2
    quiet = np.abs(x) < TRIM
    front = np.flatnonzero(quiet[:half])
    back = np.flatnonzero(quiet[::-1][: max(0, half - 1)])
    part = x[front[0] if len(front) else 0 : n - 1 - back[0] if len(back) else n - 1]
    m = len(part)
    if m < 8:
        return -1.0, 0.0, loud
    c = np.correlate(part, part, "full")[m - 1 :].astype(np.float32).astype(np.float64)
    rising = np.flatnonzero(c[:-1] <= c[1:])
    d = int(rising[0]) if len(rising) else m - 1
    peak = d + int(np.argmax(c[d:]))
    if peak <= 0 or c[peak] <= -1 or c[0] == 0:
        return -1.0, 0.0, loud
    clarity = float(c[peak] / c[0])
    x1, x2, x3 = c[peak - 1], c[peak], c[peak + 1] if peak + 1 < m else 0.0
    a, b = (x1 + x3 - 2 * x2) / 2, (x3 - x1) / 2
    lag = peak - b / (2 * a) if a else float(peak)
    freq = rate / lag
    return (float(freq), clarity, loud) if LOWEST <= freq <= HIGHEST else (-1.0, clarity, loud)


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("freq", "clarity", "rms")]))
def detect_pitch(samples: pd.Series, rate: pd.Series) -> pd.DataFrame:
    rows = [pitch_of(s, r) for s, r in zip(samples, rate, strict=True)]
    return pd.DataFrame(rows, columns=["freq", "clarity", "rms"])


def mel_filters(mels: int = MELS, n_fft: int = N_FFT, rate: int = RATE) -> np.ndarray:
    """Triangles evenly spaced on the mel scale 2595 log10(1 + f / 700)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    at = (n_fft + 1) * hz / rate
    k = np.arange(n_fft // 2 + 1)[None, :]
    lo, mid, hi = at[:-2, None], at[1:-1, None], at[2:, None]
    return np.maximum(0.0, np.minimum((k - lo) / (mid - lo), (hi - k) / (hi - mid)))


def log_mel_of(samples: np.ndarray, frames: int = FRAMES) -> np.ndarray:
    """Mels by frames: padded or cut to frames * hop, reflected at the ends, power,
    log10, clamped at 8 below the maximum of the clip, then (x + 4) / 4."""
    n = frames * HOP
    x = np.zeros(n)
    s = np.asarray(samples, dtype=np.float64)[:n]
    x[: len(s)] = s
    x = np.pad(x, N_FFT // 2, mode="reflect")
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(N_FFT) / (N_FFT - 1))
    cut = np.lib.stride_tricks.sliding_window_view(x, N_FFT)[::HOP][:frames]
    power = np.abs(np.fft.rfft(cut * window, axis=1)) ** 2
    out = np.log10(np.maximum(mel_filters() @ power.T, 1e-10))
    return (np.maximum(out, out.max() - 8.0) + 4.0) / 4.0


def log_mels(frames: int):
    """``log_mel_of`` with that many frames, in Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def run(samples: pd.Series) -> pd.Series:
        return pd.Series([log_mel_of(s, frames).tolist() for s in samples])

    return run


log_mel = log_mels(FRAMES)
