"""Framing and sampling of clips: (clip_id, sr, samples) rows, one clip each.

Frames are slices of the clip's own array, so nothing is shuffled; a clip of many hours
should be cut into rows by ``fixed_chunks`` first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME, HOP, CHUNK_SECONDS = 1024, 640, 30
VOICED_FRAME_MS, VOICED_RMS, VOICED_MIN_MS = 30, 0.003, 300


def padded(frame: Column, size: int) -> Column:
    """The frame with zeros behind it up to ``size`` values."""
    short = F.greatest(F.lit(size) - F.size(frame), F.lit(0))
    return F.concat(frame, F.array_repeat(F.lit(0.0), short))


def sliding_frames(clips: DataFrame, size: int = FRAME, hop: int = HOP, rate: float = 16000.0) -> DataFrame:
    """clip_id, frame_no, t, frame: max(1, floor((n - size) / hop) + 1) frames; only a
    clip shorter than one frame is padded."""
    n = F.size("samples")
    count = F.greatest(F.floor((n - size) / hop) + 1, F.lit(1)).cast("int")
    numbered = clips.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("frame_no"))
    frame = padded(F.slice(F.col("samples").cast("array<double>"), F.col("frame_no") * hop + 1, F.lit(size)), size)
    return numbered.select("clip_id", "frame_no", (F.col("frame_no") * hop / F.lit(rate)).alias("t"), frame.alias("frame"))


def even_frames(clips: DataFrame, size: int = FRAME, per_second: float = 35.0) -> DataFrame:
    """clip_id, frame_no, t, frame: 80 to 900 frames evenly over the clip's duration,
    padded past its end."""
    n, sr = F.size("samples"), F.col("sr").cast("double")
    duration = n / sr
    points = F.least(F.greatest(F.floor(duration * per_second + 0.5), F.lit(80)), F.lit(900)).cast("int")
    rows = clips.select("*", points.alias("points"), duration.alias("duration")).select("*", F.explode(F.sequence(F.lit(0), F.col("points") - 1)).alias("frame_no"))
    t = F.col("frame_no") / (F.col("points") - 1) * F.col("duration")
    start = F.floor(t * F.col("sr")).cast("int")
    frame = padded(F.slice(F.col("samples").cast("array<double>"), start + 1, F.lit(size)), size)
    return rows.select("clip_id", "frame_no", t.alias("t"), frame.alias("frame"))


def fixed_chunks(clips: DataFrame, seconds: int = CHUNK_SECONDS) -> DataFrame:
    """clip_id, chunk_no, samples: max(1, ceil(n / size)) consecutive chunks."""
    size = (F.col("sr") * seconds).cast("int")
    count = F.greatest(F.ceil(F.size("samples") / size), F.lit(1)).cast("int")
    rows = clips.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_no"))
    return rows.select("clip_id", "sr", "chunk_no", F.slice("samples", F.col("chunk_no") * size + 1, size).alias("samples"))


def voiced_ms(samples: Column, rate: int = 16000, frame_ms: int = VOICED_FRAME_MS, threshold: float = VOICED_RMS) -> Column:
    """Milliseconds in whole frames whose mean square exceeds the squared threshold."""
    size = max(1, int(rate * frame_ms / 1000 + 0.5))
    starts = F.sequence(F.lit(0), F.floor(F.size(samples) / size).cast("int"))
    loud = F.filter(
        starts,
        lambda k: ((k + 1) * size <= F.size(samples))
        & (F.aggregate(F.slice(samples.cast("array<double>"), k * size + 1, F.lit(size)), F.lit(0.0), lambda a, x: a + x * x) / size > threshold * threshold),
    )
    return F.size(loud) * frame_ms


def has_speech(samples: Column, least_ms: int = VOICED_MIN_MS, **how) -> Column:
    return voiced_ms(samples, **how) >= least_ms


def last_frame(block: Column, size: int = FRAME) -> Column:
    """The last ``size`` samples of a live block, zeros in front."""
    kept = F.slice(block.cast("array<double>"), F.greatest(F.size(block) - size, F.lit(0)) + 1, F.lit(size))
    return F.concat(F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(block), F.lit(0))), kept)
