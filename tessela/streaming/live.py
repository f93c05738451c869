"""The live capture as Structured Streaming: a decayed running maximum of loudness per
clip gates the blocks.

Blocks are (clip_id, seq, t, rms, freq, clarity).  The maximum starts at 0 and becomes
max(decay * maximum, rms) with every block in ``seq`` order; a block is voiced if its rms
reaches ``gate`` times the maximum and its clarity passes.  A slow consumer is held back
by the source's rate (``maxFilesPerTrigger``), or sheds load: while the model works on a block
of a clip, that clip's blocks are left out, and do not count for its maximum either
(``shed_stream``, in front of the gate).

State is a few numbers per clip in the state store, so a restarted query goes on where
it stopped.  The batch form has a closed expression over a window.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DECAY, GATE = 0.985, 0.28
MODEL_CONFIDENCE, FALLBACK_CLARITY = 0.5, 0.3
BLOCKS = "clip_id long, seq long, t double, rms double, freq double, clarity double"
SHED = BLOCKS + ", taken boolean, dropped long"
BLOCK_NAMES = [f.split()[0] for f in BLOCKS.split(", ")]
GATED = "clip_id long, seq long, t double, rms double, freq double, peak double, voiced boolean"


def passes(freq, clarity, model: bool):
    """The gate on clarity: the model's confidence must exceed 0.5; the fallback's
    clarity must reach 0.3 and its frequency be positive.  Works on columns and frames."""
    return clarity > MODEL_CONFIDENCE if model else (clarity >= FALLBACK_CLARITY) & (freq > 0)


def gated_batch(blocks: DataFrame, model: bool = False) -> DataFrame:
    """GATED rows: with i the block's place, the maximum is decay^i times the greatest
    rms / decay^i so far, in logarithms so that long clips do not overflow."""
    w = W.partitionBy("clip_id").orderBy("seq")
    i = F.row_number().over(w) - 1
    step = F.log(F.lit(DECAY))
    level = F.when(F.col("rms") > 0, F.log("rms") - F.col("i") * step)
    peak = F.coalesce(F.exp(F.max("level").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("i") * step), F.lit(0.0))
    rows = blocks.withColumn("i", i).withColumn("level", level).withColumn("peak", peak)
    voiced = (F.col("rms") >= F.col("peak") * GATE) & passes(F.col("freq"), F.col("clarity"), model)
    return rows.select("clip_id", "seq", "t", "rms", "freq", "peak", voiced.alias("voiced"))


class DecayedPeak(StatefulProcessor):
    """Keeps each clip's maximum between micro-batches."""

    def __init__(self, model: bool = False):
        self.model = model

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.peak = handle.getValueState("peak", "peak double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        peak = self.peak.get()[0] if self.peak.exists() else 0.0
        batch = pd.concat(list(rows)).sort_values("seq")
        peaks = []
        for x in batch.rms:
            peak = max(DECAY * peak, x)
            peaks.append(peak)
        self.peak.update((peak,))
        out = batch[["clip_id", "seq", "t", "rms", "freq"]].copy()
        out["peak"] = peaks
        out["voiced"] = (batch.rms >= out.peak * GATE) & passes(batch.freq, batch.clarity, self.model)
        yield out

    def close(self) -> None:
        pass


def block_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Blocks from Parquet files that arrive in a folder."""
    return spark.readStream.schema(BLOCKS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def gated_stream(blocks: DataFrame, model: bool = False) -> DataFrame:
    """GATED rows of a stream, in append mode.  Needs the RocksDB state store.  The
    processor travels by value: the driver-side runner of a stream knows no added files."""
    register_pickle_by_value(sys.modules[__name__])
    return blocks.groupBy("clip_id").transformWithStateInPandas(
        statefulProcessor=DecayedPeak(model), outputStructType=GATED, outputMode="Append", timeMode="None"
    )


def shed_rows(rows: pd.DataFrame, free: float, dropped: int, service: float) -> tuple[pd.DataFrame, float, int]:
    """A clip's blocks in ``seq`` order with taken and dropped, when the model is free from
    ``free`` on and needs ``service`` seconds for a block."""
    out = rows.sort_values("seq")
    taken, counts = [], []
    for t in out.t:
        takes = t >= free
        free, dropped = (t + service, dropped) if takes else (free, dropped + 1)
        taken.append(takes)
        counts.append(dropped)
    return out[BLOCK_NAMES].assign(taken=taken, dropped=counts), free, dropped


class OneInFlight(StatefulProcessor):
    """Keeps of each clip when the model is free again, and how many blocks were dropped."""

    def __init__(self, service: float):
        self.service = service

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flight = handle.getValueState("flight", "free double, dropped long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        free, dropped = self.flight.get() if self.flight.exists() else (-math.inf, 0)
        out, free, dropped = shed_rows(pd.concat(list(rows)), free, dropped, self.service)
        self.flight.update((free, dropped))
        yield out

    def close(self) -> None:
        pass


def shed_stream(blocks: DataFrame, service: float) -> DataFrame:
    """SHED rows of a stream of BLOCKS: one block of a clip is in flight at a time, for
    ``service`` seconds on the clock of ``t``; blocks that arrive meanwhile are not ``taken``, and
    ``dropped`` counts those of the clip so far.  Blocks of a clip arrive in ``seq`` order."""
    register_pickle_by_value(sys.modules[__name__])
    return blocks.groupBy("clip_id").transformWithStateInPandas(
        statefulProcessor=OneInFlight(service), outputStructType=SHED, outputMode="Append", timeMode="None"
    )


def shed_batch(blocks: DataFrame, service: float) -> DataFrame:
    """The same of a table."""
    return blocks.groupBy("clip_id").applyInPandas(lambda rows: shed_rows(rows, -math.inf, 0, service)[0], SHED)


def to_curve(gated: DataFrame) -> DataFrame:
    """clip_id, t, seq, semi of the live curve."""
    from ..functions.arrays import hz_to_midi

    return gated.select("clip_id", "t", "seq", F.when(F.col("voiced"), hz_to_midi(F.col("freq"))).alias("semi"))
