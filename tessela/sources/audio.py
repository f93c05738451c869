"""Audio files as clips, and as blocks of their samples.

Blocks are read in parts: files are listed without their content, a task reads a file's
header, and the ranges of blocks that a query wants are planned as rows (about
``SEGMENT_BYTES`` each), dealt to tasks and read alone.  So a long file is read by many tasks, many
short ones by a few, a time range reads its own bytes, and a query without samples reads none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import riff

BLOCK = 4096
SEGMENT_BYTES = 8 << 20
#: What opening a file costs, in bytes read.
OPEN_BYTES = 32 << 10
#: Values of a batch that a task hands over.
BATCH_VALUES = 1 << 18
HEADERS = "clip_id string, sr int, channels int, width int, floating boolean, data_at long, frames long, closed boolean"
BLOCKS = "clip_id string, seq long, t double, sr int, samples array<double>"


def headers(spark: SparkSession, path: str) -> DataFrame:
    """One row of HEADERS for every file (clip_id is its path); a file that is no readable
    wave file has nulls, and one without a byte is not listed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in HEADERS.split(", ")]
        for batch in batches:
            rows = []
            for clip in batch.path:
                with riff.opened(clip) as f:
                    w = riff.header(f)
                rows.append((clip, *(w if w else (None,) * 7)))
            yield pd.DataFrame(rows, columns=names).astype({"sr": "Int32", "channels": "Int32", "width": "Int32", "floating": "boolean", "data_at": "Int64", "frames": "Int64", "closed": "boolean"})

    files = spark.read.format("binaryFile").load(path).select("path")
    # Spark plans some thirty files a task, as if they were read whole
    tasks = max(4 * spark.sparkContext.defaultParallelism, files.rdd.getNumPartitions() // 16)
    return files.coalesce(tasks).mapInPandas(run, HEADERS)


def segments(found: DataFrame, block: int, start: Column | None, end: Column | None, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """HEADERS and (first, n): the ranges of blocks that touch the seconds start..end."""
    blocks = F.ceil(F.col("frames") / block)
    first = F.greatest(F.floor(start * F.col("sr") / block), F.lit(0)) if start is not None else F.lit(0)
    last = F.least(F.ceil(end * F.col("sr") / block), blocks) if end is not None else blocks
    wanted = found.filter("frames > 0").withColumns({"from": first.cast("long"), "to": last.cast("long")}).filter(F.col("from") < F.col("to"))
    each = F.greatest(F.floor(F.lit(segment_bytes) / (block * F.col("channels") * F.col("width"))), F.lit(1)).cast("long")
    parts = wanted.withColumn("each", each).withColumn("first", F.explode(F.expr("sequence(from, to - 1, each)")))
    return parts.withColumn("n", F.least("each", F.col("to") - F.col("first"))).drop("from", "to", "each")


def audio_blocks(
    spark: SparkSession, path: str, block: int = BLOCK, start: Column | None = None, end: Column | None = None, with_samples: bool = True, segment_bytes: int = SEGMENT_BYTES
) -> DataFrame:
    """BLOCKS rows of the files under ``path``: the first channel in blocks of ``block`` samples
    (the last one shorter), those that touch the seconds start..end.  ``with_samples=False``
    leaves the samples out and reads headers only."""
    parts = segments(headers(spark, path), block, start, end, segment_bytes)
    if not with_samples:
        each = parts.withColumn("seq", F.explode(F.expr("sequence(first, first + n - 1)")))
        return each.select("clip_id", "seq", (F.col("seq") * block / F.col("sr")).alias("t"), "sr")
    fields = ["sr", "channels", "width", "floating", "data_at", "frames", "closed"]

    def each_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                w = riff.Wave(*(row[c] for c in fields))
                with riff.opened(row["clip_id"]) as f:
                    x = riff.read_frames(f, w, row["first"] * block, row["n"] * block)
                yield block_batch(row["clip_id"], row["first"], w.rate, x, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return joined(each_part(batches), block)

    from ..scratch import written  # here, as the module travels by value to where the package is not

    # headers are read once: the plan of the parts is a table
    plan = written(parts.select("clip_id", *fields, "first", "n"), "audio-parts")
    cost = F.sum(F.col("n") * block * F.col("channels") * F.col("width") + OPEN_BYTES)
    n, size = plan.agg(F.count(F.lit(1)), cost).first()
    tasks = max(1, min(n, spark.sparkContext.defaultParallelism), -(-(size or 0) // SEGMENT_BYTES))
    return plan.repartition(tasks).mapInArrow(run, BLOCKS)


def joined(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Short batches of BLOCKS rows put together."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows * block >= BATCH_VALUES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def block_batch(clip: str, first: int, rate: int, x: np.ndarray, block: int) -> pa.RecordBatch:
    """BLOCKS rows of consecutive samples from block ``first`` on."""
    cuts = np.append(np.arange(0, len(x), block), len(x)).astype(np.int32)
    seq = np.arange(first, first + len(cuts) - 1)
    columns = [pa.array([clip] * len(seq), pa.string()), pa.array(seq, pa.int64()), pa.array(seq * block / rate, pa.float64()), pa.array([rate] * len(seq), pa.int32())]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(cuts), pa.array(x))], [f.split()[0] for f in BLOCKS.split(", ")])


def audio_clips(spark: SparkSession, path: str) -> DataFrame:
    """clip_id (the file's path), sr, samples, duration of every wave file, each whole in one
    row; files that cannot be decoded have nulls."""
    schema = "clip_id string, sr int, samples array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for clip in batch.column(0).to_pylist():
                with riff.opened(clip) as f:
                    w = riff.header(f)
                    x = riff.read_frames(f, w, 0, w.frames) if w else None
                yield pa.RecordBatch.from_pylist([{"clip_id": clip, "sr": w and w.rate, "samples": x}], pa.schema([("clip_id", pa.string()), ("sr", pa.int32()), ("samples", pa.list_(pa.float64()))]))

    clips = spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, schema)
    return clips.withColumn("duration", F.size("samples") / F.col("sr"))


def write_clips(clips: DataFrame, folder: str, share: float = 1.0, closed: bool = True) -> int:
    """Writes (clip_id, sr, samples) as 16-bit files ``<clip_id>.wav``, each by the task that
    holds it; returns how many.  With ``share`` only the beginning of each, ``closed`` False as
    a writer leaves them that goes on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, at = riff.place(folder)
        system.create_dir(at, recursive=True)
        for batch in batches:
            for clip, rate, x in zip(batch.clip_id, batch.sr, batch.samples, strict=True):
                with system.open_output_stream(f"{at}/{clip}.wav") as f:
                    f.write(riff.written_wave(np.asarray(x, np.float64)[: int(len(x) * share)], int(rate), closed))
            yield pd.DataFrame({"n": [len(batch)]})

    return clips.select("clip_id", "sr", "samples").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0
