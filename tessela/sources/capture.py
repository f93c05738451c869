"""Live capture: blocks of wave files that are still being written, as a stream source.

``spark.readStream.format("capture").option("path", folder)`` gives BLOCKS rows of the
files in a folder: an offset is the number of blocks of each clip, so a failed batch is
read again from its own offsets, and a restarted query goes on at its checkpoint.
A file whose header has no size yet is open: only its whole blocks count, until the
writer closes it.  Clips are cut into stretches of at most ``segmentblocks`` blocks, and short
ones share a partition of about as many.

``blockspertrigger`` bounds what a trigger takes of each clip.  The first trigger after a
restart does not know the position (Spark asks for the latest offset first) and takes all
that is there.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from . import audio, riff


class Stretches(InputPartition):
    """(clip, first, n): blocks first..first + n - 1 of files in a folder."""

    def __init__(self, folder: str, parts: list[tuple[str, int, int]]):
        self.folder, self.parts = folder, parts

    @property
    def first(self) -> int:
        return self.parts[0][1]

    @property
    def n(self) -> int:
        return sum(n for _, _, n in self.parts)


class CaptureReader(DataSourceStreamReader):
    def __init__(self, folder: str, block: int, limit: int, stretch: int):
        self.folder, self.block, self.limit, self.stretch = folder, block, limit, stretch
        self.at: dict[str, int] | None = None
        #: Size, time and blocks of files that are closed; these are not opened again.
        self.closed: dict[str, tuple[int, int, int]] = {}

    def available(self) -> dict[str, int]:
        """Blocks of every clip that can be read now."""
        system, folder = riff.place(self.folder)
        found = {}
        for entry in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if entry.is_file and not entry.base_name.startswith((".", "_")):
                size, changed, blocks = self.closed.get(entry.base_name, (None, None, 0))
                if (size, changed) != (entry.size, entry.mtime_ns):
                    with system.open_input_file(entry.path) as f:
                        w = riff.header(f)
                    if not w:
                        continue
                    blocks = -(-w.frames // self.block) if w.closed else w.frames // self.block
                    if w.closed:
                        self.closed[entry.base_name] = (entry.size, entry.mtime_ns, blocks)
                found[entry.base_name] = blocks
        return found

    def initialOffset(self) -> dict:
        self.at = {}
        return {"clips": json.dumps({})}

    def latestOffset(self) -> dict:
        found = self.available()
        if self.at is not None:
            # a clip never goes back, even when its file has gone
            found = self.at | {c: max(self.at.get(c, 0), min(n, self.at.get(c, 0) + self.limit)) for c, n in found.items()}
        self.at = found
        return {"clips": json.dumps(found, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Stretches]:
        before, after = json.loads(start["clips"]), json.loads(end["clips"])
        out, room = [], 0
        for clip, n in sorted(after.items()):
            for first in range(before.get(clip, 0), n, self.stretch):
                part = (clip, first, min(self.stretch, n - first))
                if part[2] > room:
                    out.append(Stretches(self.folder, []))
                    room = self.stretch
                out[-1].parts.append(part)
                room -= part[2]
        self.at = before | after
        return out

    def read(self, partition: Stretches) -> Iterator[pa.RecordBatch]:
        return audio.joined((self.blocks(f"{partition.folder}/{clip}", clip, first, n) for clip, first, n in partition.parts), self.block)

    def blocks(self, path: str, clip: str, first: int, n: int) -> pa.RecordBatch:
        with riff.opened(path) as f:
            w = riff.header(f)
            x = riff.read_frames(f, w, first * self.block, n * self.block)
        return audio.block_batch(clip, first, w.rate, x, self.block)


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return audio.BLOCKS

    def streamReader(self, schema) -> CaptureReader:
        get = self.options.get
        return CaptureReader(
            get("path").rstrip("/"), int(get("block", audio.BLOCK)), int(get("blockspertrigger", 1 << 40)), int(get("segmentblocks", 1024))
        )


def capture_stream(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The blocks of a folder as a stream.  The source travels by value: the process on the driver
    that plans it knows no added files."""
    for module in (sys.modules[__name__], audio, riff):
        register_pickle_by_value(module)
    spark.dataSource.register(CaptureSource)
    return spark.readStream.format("capture").options(path=folder, **options).load()
