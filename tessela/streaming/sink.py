"""A table sink of a stream that shows every micro-batch once.

Tasks write Parquet files under names of their own and tell the driver; the driver commits
a batch by one manifest that lists them.  Readers see listed files only, so what a lost
task or a driver killed before the commit left behind does not count; a batch that runs
again after its commit finds its manifest and takes its new files away.  Files go
through ``pyarrow.fs``, manifests appear by a rename.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..sources import riff

MANIFEST = "batch long, rows long, parts array<string>"


@dataclass
class Part(WriterCommitMessage):
    """A written file of the folder, or none if there was nothing to write."""

    name: str | None
    rows: int


class BatchWriter(DataSourceStreamArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def system(self) -> tuple[fs.FileSystem, str]:
        return riff.place(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, folder = self.system()
        system.create_dir(f"{folder}/parts", recursive=True)
        name, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if batch.num_rows:
                out = out or pq.ParquetWriter(f"{folder}/parts/{name}", batch.schema, filesystem=system)
                out.write_batch(batch)
                rows += batch.num_rows
        if out is None:
            return Part(None, 0)
        out.close()
        return Part(name, rows)

    def drop(self, messages: list[Part | None]) -> None:
        system, folder = self.system()
        for m in messages:
            if m is not None and m.name:
                system.delete_file(f"{folder}/parts/{m.name}")

    def commit(self, messages: list[Part | None], batchId: int) -> None:
        system, folder = self.system()
        manifest = f"{folder}/commits/{batchId}.json"
        if system.get_file_info(manifest).type != fs.FileType.NotFound:
            self.drop(messages)
            return
        parts = [m for m in messages if m is not None and m.name]
        system.create_dir(f"{folder}/commits", recursive=True)
        draft = f"{folder}/commits/.{batchId}-{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as f:
            f.write(json.dumps({"batch": batchId, "rows": sum(m.rows for m in parts), "parts": [m.name for m in parts]}).encode())
        system.move(draft, manifest)

    def abort(self, messages: list[Part | None], batchId: int) -> None:
        self.drop(messages)


class BatchTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "batch_table"

    def streamWriter(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options["path"].rstrip("/"))


def table_stream(rows: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer of the stream ``rows`` to the table in ``folder``, to be triggered and started.
    The sink travels by value, as stream processes on the driver know no added files."""
    for module in (sys.modules[__name__], riff):
        register_pickle_by_value(module)
    rows.sparkSession.dataSource.register(BatchTable)
    return rows.writeStream.format("batch_table").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, rows, parts) of every committed batch."""
    return spark.read.schema(MANIFEST).json(f"{folder}/commits/*.json")


def read_table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all committed batches: listed files only."""
    listed = committed(spark, folder).select(F.explode("parts").alias("part"))
    rows = spark.read.schema(schema).parquet(f"{folder}/parts")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    kept = rows.withColumn("__part", name).join(listed, F.col("__part") == F.col("part"), "left_semi")
    return kept.drop("__part")
