"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Set to a folder when a local session (tests) names no spark.checkpoint.dir.
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.  A session that names none may
    only be a local one, where any folder is shared."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="spark-tessela-"))
    return _local[0]


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives
    the loss of executors and fixes everything that is not deterministic."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder through Spark's file system layer."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def drop_table(df: DataFrame) -> None:
    """Deletes a table that ``written`` made and that nothing will read again."""
    drop_path(df.sparkSession, df.scratch_path)
