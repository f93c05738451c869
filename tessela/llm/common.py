"""What several corpus operators share: table access, text normalisation, joins with
checked broadcasts and tokenizer files.

Text convention: a null text counts as empty.  Identifier convention: rows are
told apart by their position in a written table (``rid``), so null or repeated
``doc_id`` values never merge two rows by accident.  Operators select the columns they
read at once; those that give back whole rows name their own columns by ``unused``.
"""

from __future__ import annotations

import contextlib
import zlib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop_table, scratch, shared_dir, written

__all__ = ["drop_table", "scratch", "shared_dir", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, or a longer one that no column of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only.  ``lower`` does just that, and faster, on pure ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def held_out(c: Column) -> Column:
    """crc32 of the decimal doc_id, modulo 4, is 2; a null doc_id is not held out."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def py_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


#: Ids up to this number (8 MB of longs) are broadcast; more go by a shuffled join.
BROADCAST_IDS = 1_000_000


def filter_by(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` semi- or anti-joined (``how``) with the written table ``ids`` on its
    columns, null-safe.  The side is broadcast only after its rows were counted."""
    on = None
    for c in ids.columns:
        term = docs[c].eqNullSafe(ids[c])
        on = term if on is None else on & term
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")
    return docs.join(side, on, how)


#: A key is hot when it holds 1/HOT_SHARE of the rows; so there are at most HOT_SHARE.
HOT_SHARE = 1000


def attach(rows: DataFrame, verdict: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` left-joined with ``verdict`` (one row per ``key``; ``size`` is the number
    of rows with it).  Hot keys are joined by broadcast, so no shuffled key is large;
    rows with a null key get null."""
    n = rows.count()
    hot = verdict.filter(F.col(size) * HOT_SHARE >= n).withColumn("__hot", F.lit(True)).limit(HOT_SHARE)
    first = rows.join(F.broadcast(hot), key, "left")
    known = first.filter("__hot").drop("__hot")
    rest = first.filter("__hot is null").select(*rows.columns)
    cold = verdict.filter(F.col(size) * HOT_SHARE < n)
    return known.unionByName(rest.join(cold, key, "left"))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Arrow batches of at most ``n`` rows for what is executed inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tokenizer_bytes(path: str) -> bytes:
    """A tokenizer file's content, read by the driver; executors get it by broadcast."""
    return Path(path).read_bytes()


def default_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
