"""Driver tables as operator inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stand-in letters: Latin text becomes letters of the script that the normalisers fold.
LATIN, SCRIPT = "abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقكلمنه"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pitch_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, seq, t, freq, rms from ``events``."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = load(spark, sf_dir, "events").select(
        F.col("user_id").alias("clip_id"), F.col("event_id").alias("seq"), micros.alias("us"), F.col("value").alias("freq"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("rms"),
    )
    first = rows.groupBy("clip_id").agg(F.min("us").alias("u0"))
    return rows.join(first, "clip_id").select("clip_id", "seq", ((F.col("us") - F.col("u0")) / 1e6).alias("t"), "freq", "rms")


def clips(spark: SparkSession, sf_dir: str, rate: int = 25) -> DataFrame:
    """clip_id, sr, samples: a user's values in order, scaled to about -1..1."""
    rows = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("clip_id")).agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("x"))
    return rows.select("clip_id", F.lit(rate).alias("sr"), F.transform("x.value", lambda v: v / 250.0 - 1.0).alias("samples"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, t, lp from ``embeddings``."""
    return load(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("clip_id"), F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("lp")
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grp, pos, display, joined, short from ``conversations``."""
    rows = load(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("grp"), F.col("turn").alias("pos"), F.col("text").alias("display"), F.col("text").alias("joined"), F.lit(None).cast("string").alias("short"))


def benchmark_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passages in groups of five."""
    rows = load(spark, sf_dir, "benchmark")
    grp, pos = F.floor(F.col("item_id") / 5).cast("long"), (F.col("item_id") % 5 + 1).cast("long")
    return rows.select(grp.alias("grp"), pos.alias("pos"), F.col("text").alias("display"), F.col("text").alias("joined"), F.lit(None).cast("string").alias("short"))


def scripted(text):
    """Lower-case Latin letters replaced by letters of the folded script."""
    return F.translate(F.lower(text), LATIN, SCRIPT)
