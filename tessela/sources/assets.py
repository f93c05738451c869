"""JSON assets: vocabularies, token tables and passages."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of weight files that the driver reads at once.
MOST_BYTES = 200_000_000


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) rows of one JSON object with arbitrary keys."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>", {"mode": "FAILFAST"})).alias("key", "value"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, token) of an object id -> token."""
    return json_map(spark, path, "string").select(F.col("key").cast("int").alias("id"), F.col("value").alias("token"))


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """(grp, pos, pos_end, ids) of an object "grp:pos:pos_end" -> ids."""
    part = lambda i: F.element_at(F.split("key", ":"), i).cast("int")
    return json_map(spark, path, "array<int>").select(part(1).alias("grp"), part(2).alias("pos"), part(3).alias("pos_end"), F.col("value").alias("ids"))


def passages(spark: SparkSession, path: str) -> DataFrame:
    """(grp, pos, text) of a JSON array of records."""
    return spark.read.schema("grp int, pos int, text string").json(path, multiLine=True)


def decode_mismatches(decoded: DataFrame, corpus: DataFrame) -> DataFrame:
    """Data quality: passages without token ids, or whose decoded tokens differ from the
    text.  ``decoded`` is (grp, pos, ids, text)."""
    both = corpus.select("grp", "pos", F.col("joined").alias("expected")).join(decoded, ["grp", "pos"], "left")
    none = F.coalesce(F.size("ids"), F.lit(0)) <= 0
    wrong = (F.coalesce("text", F.lit("")) != "") & (F.col("expected") != "") & (F.col("text") != F.col("expected"))
    return both.filter(none | wrong).select("grp", "pos", F.when(none, "no token ids").otherwise("decoded text differs").alias("problem"))


def layer_weights(spark: SparkSession, folder: str, manifest: str = "model.json", prefix: str = "") -> DataFrame:
    """(name, shape, values) of the single precision weights of a saved network: the manifest
    lists groups of binary files and, in order, what lies in them.  Names lose ``prefix``, and
    normalisation layers count as parts of the layer in front."""
    groups = json.loads(spark.read.text(f"{folder}/{manifest}", wholetext=True).first()[0])["weightsManifest"]
    parts = spark.read.format("binaryFile").load([f"{folder}/{p}" for g in groups for p in g["paths"]])
    if (total := parts.agg(F.sum("length")).first()[0] or 0) > MOST_BYTES:
        raise ValueError(f"{total} bytes of weights; at most {MOST_BYTES} are read at once")
    content = {r.path.rpartition("/")[2]: bytes(r.content) for r in parts.select("path", "content").collect()}
    rows = []
    for group in groups:
        raw, at = b"".join(content[p.rpartition("/")[2]] for p in group["paths"]), 0
        for w in group["weights"]:
            n = math.prod(w["shape"])
            if w["dtype"] != "float32":
                raise ValueError(f"{w['name']}: {w['dtype']} weights are not read")
            name = w["name"].removeprefix(prefix).replace("_BN/", "/")
            rows.append((name, list(w["shape"]), np.frombuffer(raw, "<f4", n, at).tolist()))
            at += 4 * n
    return spark.createDataFrame(rows, "name string, shape array<int>, values array<float>")
