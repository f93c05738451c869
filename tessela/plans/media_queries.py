"""Registered queries of the audio sources, with their DuckDB SQL: users' values become wave
files, which are read back in parts and as a live stream."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import arrays, pitch, resample
from ..operators import decoding, network
from ..scratch import drop_path, scratch, written
from ..sources import audio, capture
from ..streaming import live, sink
from . import fixtures as fx
from .queries import POINTS, live_blocks, query, r6, rocksdb_state, s6

#: Samples of a block, and samples per second, of these small files.
SIZE, RATE = 16, 25

BLOCKS_SQL = f"""q AS (SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i,
        least(greatest(floor((value / 250.0 - 1.0) * 32768 + 0.5), -32768), 32767) / 32768.0::DOUBLE AS x FROM events),
    b AS (SELECT clip_id, CAST(i // {SIZE} AS BIGINT) AS seq, count(*) AS n, sqrt(avg(x * x)) AS rms FROM q GROUP BY 1, 2)"""


def measured(blocks):
    clip = F.regexp_extract("clip_id", r"([^/]*)\.wav$", 1).cast("long")
    return blocks.select(clip.alias("clip_id"), "seq", r6("t").alias("t"), F.size("samples").cast("long").alias("n"), r6(arrays.rms(F.col("samples"))).alias("rms"))


@query(f"""WITH {BLOCKS_SQL} SELECT clip_id, seq, {s6(f'seq * {SIZE} / {RATE}.0::DOUBLE')} AS t, n, {s6('rms')} AS rms FROM b""")
def recorded_blocks(spark, sf_dir):
    """Wave files read in ranges of blocks."""
    folder = scratch(spark, "recordings")
    audio.write_clips(fx.clips(spark, sf_dir, RATE), folder)
    got = written(measured(audio.audio_blocks(spark, folder, SIZE, segment_bytes=1024)), "recorded-blocks")
    drop_path(spark, folder)
    return got


@query(f"""WITH {BLOCKS_SQL} SELECT clip_id, seq, {s6(f'seq * {SIZE} / {RATE}.0::DOUBLE')} AS t, n, {s6('rms')} AS rms FROM b
    WHERE seq * {SIZE} < 2 * {RATE} AND (seq + 1) * {SIZE} > 1 * {RATE}""")
def recorded_range(spark, sf_dir):
    """The blocks that touch the seconds 1 to 2."""
    folder = scratch(spark, "recordings")
    audio.write_clips(fx.clips(spark, sf_dir, RATE), folder)
    got = written(measured(audio.audio_blocks(spark, folder, SIZE, F.lit(1), F.lit(2))), "recorded-range")
    drop_path(spark, folder)
    return got


@query(f"""WITH {BLOCKS_SQL} SELECT clip_id, seq, {s6(f'seq * {SIZE} / {RATE}.0::DOUBLE')} AS t, n, {s6('rms')} AS rms FROM b""")
def captured_blocks(spark, sf_dir):
    """The same as a stream: one run over files that are still written, a second, from the
    first one's checkpoint, when they are closed."""
    base = scratch(spark, "capture")
    clips = written(fx.clips(spark, sf_dir, RATE), "capture-clips")
    for share, closed in ((0.4, False), (1.0, True)):
        audio.write_clips(clips, f"{base}/in", share, closed)
        blocks = capture.capture_stream(spark, f"{base}/in", block=SIZE)
        run = blocks.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return measured(spark.read.schema(audio.BLOCKS).parquet(f"{base}/out"))


#: Seconds that a block keeps the model busy.
SERVICE = 200_000.0


@query(f"""WITH RECURSIVE {POINTS}, b AS (SELECT clip_id, seq, t, rms, row_number() OVER (PARTITION BY clip_id ORDER BY seq) AS i FROM pts),
    f AS (SELECT clip_id, i, seq, t, rms, true AS taken, t + {SERVICE} AS free, 0 AS dropped, CAST(rms AS DOUBLE) AS peak FROM b WHERE i = 1
          UNION ALL SELECT b.clip_id, b.i, b.seq, b.t, b.rms, b.t >= f.free, CASE WHEN b.t >= f.free THEN b.t + {SERVICE} ELSE f.free END,
                           f.dropped + CASE WHEN b.t >= f.free THEN 0 ELSE 1 END, CASE WHEN b.t >= f.free THEN greatest(0.985 * f.peak, b.rms) ELSE f.peak END
          FROM f JOIN b ON b.clip_id = f.clip_id AND b.i = f.i + 1)
    SELECT clip_id, seq, CAST(dropped AS BIGINT) AS dropped, {s6('peak + 1.23456789e-8')} AS peak FROM f WHERE taken""")
def shed_blocks_stream(spark, sf_dir):
    """Blocks that the model takes while it works on one at a time, and the running maximum of
    these alone."""
    base = scratch(spark, "shed")
    with rocksdb_state(spark):
        live_blocks(spark, sf_dir).write.parquet(f"{base}/in")
        shed = live.shed_stream(live.block_stream(spark, f"{base}/in", 1000), SERVICE).filter("taken")
        run = shed.writeStream.format("parquet").option("path", f"{base}/taken").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        taken = spark.read.schema(live.SHED).parquet(f"{base}/taken")
    gated = live.gated_batch(taken.select(*live.BLOCK_NAMES), model=True).select("clip_id", "seq", "peak")
    return gated.join(taken.select("clip_id", "seq", "dropped"), ["clip_id", "seq"]).select("clip_id", "seq", "dropped", r6(F.col("peak") + 1.23456789e-8).alias("peak"))


FROM, TO, WIDE = 25, 16, 50


@query(f"""WITH q AS (SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, value / 250.0 - 1.0 AS x FROM events),
    c AS (SELECT clip_id, count(*) AS n FROM q GROUP BY 1),
    o AS (SELECT clip_id, unnest(range(CAST(ceil(n * {TO} / {FROM}.0) AS BIGINT))) AS m FROM c),
    t AS (SELECT clip_id, m, unnest(range(m * {FROM} // {TO} - {WIDE}, m * {FROM} // {TO} + {WIDE} + 2)) AS k FROM o),
    d AS (SELECT clip_id, m, k, CAST(m * {FROM} AS DOUBLE) / {TO} - k AS d FROM t),
    w AS (SELECT clip_id, m, k, CASE WHEN d = 0 THEN 1.0 ELSE sin(pi() * d * {TO} / {FROM}) / (pi() * d * {TO} / {FROM}) END
              * (CAST(0.42 AS DOUBLE) + CAST(0.5 AS DOUBLE) * cos(pi() * d / {WIDE}) + CAST(0.08 AS DOUBLE) * cos(2 * pi() * d / {WIDE})) AS w FROM d WHERE abs(d) < {WIDE})
    SELECT clip_id, m, {s6('sum(w * coalesce(x, 0)) / sum(w) + 1.23456789e-8')} AS y FROM w LEFT JOIN q USING (clip_id, k) GROUP BY clip_id, m""")
def filtered_clips(spark, sf_dir):
    """Clips at another rate through the band-limited filter, in blocks."""
    clips = fx.clips(spark, sf_dir, FROM).withColumn("seq", F.explode(F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / 64).cast("int"))))
    blocks = clips.select("clip_id", F.col("seq").cast("long").alias("seq"), F.col("sr").cast("int").alias("sr"), F.slice("samples", F.col("seq") * 64 + 1, F.lit(64)).alias("samples"))
    made = resample.resample_blocks(blocks, 64, TO)
    return made.select("clip_id", "first", F.posexplode("samples").alias("i", "y")).select("clip_id", (F.col("first") + F.col("i")).alias("m"), r6(F.col("y") + 1.23456789e-8).alias("y"))


#: A small network with weights by rule: one convolution of 3 filters, 8 wide, and 4 units.
SMALL = [network.Conv("c", 2), network.Dense("d")]


@query(f"""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings),
    p AS (SELECT vec_id, o, f, k, o * 2 + k - 3 AS i FROM (SELECT DISTINCT vec_id FROM e), (SELECT unnest(range(32)) AS o), (SELECT unnest(range(3)) AS f), (SELECT unnest(range(8)) AS k)),
    c AS (SELECT vec_id, o, f, greatest(0, sum(coalesce(x, 0) * sin(k * 1.3::DOUBLE + f * 0.7::DOUBLE)) + 0.1::DOUBLE * f) AS y FROM p LEFT JOIN e USING (vec_id, i) GROUP BY 1, 2, 3),
    n AS (SELECT vec_id, o // 2 AS t, f, max((y - 0.2::DOUBLE) / sqrt(1.5::DOUBLE + 0.001::DOUBLE) * (1 + f) - 0.5::DOUBLE) AS y FROM c GROUP BY 1, 2, 3)
    SELECT vec_id, u, {s6('1 / (1 + exp(-(sum(y * cos((t * 3 + f) * 0.9::DOUBLE + u)) + 0.05::DOUBLE * u)))')} AS a
    FROM n, (SELECT CAST(unnest(range(4)) AS INTEGER) AS u) GROUP BY vec_id, u""")
def network_activations(spark, sf_dir):
    """Vectors as frames of a small network of the pitch network's kind."""
    k, f, u, i = np.arange(8)[:, None], np.arange(3.0), np.arange(4.0), np.arange(48)[:, None]
    w = {"c/kernel": np.sin(k * 1.3 + f * 0.7).reshape(8, 1, 1, 3), "c/bias": 0.1 * f, "c/gamma": 1 + f, "c/beta": np.full(3, -0.5)}
    w |= {"c/moving_mean": np.full(3, 0.2), "c/moving_variance": np.full(3, 1.5), "d/kernel": np.cos(i * 0.9 + u), "d/bias": 0.05 * u}
    table = spark.createDataFrame([(n, list(v.shape), v.ravel().tolist()) for n, v in w.items()], "name string, shape array<int>, values array<double>")
    frames = fx.load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"))
    made = network.activations(frames, table, SMALL)
    return made.select("vec_id", F.posexplode("a").alias("u", "a")).select("vec_id", "u", r6("a").alias("a"))


@query(f"""WITH {POINTS} SELECT clip_id, seq, {s6('t')} AS t, {s6('rms')} AS rms FROM pts""")
def sunk_blocks(spark, sf_dir):
    """Blocks that went through the table sink of a stream, in several batches."""
    base = scratch(spark, "sink")
    live_blocks(spark, sf_dir).repartition(6, "clip_id").write.parquet(f"{base}/in")
    rows = live.block_stream(spark, f"{base}/in", 2)
    sink.table_stream(rows, f"{base}/out", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return sink.read_table(spark, f"{base}/out", live.BLOCKS).select("clip_id", "seq", r6("t").alias("t"), r6("rms").alias("rms"))


#: Frames of these short clips.
MEL_FRAMES = 12


@query(f"""WITH o AS (SELECT label AS clip_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings),
    s AS (SELECT clip_id, r * 64 + i AS n, x FROM (SELECT clip_id, r, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM o) WHERE r * 64 + i < {MEL_FRAMES * 160}),
    j AS (SELECT clip_id, f, j, CASE WHEN p < 0 THEN -p WHEN p >= {MEL_FRAMES * 160} THEN 2 * {MEL_FRAMES * 160 - 1} - p ELSE p END AS n
          FROM (SELECT clip_id, f, j, f * 160 + j - 200 AS p FROM (SELECT DISTINCT clip_id FROM s), (SELECT unnest(range({MEL_FRAMES})) AS f), (SELECT unnest(range(400)) AS j))),
    w AS (SELECT clip_id, f, j, x * (0.5 - 0.5 * cos(2 * pi() * j / 399)) AS x FROM j JOIN s USING (clip_id, n)),
    d AS (SELECT clip_id, f, k, power(sum(x * cos(2 * pi() * k * j / 400)), 2) + power(sum(x * sin(2 * pi() * k * j / 400)), 2) AS p FROM w, (SELECT unnest(range(201)) AS k) GROUP BY 1, 2, 3),
    a AS (SELECT m, 401 * 700 * (power(10, m * 2595 * log10(1 + 8000 / 700.0::DOUBLE) / 81 / 2595) - 1) / 16000 AS at FROM (SELECT unnest(range(82)) AS m)),
    b AS (SELECT l.m AS mel, k, greatest(0, least((k - l.at) / (c.at - l.at), (h.at - k) / (h.at - c.at))) AS g
          FROM a l JOIN a c ON c.m = l.m + 1 JOIN a h ON h.m = l.m + 2, (SELECT unnest(range(201)) AS k)),
    e AS (SELECT clip_id, f, mel, log10(greatest(sum(g * p), 1e-10)) AS v FROM d JOIN b USING (k) GROUP BY 1, 2, 3)
    SELECT CAST(clip_id AS BIGINT) AS clip_id, CAST(mel AS INTEGER) AS mel, CAST(f AS INTEGER) AS frame,
           {s6('(greatest(v, max(v) OVER (PARTITION BY clip_id) - 8) + 4) / 4 + 1.23456789e-8')} AS v FROM e""")
def log_mel_frames(spark, sf_dir):
    """Vectors of a label, one after the other, as a clip of 16 kHz."""
    rows = fx.load(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("clip_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("x"))
    clips = rows.select("clip_id", F.flatten("x.embedding").cast("array<double>").alias("samples"))
    mels = clips.select("clip_id", F.posexplode(pitch.log_mels(MEL_FRAMES)("samples")).alias("mel", "row"))
    return mels.select("clip_id", "mel", F.posexplode("row").alias("frame", "v")).select("clip_id", "mel", "frame", r6(F.col("v") + 1.23456789e-8).alias("v"))


#: Tokens of a small vocabulary; the last one ends a text.
TOKENS, MOST = 12, 20


@query(f"""WITH RECURSIVE g AS (
        SELECT vec_id, embedding, 0 AS step, 1 AS id, CAST([] AS INTEGER[]) AS ids FROM embeddings
        UNION ALL SELECT vec_id, embedding, step + 1, best, CASE WHEN best = {TOKENS - 1} THEN ids ELSE list_append(ids, best) END
        FROM (SELECT *, CAST(list_position(sc, list_max(sc)) - 1 AS INTEGER) AS best FROM (
            SELECT *, list_transform(range({TOKENS}), lambda v: sin(id * 1.7::DOUBLE + v * 0.9::DOUBLE) + cos(step * 0.6::DOUBLE + v) + embedding[v + 1]::DOUBLE) AS sc
            FROM g WHERE step < {MOST} AND id <> {TOKENS - 1})))
    SELECT vec_id, array_to_string(ids, ',') AS ids FROM g QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY step DESC) = 1""")
def decoded_tokens(spark, sf_dir):
    """Vectors as features of a small step model."""
    i, v = np.arange(TOKENS)[:, None], np.arange(TOKENS)
    w = {"next/table": np.sin(i * 1.7 + v * 0.9), "step/table": np.cos(np.arange(MOST)[:, None] * 0.6 + v)}
    table = spark.createDataFrame([(n, list(x.shape), x.ravel().tolist()) for n, x in w.items()], "name string, shape array<int>, values array<double>")
    rows = fx.load(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, TOKENS).alias("features"))
    made = decoding.decode(rows, table, decoding.TableModel, [1], TOKENS - 1, MOST)
    return made.select("vec_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
