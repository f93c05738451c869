"""Load shedding as a stream, as a batch and as a loop over events."""

import random

import pandas as pd

from tessela.plans.queries import rocksdb_state
from tessela.streaming import live


def loop(rows, service):
    """(clip, seq, taken, dropped) of blocks one after the other."""
    free, dropped, out = {}, {}, []
    for clip, seq, t, *_ in sorted(rows):
        takes = t >= free.get(clip, float("-inf"))
        if takes:
            free[clip] = t + service
        else:
            dropped[clip] = dropped.get(clip, 0) + 1
        out.append((clip, seq, takes, dropped.get(clip, 0)))
    return out


def test_shedding_equals_a_loop(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for clip in range(4):
        t = 0.0
        for seq in range(90):
            t += rng.choice([0.0, 0.05, 0.1, 0.3])
            rows.append((clip, seq, round(t, 3), rng.random(), 100.0, 1.0))
    for service in (0.0, 0.25, 2.0):
        got = live.shed_batch(spark.createDataFrame(rows, live.BLOCKS), service).collect()
        assert sorted((r.clip_id, r.seq, r.taken, r.dropped) for r in got) == loop(rows, service)
    base = tmp_path / "s"
    with rocksdb_state(spark):
        for part in range(3):  # three runs from one checkpoint, each with new blocks
            mine = [r for r in rows if r[1] // 30 == part]
            spark.createDataFrame(mine, live.BLOCKS).coalesce(1).write.mode("append").parquet(str(base / "in"))
            shed = live.shed_stream(live.block_stream(spark, str(base / "in")), 0.25)
            shed.writeStream.format("parquet").option("path", str(base / "out")).option("checkpointLocation", str(base / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(live.SHED).parquet(str(base / "out")).collect()
    assert sorted((r.clip_id, r.seq, r.taken, r.dropped) for r in got) == loop(rows, 0.25)


def test_all_blocks_at_once():
    rows = pd.DataFrame([(1, i, 0.0, 0.1, 1.0, 1.0) for i in range(5)], columns=live.BLOCK_NAMES)
    out, free, dropped = live.shed_rows(rows, float("-inf"), 0, 1.0)
    assert list(out.taken) == [True, False, False, False, False] and (free, dropped) == (1.0, 4)
