"""Many short clips share tasks; their blocks are those of each file."""

import numpy as np
from pyspark.sql import functions as F

from tessela.sources import audio, capture, riff


def write(folder, n, samples=130):
    rng = np.random.default_rng(3)
    for i in range(n):
        (folder / f"c{i:03}.wav").write_bytes(riff.written_wave(rng.uniform(-1, 1, samples), 25))


def test_short_files_share_tasks(spark, tmp_path):
    write(tmp_path, 40)
    made = audio.audio_blocks(spark, str(tmp_path), 16, segment_bytes=64)
    assert made.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    got = {(r.clip_id.rpartition("/")[2], r.seq): r.samples for r in made.collect()}
    assert len(got) == 40 * 9
    for i in (0, 17, 39):
        with riff.opened(f"{tmp_path}/c{i:03}.wav") as f:
            x = riff.read_frames(f, riff.header(f), 0, 130)
        assert [v for s in range(9) for v in got[f"c{i:03}.wav", s]] == list(x)


def test_one_long_file_is_read_by_many_tasks(spark, tmp_path):
    write(tmp_path, 1, 20_000)
    made = audio.audio_blocks(spark, str(tmp_path), 16, segment_bytes=64)
    assert made.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert made.agg(F.count(F.lit(1)), F.sum(F.size("samples"))).first()[:] == (1250, 20_000)


def test_short_clips_share_partitions_of_the_stream(spark, tmp_path):
    write(tmp_path, 40)
    reader = capture.CaptureReader(str(tmp_path), 16, 1 << 40, 100)
    start, end = reader.initialOffset(), reader.latestOffset()
    parts = reader.partitions(start, end)
    assert len(parts) <= 5 and sum(p.n for p in parts) == 360
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted((r["clip_id"], r["seq"]) for r in rows) == [(f"c{i:03}.wav", s) for i in range(40) for s in range(9)]


def test_closed_files_are_not_opened_again(spark, tmp_path, monkeypatch):
    write(tmp_path, 3)
    (tmp_path / "open.wav").write_bytes(riff.written_wave(np.zeros(40), 25, closed=False))
    reader, seen, header = capture.CaptureReader(str(tmp_path), 16, 1 << 40, 100), [], riff.header
    monkeypatch.setattr(riff, "header", lambda f: seen.append(f) or header(f))
    assert reader.available() == {"c000.wav": 9, "c001.wav": 9, "c002.wav": 9, "open.wav": 2} and len(seen) == 4
    (tmp_path / "open.wav").write_bytes(riff.written_wave(np.zeros(40), 25))
    (tmp_path / "c001.wav").write_bytes(riff.written_wave(np.zeros(300), 25))
    assert reader.available() == {"c000.wav": 9, "c001.wav": 19, "c002.wav": 9, "open.wav": 3} and len(seen) == 6
