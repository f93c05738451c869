"""Wave files in parts and as a stream."""

import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessela.sources import audio, capture, riff


def pcm(path, x, rate=8000, width=2, channels=1):
    """A file by the standard library; ``x`` are integers of the first channel."""
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        frames = b""
        for v in x:
            one = (int(v) + 128).to_bytes(1, "little") if width == 1 else int(v).to_bytes(width, "little", signed=True)
            frames += one + b"\0" * width * (channels - 1)
        f.writeframes(frames)


@pytest.fixture
def files(tmp_path):
    rng = np.random.default_rng(1)
    made = {}
    for width in (1, 2, 3, 4):
        for channels in (1, 2):
            top = 1 << (8 * width - 1)
            x = rng.integers(-top, top, 1000 + width)
            pcm(tmp_path / f"w{width}c{channels}.wav", x, 8000, width, channels)
            made[f"w{width}c{channels}.wav"] = x / top
    x = rng.uniform(-1, 1, 777).astype("<f4")
    ext = struct.pack("<HHIIHHHHIH14s", riff.EXTENSIBLE, 1, 8000, 32000, 4, 32, 22, 32, 0, riff.FLOAT, b"\0" * 14)
    body = b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", len(ext)) + ext + b"data" + struct.pack("<I", x.nbytes) + x.tobytes()
    (tmp_path / "float.wav").write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)
    made["float.wav"] = x.astype(float)
    (tmp_path / "junk.wav").write_bytes(b"no audio here at all")
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "none.wav").write_bytes(riff.written_wave(np.zeros(0), 8000))
    return tmp_path, made


def name(clip):
    return clip.rsplit("/", 1)[1]


@pytest.mark.parametrize("segment_bytes", [1, 900, 1 << 20])
def test_blocks_equal_whole_files(spark, files, segment_bytes):
    folder, made = files
    whole = {name(r.clip_id): r for r in audio.audio_clips(spark, str(folder)).collect()}
    assert whole["junk.wav"].samples is None and "empty.wav" not in whole and whole["none.wav"].samples == []
    got = {}
    for r in audio.audio_blocks(spark, str(folder), block=100, segment_bytes=segment_bytes).orderBy("clip_id", "seq").collect():
        assert r.sr == 8000 and r.t == r.seq * 100 / 8000 and len(r.samples) <= 100
        got.setdefault(name(r.clip_id), []).append(r.samples)
    assert set(got) == set(made)
    for clip, x in made.items():
        assert [len(b) for b in got[clip][:-1]] == [100] * (len(got[clip]) - 1)
        assert np.allclose(np.concatenate(got[clip]), x) and np.allclose(whole[clip].samples, x)


def test_time_ranges_and_no_samples(spark, files):
    folder, made = files
    start, end = F.lit(0.02), F.lit(0.05)  # samples 160..400: blocks 1 to 3
    got = audio.audio_blocks(spark, str(folder), 100, start, end).filter("clip_id like '%w2c1.wav'").orderBy("seq").collect()
    assert [r.seq for r in got] == [1, 2, 3] and np.allclose(np.concatenate([r.samples for r in got]), made["w2c1.wav"][100:400])
    bare = audio.audio_blocks(spark, str(folder), 100, start, end, with_samples=False)
    assert bare.columns == ["clip_id", "seq", "t", "sr"] and bare.count() == 3 * len(made)


def test_a_long_file_is_many_tasks(spark, tmp_path):
    """A sparse file of a gigabyte: 128 ranges; a time range reads its own only."""
    path = tmp_path / "long.wav"
    n = (1 << 30) // 2
    head = riff.written_wave(np.zeros(0), 16000)
    with open(path, "wb") as f:
        f.write(head[:40] + struct.pack("<I", 2 * n))
        f.seek(44 + 2 * (n - 4096))
        f.write(np.full(4096, 16384, "<i2").tobytes())
    parts = audio.segments(audio.headers(spark, str(tmp_path)), audio.BLOCK, None, None)
    assert parts.count() == 128 and parts.agg(F.max("n") * audio.BLOCK * 2).first()[0] == audio.SEGMENT_BYTES
    last = audio.audio_blocks(spark, str(tmp_path), start=F.lit(n / 16000 - 0.1)).collect()
    assert [(r.seq, set(r.samples)) for r in last] == [(n // 4096 - 1, {0.5})]


def test_capture_restarts_and_replays(spark, tmp_path):
    """Files grow; one run fails in the middle of a batch; the rows are those of one run over
    the finished files."""
    rng = np.random.default_rng(2)
    clips = {f"clip{i}.wav": rng.uniform(-1, 1, 1000 + 137 * i) for i in range(3)}
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()

    def state(share, closed):
        for clip, x in clips.items():
            (folder / clip).write_bytes(riff.written_wave(x[: int(len(x) * share)], 100, closed))

    def run(fail=False, **options):
        rows = capture.capture_stream(spark, str(folder), block=64, **options)
        if fail:
            rows = rows.withColumn("t", F.when(F.col("seq") == 9, F.raise_error(F.lit("lost"))).otherwise(F.col("t")))
        q = rows.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()

    state(0.3, False)
    run()
    first = spark.read.schema(audio.BLOCKS).parquet(str(out)).groupBy("clip_id").count().collect()
    assert {r.clip_id: r["count"] for r in first} == {c: int(len(x) * 0.3) // 64 for c, x in clips.items()}
    state(0.8, False)
    with pytest.raises(Exception, match="lost"):
        run(fail=True)
    run()
    state(1.0, True)
    run(segmentblocks=2)
    run()
    got = {}
    for r in spark.read.schema(audio.BLOCKS).parquet(str(out)).orderBy("clip_id", "seq").collect():
        got.setdefault(r.clip_id, []).append((r.seq, r.samples))
    for clip, x in clips.items():
        assert [s for s, _ in got[clip]] == list(range(-(-len(x) // 64)))
        assert np.allclose(np.concatenate([b for _, b in got[clip]]), x, atol=1 / 32768)


def test_capture_takes_a_share_per_trigger(tmp_path):
    (tmp_path / "a.wav").write_bytes(riff.written_wave(np.zeros(1000), 100))
    reader = capture.CaptureReader(str(tmp_path), 64, 5, 2)
    start, seen = reader.initialOffset(), []
    for _ in range(5):
        end = reader.latestOffset()
        seen.append([(p.first, p.n) for p in reader.partitions(start, end)])
        start = end
    assert seen == [[(0, 2), (2, 2), (4, 1)], [(5, 2), (7, 2), (9, 1)], [(10, 2), (12, 2), (14, 1)], [(15, 1)], []]
    again = capture.CaptureReader(str(tmp_path), 64, 5, 100)  # a restart replays a batch from its offsets
    assert [(p.first, p.n) for p in again.partitions({"clips": '{"a.wav": 5}'}, {"clips": '{"a.wav": 10}'})] == [(5, 5)]
    assert again.latestOffset() == {"clips": '{"a.wav": 15}'}
