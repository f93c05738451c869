"""The table sink of a stream: batches once, whatever is killed between."""

import os

import pyarrow as pa

from tessela.streaming import sink


def batch(*values):
    return iter([pa.RecordBatch.from_pydict({"id": pa.array(values, pa.int64())})])


def ids(spark, folder):
    return sorted(r.id for r in sink.read_table(spark, str(folder), "id long").collect())


def test_killed_between_write_and_commit(spark, tmp_path):
    lost = sink.BatchWriter(str(tmp_path))
    lost.write(batch(1, 2))  # and the driver is gone
    again = sink.BatchWriter(str(tmp_path))
    again.commit([again.write(batch(1)), again.write(batch(2)), again.write(iter([])), None], 0)
    assert ids(spark, tmp_path) == [1, 2] and len(os.listdir(tmp_path / "parts")) == 3
    # killed after the commit, before Spark noted it: the batch runs again
    replay = sink.BatchWriter(str(tmp_path))
    replay.commit([replay.write(batch(1, 2))], 0)
    assert ids(spark, tmp_path) == [1, 2] and len(os.listdir(tmp_path / "parts")) == 3
    replay.abort([replay.write(batch(9))], 1)
    replay.commit([replay.write(batch(3))], 1)
    replay.commit([], 2)
    assert ids(spark, tmp_path) == [1, 2, 3]
    assert sorted((r.batch, r["rows"], len(r.parts)) for r in sink.committed(spark, str(tmp_path)).collect()) == [(0, 2, 2), (1, 1, 1), (2, 0, 0)]


def test_stream_with_a_replayed_batch(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), tmp_path / "state"

    def run():
        rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(source))
        sink.table_stream(rows, out, str(state)).trigger(availableNow=True).start().awaitTermination()

    spark.range(0, 50).coalesce(1).write.mode("append").parquet(str(source))
    spark.range(50, 80).coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert ids(spark, out) == list(range(80))
    last = max(int(f) for f in os.listdir(state / "commits") if f.isdigit())
    os.remove(state / "commits" / str(last))
    if os.path.exists(crc := state / "commits" / f".{last}.crc"):
        os.remove(crc)
    spark.range(80, 90).coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert ids(spark, out) == list(range(90))
