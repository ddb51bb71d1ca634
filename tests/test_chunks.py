"""Recordings as streams of chunks."""

from collections import Counter

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from brainstate.sources.chunks import ChunkReader, chunks_of, opened, read_chunks, write_chunks

SCHEMA = "session_id string, sample_idx long, ts timestamp, ch array<float>"


def recording(spark, rows):
    """Samples of (session, index)."""
    ts, ch = F.timestamp_micros(F.col("sample_idx") * 4000).alias("ts"), F.array(F.col("sample_idx").cast("float")).alias("ch")
    return spark.createDataFrame(rows, "session_id string, sample_idx long").select("session_id", "sample_idx", ts, ch)


def pulled(spark, folder, stop_after=None, fail_at=None):
    """Batches {number: rows} of a run; it stops in order after some, or fails in one after it was handed over."""
    got = {}

    def each(rows, batch):
        got[batch] = [tuple(r) for r in rows.collect()]
        if batch == fail_at:
            raise RuntimeError("lost")

    running = read_chunks(spark, f"{folder}/in").writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").start()
    try:
        if stop_after is None:
            running.processAllAvailable()
        else:
            while len(got) < stop_after:
                running.awaitTermination(0.02)
    except Exception:
        assert fail_at is not None
    finally:
        running.stop()
    return got


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_batches_have_at_most_so_many_samples_of_a_session(spark, folder):
    rows = [("a", i) for i in range(95)] + [("b", i) for i in range(30, 61)] + [(None, i) for i in range(-7, 12, 2)]
    samples = recording(spark, rows)
    write_chunks(samples.repartition(5), f"{folder}/in", 10, 3)
    got = pulled(spark, folder)
    for batch in got.values():
        assert max(Counter(r[0] for r in batch).values()) <= 10
        assert len({r[1] // 10 for r in batch}) == 1
    firsts = [min(r[1] for r in got[b]) for b in sorted(got)]
    assert firsts == sorted(firsts) and len(firsts) == 11
    assert sorted(map(str, (r for b in got.values() for r in b))) == sorted(map(str, map(tuple, samples.collect())))


def test_restarts_lose_and_repeat_nothing(spark, folder):
    samples = recording(spark, [(s, i) for s in "ab" for i in range(60)])
    write_chunks(samples, f"{folder}/in", 10, 2)
    failed = pulled(spark, folder, fail_at=1)
    assert sorted(failed) == [0, 1]
    again = pulled(spark, folder, stop_after=2)  # the failed batch runs again, with the same rows
    assert min(again) == 1 and sorted(again[1]) == sorted(failed[1])
    rest = pulled(spark, folder)
    assert pulled(spark, folder) == {}
    last = failed | again | rest  # a batch that ran again replaces itself
    assert sorted(last) == list(range(6))
    assert sorted(r[:2] for b in last.values() for r in b) == sorted((s, i) for s in "ab" for i in range(60))


def test_a_task_reads_only_files_of_its_chunks(spark, folder):
    write_chunks(recording(spark, [("a", i) for i in range(100)]), f"{folder}/in", 10, 2)
    reader = ChunkReader(f"{folder}/in", None)
    assert (reader.initialOffset(), reader.latestOffset()) == ({"chunk": 0}, {"chunk": 1})
    assert {p.path.split("/")[-2] for p in reader.partitions({"chunk": 5}, {"chunk": 6})} == {"folder=2"}
    assert {p.path.split("/")[-2] for p in reader.partitions({"chunk": 5}, {"chunk": 7})} == {"folder=2", "folder=3"}
    assert reader.latestOffset() == {"chunk": 8}
    assert reader.partitions({"chunk": 8}, {"chunk": 8}) == []
    assert reader.partitions({"chunk": 9}, {"chunk": 10}) and reader.latestOffset() == {"chunk": 10}


def test_gaps_repeated_rows_and_no_rows(spark, folder):
    write_chunks(recording(spark, [("a", 3), ("a", 3), ("a", 95)]), f"{folder}/in", 10, 2)
    got = pulled(spark, folder)
    assert [r[:2] for b in sorted(got) for r in got[b]] == [("a", 3), ("a", 3), ("a", 95)]
    write_chunks(recording(spark, []), f"{folder}/none/in", 10, 2)
    assert not any(pulled(spark, f"{folder}/none").values())


def test_bad_recordings(spark, folder):
    with pytest.raises(Exception, match="no sample_idx"):
        write_chunks(recording(spark, [("a", None)]), f"{folder}/in")
    with pytest.raises(ValueError):
        write_chunks(recording(spark, [("a", 1)]), f"{folder}/in", 0)
    write_chunks(recording(spark, [("a", 1)]), f"{folder}/in")
    with pytest.raises(ValueError, match="isn't the one"):
        ChunkReader(f"{folder}/in", None).partitions({"chunk": 5}, {"chunk": 1})


def test_paths_that_arrow_opens(tmp_path):
    for path in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        files, root = opened(path)
        assert isinstance(files, pafs.LocalFileSystem) and root == str(tmp_path)


def test_more_chunks_a_batch_on_long_recordings(spark, folder):
    """The number of batches doesn't follow the recording; chunks are the same."""
    write_chunks(recording(spark, [(s, i) for s in "ab" for i in range(-15, 95)]), f"{folder}/in", 10, 3)
    assert [chunks_of(spark, f"{folder}/in", n) for n in (1, 4, 12, 100)] == [12, 3, 1, 1]
    got = []
    each = lambda rows, batch: got.append([(r.chunk, r.session_id, r.sample_idx) for r in rows.collect()])
    running = read_chunks(spark, f"{folder}/in", f"{SCHEMA}, chunk long", 5).writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    assert [sorted({c for c, *_ in batch}) for batch in got] == [[-2, -1, 0, 1, 2], [3, 4, 5, 6, 7], [8, 9]]
    assert sorted(r for batch in got for r in batch) == sorted((i // 10, s, i) for s in "ab" for i in range(-15, 95))
