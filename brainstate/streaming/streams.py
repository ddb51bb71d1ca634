"""Structured Streaming jobs (ST1 to ST4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brainstate.functions.scoring import classify
from brainstate.functions.text import memory_text_close, memory_text_open
from brainstate.operators.dashboard import display_state
from brainstate.operators.retrieval import NO_SIMILAR, nearest_stored
from brainstate.operators.signal import feature_vector
from brainstate.sources import io
from brainstate.sources.shared import stored
from brainstate.streaming.stateful import EpisodeLog, SegmentSpectra


#: Stateful operators keep their state in this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
DAY_US = 86_400_000_000


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the state store that ST1 and ST2 need; call it before their streams start."""
    for key, value in STORE.items():
        spark.conf.set(key, value)
    return spark


def stream_features(
    samples: DataFrame, fs: float = 250.0, window: int = 1000, hop: int = 250, n_fft: int | None = None,
    delay: str = "10 seconds", idle_us: int = DAY_US,
) -> DataFrame:
    """ST1: features and scores of each full window of a stream of samples; window w starts at sample w * hop.

    A window comes out with the batch that brings its last sample. Samples may come in any order within `delay`, and
    what is later is dropped; a window that lacks samples gives nothing. See SegmentSpectra for the state.
    """
    n_fft = n_fft or min(int(fs * 2), window)
    kind = samples.schema["session_id"].dataType.simpleString()
    made = (
        samples.select("session_id", "sample_idx", "ts", "ch")
        .withWatermark("ts", delay)
        .groupBy("session_id")
        .transformWithStateInPandas(
            SegmentSpectra(fs, window, hop, n_fft, idle_us),
            f"session_id {kind}, start_idx long, ts timestamp, theta double, alpha double, beta double",
            "append",
            "eventTime",
        )
    )
    return classify(feature_vector(made))


def stream_episodes(hops: DataFrame, sustain: float = 3.0, delay: str = "10 seconds", idle_us: int = DAY_US) -> DataFrame:
    """ST2: the log of starts and ends (session_id, action, evt_id, at_us, state, vector) of a stream of hops.

    Hops may come in any order within `delay`, and what is later is dropped; hops of equal times go by sample_idx, if they
    have that column. An action comes out once the watermark has passed its hop. See EpisodeLog for the state.
    """
    kind = hops.schema["session_id"].dataType.simpleString()
    tie = F.col("sample_idx") if "sample_idx" in hops.columns else F.lit(0)
    vector = F.col("vector") if "vector" in hops.columns else F.lit(None)
    return (
        hops.withWatermark("ts", delay)
        .select("session_id", "ts", F.unix_micros("ts").alias("us"), tie.cast("long").alias("tie"), "label", vector.cast("array<double>").alias("vector"))
        .groupBy("session_id")
        .transformWithStateInPandas(
            EpisodeLog(sustain, idle_us),
            f"session_id {kind}, action string, evt_id string, at_us long, state string, vector array<double>",
            "append",
            "eventTime",
        )
    )


def started(batch: DataFrame, advice: Column) -> DataFrame:
    """ST3: the started events of a batch of actions, with their open document; each event once.

    The document names the state as it is displayed; states that have no such name make no event. advice: a column of the start's.
    """
    starts = display_state(batch.filter(F.col("action") == "start").dropDuplicates(["session_id", "evt_id"]))
    ts = F.timestamp_micros("at_us")
    return starts.select(
        "session_id", "evt_id", "state", F.col("at_us").alias("start_us"), F.col("vector").alias("embedding"),
        memory_text_open(F.col("display_name"), ts, advice).alias("document"),
    )


def closed(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """ST3: rows (session_id, evt_id, start_us, document, ...) with the documents of ended events closed."""
    seconds = F.floor((F.col("_end") - F.col("start_us")) / 1_000_000)
    text = memory_text_close(F.col("document"), F.timestamp_micros("_end"), seconds)
    out = rows.join(ends.withColumnRenamed("end_us", "_end"), ["session_id", "evt_id"], "left")
    return out.withColumn("document", F.when(F.col("_end").isNotNull(), text).otherwise(F.col("document"))).drop("_end")


def memorize(
    batch: DataFrame, path: str, batch_id: int, advice: Column | None = None, threshold: float = 0.2, buckets: int = io.BUCKETS
) -> None:
    """ST3: a batch of actions merged into both memories at path, by (session_id, evt_id).

    Ends close the documents of their events first, those of the batch among them. Then each new start looks for the
    nearest event that started before it in its session, in the memory as it was and in this batch, and takes the context
    of that one if it is near enough (RT4). Then the new rows go to both memories, and the contexts of ended events are
    closed in both. Only the buckets of sessions that the batch names are read and written. The batch is a version of
    both memories, so one that runs again gives the same; versions that no rerun can need are deleted.
    """
    spark = batch.sparkSession
    batch = batch.persist()  # computed once, as its states are
    try:
        kind = batch.schema["session_id"].dataType.simpleString()
        schemas_of = {k: StructType.fromDDL(f"session_id {kind}, {v}") for k, v in MEMORIES.items()}
        eeg, text = (io.touched(spark, f"{path}/{k}", schema, batch, batch_id, buckets) for k, schema in schemas_of.items())
        text, keys = stored(text, "text"), ["session_id", "evt_id"]
        ends = batch.filter(F.col("action") == "end").groupBy(*keys).agg(F.max("at_us").alias("end_us"))
        new = started(batch, F.lit("") if advice is None else advice).join(text.select(*keys), keys, "left_anti")
        fields = ["session_id", "evt_id", "start_us", "state", "document"]
        rows = stored(closed(text.select(*fields).unionByName(new.select(*fields)), ends), "text")
        vectors = new.select(*keys, "embedding").withColumn("similar_context", F.lit(None).cast("string"))
        vectors = stored(eeg.select(*keys, "embedding", "similar_context").unionByName(vectors).join(rows, keys), "eeg")
        asked = vectors.filter("similar_context is null")
        near = nearest_stored(asked, vectors, "start_us", "embedding").filter(F.col("distance") < threshold)
        past = vectors.select("session_id", F.col("start_us").alias("past"), F.col("document").alias("found"))
        found = near.join(past.dropDuplicates(["session_id", "past"]), ["session_id", "past"]).select("session_id", "start_us", "found")
        vectors = vectors.join(found, ["session_id", "start_us"], "left")
        context = F.col("document").alias("context")
        similar = F.coalesce("similar_context", "found", F.lit(NO_SIMILAR)).alias("similar_context")
        io.write_version(vectors.select(*keys, "embedding", context, similar, "start_us"), f"{path}/eeg", batch_id, buckets)
        io.write_version(rows.select(*fields[:2], "document", context, "state", "start_us"), f"{path}/text", batch_id, buckets)
        for k in MEMORIES:
            io.drop_old_versions(spark, f"{path}/{k}")
    finally:
        batch.unpersist()


#: Columns of the memories besides session_id.
MEMORIES = {
    "eeg": "evt_id string, embedding array<double>, context string, similar_context string, start_us long",
    "text": "evt_id string, document string, context string, state string, start_us long",
}


def stream_memory_sink(actions: DataFrame, path: str, checkpoint: str, advice: Column | None = None, threshold: float = 0.2, buckets: int = io.BUCKETS):
    """ST3: a writer of a stream of actions (ST2) into the memories at path, which memory reads."""
    merge = lambda batch, batch_id: memorize(batch, path, batch_id, advice, threshold, buckets)
    return actions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def memory(spark: SparkSession, path: str, which: str = "text", kind: str = "string") -> DataFrame:
    """ST3: one of the memories ("eeg" or "text") as of the last batch; kind: the type of session_id."""
    return io.newest(spark, f"{path}/{which}", StructType.fromDDL(f"session_id {kind}, {MEMORIES[which]}")).drop("bucket")


def stream_latest_metrics(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """ST4: the latest values of each session, for update or complete mode."""
    return metrics.groupBy("session_id").agg(F.max_by(F.struct("ts", *columns), "ts").alias("m")).select("session_id", "m.*")
