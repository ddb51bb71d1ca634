"""Readers and writers (IO1 to IO8). Tables are Parquet folders with declared schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brainstate import schemas
from brainstate.functions.text import memory_text_close

#: Buckets of sessions in a store of versions.
BUCKETS = 64


def read_sample_stream(spark: SparkSession, path: str, schema: str = schemas.SAMPLES) -> DataFrame:
    """IO1: samples as a stream of files; another source with the same columns can take its place."""
    return spark.readStream.schema(schema).parquet(path)


def read_recording(spark: SparkSession, recordings: str, cues: str) -> tuple[DataFrame, DataFrame]:
    """IO2: samples and cues of recorded sessions."""
    return spark.read.schema(schemas.SAMPLES).parquet(recordings), spark.read.schema(schemas.CUES).parquet(cues)


def read_chat_store(spark: SparkSession, path: str) -> DataFrame:
    """IO3: nested chat JSON; a missing or broken file gives no rows.

    A file holds one document over any number of lines, or documents of a line each, as write_chat_store makes them. Files of
    lines are split among tasks; only the others are read whole.
    """
    # By default a text of more than 20,000,000 characters counts as malformed, and its whole document is dropped.
    reader = spark.read.schema(schemas.CHAT_STORE).option("maxStringLen", 2**31 - 1)
    stores = lambda **options: reader.json(path, mode="DROPMALFORMED", **options)
    filled = lambda rows: rows.filter(F.col("chat_sessions").isNotNull()).select("*", F.col("_metadata.file_path").alias("_file"))
    try:
        lines, whole = filled(stores()), filled(stores(multiLine=True))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.CHAT_STORE)
    # A reader of whole files gives the first document alone, so it is for files of which no line is a document.
    of_lines = F.broadcast(lines.select("_file").distinct())  # a name for each file
    return lines.unionByName(whole.join(of_lines, "_file", "left_anti")).drop("_file")


def chat_documents(messages: DataFrame, counter: int, current: str | None, store: str | None = None) -> DataFrame:
    """Messages (session_order, session_id, title, turn, role, text) nested as a document for each store; those without a turn come last."""
    keys = [store] if store else []
    turns = F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("last"), "turn", "role", F.col("text").alias("content"))))
    said = F.transform(turns, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    sessions = messages.groupBy(*keys, "session_order", "session_id", "title").agg(said.alias("messages"))
    entry = F.struct("session_order", "session_id", F.struct("title", "messages").alias("value"))
    ordered = F.array_sort(F.collect_list(entry))
    pairs = F.transform(ordered, lambda e: F.struct(e["session_id"].alias("key"), e["value"].alias("value")))
    return sessions.groupBy(*keys).agg(F.map_from_entries(pairs).alias("chat_sessions")).select(
        "chat_sessions", F.lit(counter).alias("session_counter"), F.lit(current).cast("string").alias("current_session_id")
    )


def write_chat_store(messages: DataFrame, path: str, counter: int, current: str | None, store: str | None = None) -> None:
    """IO4: messages (session_order, session_id, title, turn, role, text) as nested JSON documents.

    The format is a document for each store. store: the column that tells stores apart, one for each user; without
    it, all messages are one user's and make one document.
    """
    chat_documents(messages, counter, current, store).write.mode("overwrite").json(path)


def memory_rows(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """IO5: vector rows and text rows of started events (session_id, evt_id, vector, document, context, start_ts)."""
    common = ["session_id", "evt_id"]
    eeg = events.select(*common, F.col("vector").alias("embedding"), "context", F.col("start_ts").alias("ts"))
    return eeg, events.select(*common, "document", "context", F.col("start_ts").alias("ts"))


def append_memory(events: DataFrame, eeg_path: str, text_path: str) -> None:
    """IO5: append both rows of each event, with the same id."""
    for rows, path in zip(memory_rows(events), (eeg_path, text_path), strict=True):
        rows.write.mode("append").parquet(path)


def close_memory(memory: DataFrame, ends: DataFrame, column: str = "document") -> DataFrame:
    """IO6: memory with end and duration filled in for ends (session_id, evt_id, end_ts, duration_sec); other ids stay."""
    closed = memory_text_close(F.col(column), F.col("end_ts"), F.col("duration_sec"))
    filled = F.when(F.col("end_ts").isNotNull(), closed).otherwise(F.col(column))
    out = memory.join(ends.select("session_id", "evt_id", "end_ts", "duration_sec"), ["session_id", "evt_id"], "left")
    return out.withColumn(column, filled).withColumn("context", F.when(F.col("end_ts").isNotNull(), F.col(column)).otherwise(F.col("context"))).drop("end_ts", "duration_sec")


def drop_old_versions(spark: SparkSession, path: str, kept: int = 2) -> None:
    """IO6: delete a store's versions of a bucket but for the newest ones; a batch that runs again needs the one before its own."""
    jvm, found = spark.sparkContext._jvm, {}
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for x in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "version=*/bucket=*")) or []:
        folder = x.getPath()
        found.setdefault(folder.getName(), []).append((int(folder.getParent().getName().split("=")[1]), folder))
    for versions in found.values():
        for _, folder in sorted(versions, key=lambda v: v[0])[:-kept]:
            fs.delete(folder, True)
    for x in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "version=*")) or []:
        if not fs.globStatus(jvm.org.apache.hadoop.fs.Path(x.getPath(), "bucket=*")):
            fs.delete(x.getPath(), True)


def close_vectors(eeg: DataFrame, text: DataFrame) -> DataFrame:
    """IO6: the vector memory with the contexts that the text memory has for the same events; other rows stay."""
    new = text.select("session_id", "evt_id", F.col("context").alias("_context"))
    out = eeg.join(new, ["session_id", "evt_id"], "left")
    return out.withColumn("context", F.coalesce("_context", "context")).drop("_context")


def bucket_of(buckets: int = BUCKETS):
    return F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int").alias("bucket")


def write_version(rows: DataFrame, path: str, version: int, buckets: int = BUCKETS) -> None:
    """IO6: whole buckets of sessions as a version of a store; a version that is written again replaces itself.

    Older versions of these buckets aren't changed, so a job that fails halfway loses nothing; drop_old_versions deletes what is
    older than the version before the newest.
    """
    dealt = rows.select("*", bucket_of(buckets)).hint("rebalance", "bucket")  # few files a bucket, large ones split
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={version}")


def newest(spark: SparkSession, path: str, schema: StructType, below: int | None = None) -> DataFrame:
    """IO6: rows of schema and their bucket, of each bucket's newest version (below a given one); none without a store."""
    whole = StructType([*schema.fields]).add("version", "long").add("bucket", "integer")
    try:
        rows = spark.read.schema(whole).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], whole)
    if below is not None:
        rows = rows.filter(F.col("version") < below)
    last = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(last, ["bucket", "version"], "left_semi").drop("version")


def touched(spark: SparkSession, path: str, schema: StructType, keys: DataFrame, version: int, buckets: int = BUCKETS) -> DataFrame:
    """IO6: rows of the buckets that hold sessions of keys, as they were before a version."""
    wanted = keys.select(bucket_of(buckets)).distinct()  # at most one row for each bucket
    return newest(spark, path, schema, version).join(F.broadcast(wanted), "bucket", "left_semi").drop("bucket")


def close_stored(spark: SparkSession, path: str, schema: StructType, ends: DataFrame, version: int, buckets: int = BUCKETS) -> None:
    """IO6: close_memory on a store; only buckets with sessions of ends are read and written again, as a new version."""
    write_version(close_memory(touched(spark, path, schema, ends, version, buckets), ends), path, version, buckets)


def get_memory(memory: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """IO7: all rows, or those of ids (session_id, evt_id)."""
    return memory if ids is None else memory.join(ids, ["session_id", "evt_id"], "left_semi")


def memory_counts(memory: DataFrame, sessions: DataFrame) -> DataFrame:
    """IO7: (session_id, n, is_empty) of each of sessions: how many rows it has in memory, and whether it has none.

    What asks a memory is asked only of sessions that have rows; the others get the text for none.
    """
    counts = memory.groupBy("session_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return sessions.join(counts, "session_id", "left").select("session_id", n.alias("n"), (n == 0).alias("is_empty"))


def clear_memory(spark: SparkSession, eeg_path: str, text_path: str) -> None:
    """IO8: both tables emptied, with the same schemas."""
    for path, schema in ((eeg_path, schemas.EEG_MEMORY), (text_path, schemas.TEXT_MEMORY)):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
