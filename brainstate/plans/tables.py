"""The library's inputs as views of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brainstate.sources.shared import stored

#: Event types as labels; one-hop gaps are hours, so a state is sustained for six.
LABELS = {"click": "focus", "view": "calm", "purchase": "happy", "error": "distress"}
SUSTAIN = 21_600.0
#: Seconds of a block of hops: some days of the given events.
BLOCK = 7 * 86_400.0
#: Event values as a slow recording: samples a second, samples in a window, hop and transform.
FS, WINDOW, HOP, N_FFT = 64.0, 64, 4, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def as_hops(df: DataFrame) -> DataFrame:
    pairs = [F.lit(x) for pair in LABELS.items() for x in pair]
    label = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("event_type")), F.lit("neutral"))
    return df.select(
        F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("sample_idx"), label.alias("label"), F.array("value").alias("vector")
    )


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_hops(events(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band powers of each user and day."""
    of = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("value")).otherwise(0.0))
    return (
        events(spark, sf_dir)
        .groupBy(F.col("user_id").alias("session_id"), F.to_date("ts").alias("day"))
        .agg(of("error").alias("theta"), of("view").alias("alpha"), of("click").alias("beta"), F.max("ts").alias("ts"))
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording for each event type, with one channel.

    Events are numbered in ranges of the order, so no task holds all of a type: a number is the place in the range and
    the rows of the type in the ranges before, of which there are as many as shuffle partitions.
    """
    order = "event_type", "ts", "event_id"
    ranges = stored(
        events(spark, sf_dir)
        .select(*order, "value")
        .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
        .withColumn("range", F.spark_partition_id()),
        "ranges",
    )
    before = Window.partitionBy("event_type").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("event_type", "range").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    w = Window.partitionBy("event_type", "range").orderBy("ts", "event_id")
    return (
        ranges.withColumn("place", F.row_number().over(w) - 1)
        .join(counts, ["event_type", "range"])
        .select(
            F.col("event_type").alias("session_id"),
            (F.col("before") + F.col("place")).cast("long").alias("sample_idx"),
            "ts",
            F.array("value").alias("ch"),
        )
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as memories of a session for each label, in the order of their ids."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("session_id"), F.col("vec_id").alias("mem_seq"), F.col("embedding").alias("vector")
    )
