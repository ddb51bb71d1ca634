"""Debounced state episodes (EP1 to EP8), as windows over hops (session_id, ts, label, vector).

All windows share one partitioning by session and one order, so a session's hops are
shuffled and sorted once. Times are timestamps; sustain is in seconds. Hops of equal times follow each other by
their sample_idx, if they have that column; without it their order is any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brainstate.functions.scoring import NEUTRAL


def _w(hops: DataFrame, *keys: str):
    tie = ["sample_idx"] if "sample_idx" in hops.columns else []
    return Window.partitionBy("session_id", *keys).orderBy("ts", *tie)


def _micros(column: str):
    return F.unix_micros(column)


def label_runs(hops: DataFrame) -> DataFrame:
    """EP1: run_id of equal labels in a row, hop_no from 1, and run_start, the first hop's time."""
    w, run = _w(hops), _w(hops, "run_id")
    change = (F.col("label") != F.lag("label").over(w)).cast("int")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        hops.withColumn("run_id", F.sum(F.coalesce(change, F.lit(1))).over(so_far))
        .withColumn("hop_no", F.row_number().over(run))
        .withColumn("run_start", F.first("ts").over(run))
    )


def neutral_epochs(hops: DataFrame) -> DataFrame:
    """EP3: epoch, the number of neutral hops so far, and reset_ts, the next neutral hop's time."""
    neutral = F.col("label") == NEUTRAL
    w = _w(hops)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return hops.withColumn("epoch", F.sum(neutral.cast("int")).over(so_far)).withColumn(
        "reset_ts", F.min(F.when(neutral, F.col("ts"))).over(ahead)
    )


def sustained_runs(runs: DataFrame, sustain: float = 3.0) -> DataFrame:
    """EP2: each run's label, run_start, and confirm_ts, its first hop but the first that is sustained."""
    held = (_micros("ts") - _micros("run_start") >= int(sustain * 1e6)) & (F.col("hop_no") > 1)
    at = F.when(held, F.col("ts"))
    tie = [c for c in ("sample_idx",) if c in runs.columns]
    return (
        runs.filter(F.col("label") != NEUTRAL)
        .groupBy("session_id", "epoch", "run_id", "label")
        .agg(
            F.min("run_start").alias("run_start"),
            F.min(at).alias("confirm_ts"),
            F.min_by("vector", F.when(held, F.struct("ts", *tie))).alias("vector"),
            F.min("reset_ts").alias("reset_ts"),
        )
        .filter(F.col("confirm_ts").isNotNull())
    )


def edge_triggered_starts(confirmed: DataFrame) -> DataFrame:
    """EP4: without the runs whose label the confirmed run before them in the epoch has."""
    w = Window.partitionBy("session_id").orderBy("confirm_ts", "run_id")
    same = (F.lag("label").over(w) == F.col("label")) & (F.lag("epoch").over(w) == F.col("epoch"))
    return confirmed.withColumn("same", F.coalesce(same, F.lit(False))).filter("not same").drop("same")


def open_event(starts: DataFrame) -> DataFrame:
    """EP5: (session_id, evt_id, state, start_ts, vector) and what closing needs."""
    return starts.select(
        "session_id",
        F.concat(F.lit("evt_"), F.floor(_micros("confirm_ts") / 1_000_000).cast("string")).alias("evt_id"),
        F.col("label").alias("state"),
        F.col("confirm_ts").alias("start_ts"),
        "vector",
        "epoch",
        "run_id",
        "reset_ts",
    )


def close_event(events: DataFrame) -> DataFrame:
    """EP6: end_ts, the next start of the epoch or else the neutral hop that ends it; null if still open."""
    w = Window.partitionBy("session_id").orderBy("start_ts", "run_id")
    after = F.when(F.lead("epoch").over(w) == F.col("epoch"), F.lead("start_ts").over(w))
    return events.withColumn("end_ts", F.coalesce(after, F.col("reset_ts"))).drop("epoch", "run_id", "reset_ts")


def episode_duration(events: DataFrame) -> DataFrame:
    """EP7: duration_sec, whole seconds from start to end."""
    return events.withColumn("duration_sec", F.floor((_micros("end_ts") - _micros("start_ts")) / 1_000_000))


def episodes(hops: DataFrame, sustain: float = 3.0) -> DataFrame:
    """EP1 to EP7: (session_id, evt_id, state, start_ts, vector, end_ts, duration_sec)."""
    if "vector" not in hops.columns:
        hops = hops.withColumn("vector", F.lit(None).cast("array<double>"))
    tie = [c for c in ("sample_idx",) if c in hops.columns]
    runs = label_runs(neutral_epochs(hops.select("session_id", "ts", *tie, "label", "vector")))
    return episode_duration(close_event(open_event(edge_triggered_starts(sustained_runs(runs, sustain)))))


def start_end_actions(events: DataFrame) -> DataFrame:
    """EP8: the log of starts and ends in order; at one instant the end comes first."""
    starts = events.select(
        "session_id", F.lit("start").alias("action"), "evt_id", F.col("start_ts").alias("at_ts"), "state", "vector"
    )
    ends = events.filter(F.col("end_ts").isNotNull()).select(
        "session_id", F.lit("end").alias("action"), "evt_id", F.col("end_ts").alias("at_ts"),
        F.lit(None).cast("string").alias("state"), F.lit(None).cast("array<double>").alias("vector"),
    )
    w = Window.partitionBy("session_id").orderBy("at_ts", F.col("action") == "start", "evt_id")
    return ends.unionByName(starts).withColumn("seq", F.row_number().over(w))
