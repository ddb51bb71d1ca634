"""Debounced state episodes (EP1 to EP7) of long sessions: the same rows as operators.episodes, by blocks of time.

Hops are dealt by session and block of time. A block is summed up in one row: its first and last label, how many runs,
where its last run began and how many hops it has so far, how many neutral hops, and the first of them. A scan
over a session's summaries, of which there are as many as blocks, tells each block what comes before it (the open run, the
number of runs and of neutral hops) and after it (the next neutral hop), and each block is then worked off by itself. Confirmed runs
and starts are passed from block to block in the same way. So no task holds or sorts a session, only a block of its hops or
its summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brainstate.functions.scoring import NEUTRAL
from brainstate.operators import episodes as windows
from brainstate.operators.episodes import episode_duration, open_event, sustained_runs
from brainstate.sources.shared import stored

#: Seconds of a block.
BLOCK = 3600.0
#: Hops that one task sorts.
WHOLE = 100_000
_KEYS = ("session_id", "block")


def _blocks(ts: str, seconds: float) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(int(seconds * 1_000_000)))


def _order(df: DataFrame) -> list[str]:
    return ["ts", *(c for c in ("sample_idx",) if c in df.columns)]


def _summaries(hops: DataFrame) -> DataFrame:
    """A row for each session and block: what the blocks before and after it pass to it.

    open_label, open_start, open_hops: the run that is open when the block begins. runs_before: the number of its last run
    among all of the session. neutral_before: neutral hops so far. reset_after: the first neutral hop after the block.
    """
    w = Window.partitionBy(*_KEYS).orderBy(*_order(hops))
    changes = F.coalesce((F.col("label") != F.lag("label").over(w)).cast("int"), F.lit(1))
    at = F.struct(*_order(hops))
    neutral = F.col("label") == NEUTRAL
    rows = hops.withColumn("changes", changes).withColumn("run", F.sum("changes").over(w))
    runs = rows.groupBy(*_KEYS, "run").agg(
        F.first("label").alias("label"), F.min(at)["ts"].alias("start"), F.count("*").alias("hops"),
        F.sum(neutral.cast("int")).alias("neutral"), F.min(F.when(neutral, F.col("ts"))).alias("reset"),
    )
    last = F.max_by(F.struct("label", "start", "hops"), "run").alias("last")
    sums = runs.groupBy(*_KEYS).agg(
        F.min_by("label", "run").alias("first_label"), last, F.count("*").alias("runs"), F.sum("neutral").alias("neutral"), F.min("reset").alias("reset"),
    )
    s = Window.partitionBy("session_id").orderBy("block")
    before, upto, after = s.rowsBetween(Window.unboundedPreceding, -1), s.rowsBetween(Window.unboundedPreceding, 0), s.rowsBetween(1, Window.unboundedFollowing)
    goes_on = F.coalesce(F.lag("last.label").over(s) == F.col("first_label"), F.lit(False))
    sums = sums.withColumn("goes_on", goes_on).withColumn("breaks", ~F.col("goes_on") | (F.col("runs") > 1))
    # The run at a block's end began in the last block that broke it.
    sums = (
        sums.withColumn("open_start", F.last(F.when(F.col("breaks"), F.col("last.start")), ignorenulls=True).over(upto))
        .withColumn("chain", F.sum(F.col("breaks").cast("int")).over(upto))
        .withColumn("new_runs", F.col("runs") - F.col("goes_on").cast("int"))
    )
    c = Window.partitionBy("session_id", "chain").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("open_hops", F.sum("last.hops").over(c))
    passed = lambda x: F.lag(x).over(s)
    zero = lambda x: F.coalesce(x, F.lit(0))
    return sums.select(
        *_KEYS, passed("last.label").alias("open_label"), passed("open_start").alias("open_start"), passed("open_hops").alias("open_hops"),
        zero(F.sum("new_runs").over(before)).alias("runs_before"), zero(F.sum("neutral").over(before)).alias("neutral_before"),
        F.min("reset").over(after).alias("reset_after"),
    )


def label_runs(hops: DataFrame, block: float = BLOCK) -> DataFrame:
    """EP1 and EP3 by blocks: hops with run_id, hop_no, run_start, epoch and reset_ts, as the window forms give them."""
    dealt = stored(hops.withColumn("block", _blocks("ts", block)), "hops")
    w = Window.partitionBy(*_KEYS).orderBy(*_order(hops))
    so_far, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    neutral = F.col("label") == NEUTRAL
    rows = dealt.join(_summaries(dealt), list(_KEYS))
    before = F.coalesce(F.lag("label").over(w), F.col("open_label"))
    rows = rows.withColumn("change", F.coalesce((F.col("label") != before).cast("int"), F.lit(1)))
    rows = rows.withColumn("here", F.sum("change").over(so_far))
    run = Window.partitionBy(*_KEYS, "here").orderBy(*_order(hops))
    first = F.col("here") == 0  # goes on from the block before
    return (
        rows.withColumn("hop_no", F.row_number().over(run) + F.when(first, F.col("open_hops")).otherwise(0))
        .withColumn("run_start", F.when(first, F.col("open_start")).otherwise(F.first("ts").over(run)))
        .withColumn("run_id", F.col("runs_before") + F.col("here"))
        .withColumn("epoch", F.col("neutral_before") + F.sum(neutral.cast("int")).over(so_far))
        .withColumn("reset_ts", F.coalesce(F.min(F.when(neutral, F.col("ts"))).over(ahead), "reset_after"))
        .select(*hops.columns, "run_id", "hop_no", "run_start", "epoch", "reset_ts")
    )


def _beside(rows: DataFrame, value: Column, order: str, name: str, ahead: bool) -> DataFrame:
    """rows (session_id, block, ...) with the value of the row before (or after) each in its session."""
    shift, pick = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    at = F.struct(order, "run_id")
    ends = rows.groupBy(*_KEYS).agg(pick(value, at).alias("end"))
    ends = ends.select(*_KEYS, shift("end").over(Window.partitionBy("session_id").orderBy("block")).alias("other"))
    near = shift(value).over(Window.partitionBy(*_KEYS).orderBy(order, "run_id"))
    return rows.join(ends, list(_KEYS)).withColumn(name, F.coalesce(near, "other")).drop("other")


def edge_triggered_starts(confirmed: DataFrame, block: float = BLOCK) -> DataFrame:
    """EP4 by blocks."""
    rows = stored(confirmed.withColumn("block", _blocks("confirm_ts", block)), "confirmed")
    rows = _beside(rows, F.struct("label", "epoch"), "confirm_ts", "past", ahead=False)
    same = (F.col("past.label") == F.col("label")) & (F.col("past.epoch") == F.col("epoch"))
    return rows.filter(~F.coalesce(same, F.lit(False))).drop("past", "block")


def close_event(events: DataFrame, block: float = BLOCK) -> DataFrame:
    """EP6 by blocks."""
    rows = stored(events.withColumn("block", _blocks("start_ts", block)), "starts")
    rows = _beside(rows, F.struct("epoch", "start_ts"), "start_ts", "following", ahead=True)
    after = F.when(F.col("following.epoch") == F.col("epoch"), F.col("following.start_ts"))
    return rows.withColumn("end_ts", F.coalesce(after, F.col("reset_ts"))).drop("epoch", "run_id", "reset_ts", "block", "following")


def episodes(hops: DataFrame, sustain: float = 3.0, block: float = BLOCK, whole: int = WHOLE) -> DataFrame:
    """EP1 to EP7: (session_id, evt_id, state, start_ts, vector, end_ts, duration_sec), by blocks if a session has more than `whole` hops.

    Shorter sessions are sorted whole, which gives the same rows with fewer shuffles.
    """
    if (hops.groupBy("session_id").count().agg(F.max("count")).first()[0] or 0) <= whole:
        return windows.episodes(hops, sustain)
    if "vector" not in hops.columns:
        hops = hops.withColumn("vector", F.lit(None).cast("array<double>"))
    tie = [c for c in ("sample_idx",) if c in hops.columns]
    runs = label_runs(hops.select("session_id", "ts", *tie, "label", "vector"), block)
    return episode_duration(close_event(open_event(edge_triggered_starts(sustained_runs(runs, sustain), block)), block))
