"""Dashboard series over metrics (DW1 to DW5, PF6, PF7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Display names of the states, and of the series on the chart.
DISPLAY = {
    "happy": "Joyful_Happy (愉悦/开心/积极)",
    "fatigue": "Cognitive_Fatigue (认知疲劳/犯困)",
    "focus": "Hyperactive_Focus (亢奋/高度紧张/专注)",
    "calm": "Peaceful_Calm (平和/深度放松/发呆)",
    "distress": "Emotional_Distress (焦虑/沮丧/冲突)",
}
SERIES = ("fatigue_idx", "focus_idx", "calm_idx", "happy_idx", "distress_idx")


def _w():
    return Window.partitionBy("session_id").orderBy("ts")


def display_state(df: DataFrame, state: str = "state") -> DataFrame:
    """PF6: display_name of each state; rows of other states make no event."""
    pairs = [F.lit(x) for pair in DISPLAY.items() for x in pair]
    return df.filter(F.col(state).isin(*DISPLAY)).withColumn("display_name", F.element_at(F.create_map(*pairs), F.col(state)))


def metrics_with_defaults(metrics: DataFrame) -> DataFrame:
    """PF7: rows that have fatigue_idx, with 0 for what else is missing."""
    return metrics.filter(F.col("fatigue_idx").isNotNull()).withColumns({s: F.coalesce(s, F.lit(0.0)) for s in SERIES})


def rolling_history(metrics: DataFrame, n: int = 60) -> DataFrame:
    """DW1: the n latest points of each session."""
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"))
    return metrics.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n).drop("back")


def rolling_mean(metrics: DataFrame, column: str, n: int = 60) -> DataFrame:
    """DW1 for each hop: mean and number of the n latest points up to it."""
    w = _w().rowsBetween(1 - n, 0)
    return metrics.withColumn("points", F.count(column).over(w)).withColumn("mean", F.avg(column).over(w))


def poll_metrics(metrics: DataFrame, columns: list[str], seconds: int = 1) -> DataFrame:
    """DW2: ticks of each session from its first whole tick on, with the latest values at or before each."""
    w = Window.partitionBy("session_id").orderBy("us")
    rows = metrics.select("session_id", F.unix_micros("ts").alias("us"), *columns)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = [F.last(c, ignorenulls=True).over(so_far).alias(c) for c in columns]
    return ticks_of(rows.select("session_id", "us", F.lead("us").over(w).alias("next_us"), *latest), columns, seconds)


def ticks_of(points: DataFrame, columns: list[str], seconds: int) -> DataFrame:
    """DW2 from points that know when the next one of their session comes (next_us)."""
    step = seconds * 1_000_000
    # A point stands for the ticks from its time to before the next point's, the last one for the tick after it too.
    # They are made an hour of ticks at a time, so that no row holds the ticks of a long gap.
    tick = lambda us: F.ceil(us / F.lit(step)).cast("long")
    end = F.coalesce(tick(F.col("next_us")), tick(F.col("us")) + 1)
    rows = points.select("session_id", tick(F.col("us")).alias("first"), end.alias("end"), *columns).filter("first < end")
    runs = rows.withColumn("from", F.explode(F.sequence("first", F.col("end") - 1, F.lit(3600).cast("long"))))
    ticks = F.sequence("from", F.least(F.col("from") + 3600, F.col("end")) - 1)
    out = runs.withColumn("tick", F.explode(ticks))
    return out.select("session_id", (F.col("tick") * step).alias("us"), *columns)


def carry_forward(polls: DataFrame, columns: list[str]) -> DataFrame:
    """DW3: a poll that failed, with nulls, keeps the last good values; before the first there are none."""
    w = _w().rowsBetween(Window.unboundedPreceding, 0)
    return polls.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def new_events_only(polled: DataFrame, order: str = "poll_no", stamp: str = "event_ts") -> DataFrame:
    """DW4: polled events whose stamp is over all that were seen before; a missing stamp is 0."""
    own = F.coalesce(F.col(stamp), F.lit(0).cast(polled.schema[stamp].dataType))
    w = Window.partitionBy("session_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = polled.withColumn("own", own).withColumn("seen", F.coalesce(F.max("own").over(w), F.lit(0)))
    return rows.filter("own > seen").drop("own", "seen")


def display_round(df: DataFrame, columns: list[str]) -> DataFrame:
    """DW5: one decimal."""
    return df.withColumns({c: F.bround(c, 1) for c in columns})
