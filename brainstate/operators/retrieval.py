"""Similarity search and timelines (RT2 to RT9)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brainstate.functions.vectors import norm
from brainstate.operators.pruned import nearest_by_clusters, unit

#: Texts for an empty memory and for no similar one.
NO_HISTORY = "无相关历史记录。"
NO_SIMILAR = "无相似记忆"
PROCESSING = " (AI 归因中...)"
SEPARATOR = "\n\n---\n\n"


def _nearest_of_blocks(digits: int | None):
    """For the rows of a pair of blocks the nearest earlier ones of the other block."""

    def run(table: pa.Table) -> pa.Table:
        """(session_id, seq, d, past)"""
        table = table.sort_by("seq")
        own, seq = table["own"].to_numpy(), table["seq"].to_numpy()
        vectors = np.array(table["v"].to_pylist(), float)
        vectors /= np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
        first, last = own.min(), own.max()
        asked, past, d = [], [], []
        for mine, others in {(first, last), (last, first)}:
            rows, memory = np.flatnonzero(own == mine), np.flatnonzero(own == others)
            for at in range(0, len(rows), 256):
                some = rows[at : at + 256]
                # Each product is summed in one order, so that equal vectors are equally far.
                distance = 1.0 - np.einsum("ik,jk->ij", vectors[some], vectors[memory])
                distance = distance if digits is None else np.round(distance, digits)
                distance[seq[memory] >= seq[some][:, None]] = np.inf
                best = distance.argmin(axis=1)  # of equal ones the earliest
                least = distance[np.arange(len(some)), best]
                found = np.isfinite(least)
                asked.append(some[found])
                past.append(memory[best[found]])
                d.append(least[found])
        rows, memory = np.concatenate(asked), np.concatenate(past)
        columns = [table["session_id"].take(rows), table["seq"].take(rows), pa.array(np.concatenate(d)), table["seq"].take(memory)]
        return pa.table(columns, ["session_id", "seq", "d", "past"])

    return run


def nearest_prior(
    rows: DataFrame, order: str = "mem_seq", vector: str = "vector", block: int = 2048, digits: int | None = None
) -> DataFrame:
    """RT2: (session_id, <order>, past, distance): for each row the nearest of those before it in its session.

    Rows (session_id, <order>, vector); zero vectors match nothing, ties go to the earliest, and the first row
    gets null. digits: decimals to which distances are equal; all, if it isn't given. The search is exact. Sessions of at most `block`
    rows are compared whole; where there are longer ones, all go through clusters, which leave out what can't be nearest.
    """
    made = rows.select("session_id", F.col(order).alias("seq"), F.col(vector).alias("v"))
    known = made.filter(norm(F.col("v")) > 0)
    longest = known.groupBy("session_id").count().agg(F.max("count")).first()[0] or 0
    if longest > block:
        near = nearest_by_clusters(known, _nearest_of_blocks(digits), _nearest_of_two(digits), block, digits)
    else:
        kinds = {f.name: f.dataType.simpleString() for f in made.schema.fields}
        schema = f"session_id {kinds['session_id']}, seq {kinds['seq']}, d double, past {kinds['seq']}"
        whole = known.withColumn("own", F.lit(0)).groupBy("session_id").applyInArrow(_nearest_of_blocks(digits), schema)
        near = whole.select("session_id", "seq", F.struct("d", "past").alias("best"))
    return made.join(near, ["session_id", "seq"], "left").select(
        "session_id", F.col("seq").alias(order), F.col("best.past").alias("past"), F.col("best.d").alias("distance")
    )


def _nearest_of_two(digits: int | None = None):
    """For asked rows the nearest earlier ones of a block of the memory."""

    def run(asked: pa.Table, memory: pa.Table) -> pa.Table:
        """(session_id, seq, d, past)"""
        memory = memory.sort_by("seq")
        rows, best, least = [], [], []
        if len(asked) and len(memory):
            a, m, seq = unit(asked["v"]), unit(memory["v"]), memory["seq"].to_numpy()
            for at in range(0, len(asked), 256):
                # Each product is summed in one order, so that equal vectors are equally far.
                distance = 1.0 - np.einsum("ik,jk->ij", a[at : at + 256], m)
                distance = distance if digits is None else np.round(distance, digits)
                distance[seq >= asked["seq"].to_numpy()[at : at + 256, None]] = np.inf
                first = distance.argmin(axis=1)  # of equal ones the earliest
                found = np.flatnonzero(np.isfinite(distance[np.arange(len(distance)), first]))
                rows += (found + at).tolist()
                best += first[found].tolist()
                least += distance[found, first[found]].tolist()
        rows, best = pa.array(rows, pa.int64()), pa.array(best, pa.int64())
        columns = [asked["session_id"].take(rows), asked["seq"].take(rows), pa.array(least, pa.float64()), memory["seq"].take(best)]
        return pa.table(columns, ["session_id", "seq", "d", "past"])

    return run


def nearest_stored(asked: DataFrame, memory: DataFrame, order: str, vector: str, block: int = 2048) -> DataFrame:
    """RT4: (session_id, <order>, past, distance): for each asked row the nearest row of memory before it in its session.

    As nearest_prior, but only some rows ask: blocks of these meet blocks of the memory, so the work is their product. Rows
    that find nothing are left out.
    """
    def known(rows: DataFrame) -> DataFrame:
        # Columns of their own, as both may come from one table.
        made = rows.select(*(F.col(c).alias(n) for c, n in (("session_id", "session_id"), (order, "seq"), (vector, "v"))))
        return made.filter(norm(F.col("v")) > 0)

    def blocks(rows: DataFrame, n: str) -> DataFrame:
        return rows.groupBy("session_id").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias(n))

    def dealt(rows: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_other) - 1))
        return rows.join(sizes, F.col("session_id") == F.col("of")).drop("of").withColumn(own, F.pmod(F.xxhash64("seq"), n_own)).withColumn(other, every).drop("n_a", "n_m")

    asks, holds = known(asked), known(memory)
    sizes = blocks(asks, "n_a").join(blocks(holds, "n_m"), "session_id").withColumnRenamed("session_id", "of")
    a, m = dealt(asks, "i", "n_a", "j", "n_m"), dealt(holds, "j", "n_m", "i", "n_a")
    kinds = {f.name: f.dataType.simpleString() for f in asks.schema.fields}
    near = a.groupBy("session_id", "i", "j").cogroup(m.groupBy("session_id", "i", "j"))
    schema = f"session_id {kinds['session_id']}, seq {kinds['seq']}, d double, past {kinds['seq']}"
    best = near.applyInArrow(_nearest_of_two(), schema).groupBy("session_id", "seq").agg(F.min(F.struct("d", "past")).alias("best"))
    return best.select("session_id", F.col("seq").alias(order), F.col("best.past").alias("past"), F.col("best.d").alias("distance"))


def new_trials_only(trials: DataFrame, memory: DataFrame) -> DataFrame:
    """RT3: trials whose id isn't in memory yet."""
    return trials.join(memory, ["session_id", "trial_id"], "left_anti")


def similar_state_context(events: DataFrame, threshold: float = 0.2, block: int = 2048) -> DataFrame:
    """RT4: events (session_id, start_ts, vector, context) with similar_context, that of the nearest earlier event.

    Only a distance under the threshold counts. The event itself isn't stored yet when it asks.
    """
    near = nearest_prior(events, "start_ts", "vector", block)
    past = events.select("session_id", F.col("start_ts").alias("past"), F.col("context").alias("past_context"))
    close = near.filter(F.col("distance") < threshold).join(past, ["session_id", "past"])
    out = events.join(close.select("session_id", "start_ts", "distance", "past_context"), ["session_id", "start_ts"], "left")
    return out.withColumn("similar_context", F.coalesce("past_context", F.lit(NO_SIMILAR))).drop("past_context")


def recent_timeline(memory: DataFrame, n: int = 10, tie: str = "evt_id") -> DataFrame:
    """RT5: the n latest rows of each session, numbered from the oldest."""
    w = Window.partitionBy("session_id")
    latest = memory.withColumn("back", F.row_number().over(w.orderBy(F.desc("ts"), F.desc(tie)))).filter(F.col("back") <= n)
    return latest.withColumn("place", F.row_number().over(w.orderBy(F.desc("back")))).drop("back")


def timeline_text(recent: DataFrame, sessions: DataFrame) -> DataFrame:
    """RT6: (session_id, timeline) of each of sessions: its documents, oldest first, or the text for none."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "document"))), lambda x: x["document"])
    texts = recent.groupBy("session_id").agg(F.array_join(parts, SEPARATOR).alias("timeline"))
    return sessions.join(texts, "session_id", "left").withColumn("timeline", F.coalesce("timeline", F.lit(NO_HISTORY)))


def last_state_occurrence(episodes: DataFrame) -> DataFrame:
    """RT7: the latest episode of each session and state: start, end, duration and whether it is still open."""
    last = F.max_by(F.struct("evt_id", "start_ts", "end_ts", "duration_sec"), "start_ts").alias("last")
    out = episodes.groupBy("session_id", "state").agg(last).select("session_id", "state", "last.*")
    return out.withColumn("still_open", F.col("end_ts").isNull())


def states_of_day(episodes: DataFrame) -> DataFrame:
    """RT8: episodes, seconds, first and last start of each state on each day."""
    return episodes.groupBy("session_id", F.to_date("start_ts").alias("day"), "state").agg(
        F.count("*").alias("n_episodes"),
        F.coalesce(F.sum("duration_sec"), F.lit(0)).alias("total_sec"),
        F.min("start_ts").alias("first_ts"),
        F.max("start_ts").alias("last_ts"),
    )


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """RT9: the latest metrics row of each session."""
    rest = [c for c in metrics.columns if c != "session_id"]
    return metrics.groupBy("session_id").agg(F.max_by(F.struct(*rest), "ts").alias("m")).select("session_id", "m.*")


def latest_event(events: DataFrame) -> DataFrame:
    """RT9: the latest event of each session; of the two notices of one start the final one."""
    final = events.filter(~F.col("state").endswith(PROCESSING))
    return latest_metrics(final)
