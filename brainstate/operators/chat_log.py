"""An ordered log of edits, deletions and appends of chat messages (CH6, CH7, CH10), applied one after the other.

A session's list is kept as runs: old messages from a turn on, or new ones of one action each. Only the actions of a session are
read in their order, as a stream; its messages, and the texts of actions, never come together: each finds its
new turn by a join with the runs, which are cut at every CUT turns, so that a long session is no hot key. The
state of a session is its runs, of which each deletion adds one at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turns of old messages in a piece of a run.
CUT = 256
_OLD = -1


class Turns:
    """The turns of a session as runs (action, first, length): an old one starts at its first turn, a new one is one message."""

    def __init__(self, size: int):
        self.runs = [(_OLD, 0, size)] if size else []
        self.lengths = np.array([size] if size else [], np.int64)

    def size(self) -> int:
        return int(self.lengths.sum())

    def _at(self, turn: int) -> tuple[int, int]:
        """The run that holds a turn, and the turn's place in it."""
        ends = np.cumsum(self.lengths)
        run = int(np.searchsorted(ends, turn, "right"))
        return run, turn - int(ends[run] - self.lengths[run])

    def _replace(self, run: int, new: list[tuple[int, int, int]], upto: int | None) -> None:
        new = [x for x in new if x[2]]
        stop = run + 1 if upto is None else upto
        self.runs[run:stop] = new
        self.lengths = np.concatenate([self.lengths[:run], np.array([x[2] for x in new], np.int64), self.lengths[stop:]])

    def append(self, action: int) -> None:
        self._replace(len(self.runs), [(action, 0, 1)], len(self.runs))

    def cut(self, turn: int) -> None:
        """Drop this turn and all after it."""
        if turn < self.size():
            run, place = self._at(turn)
            of, first, _ = self.runs[run]
            self._replace(run, [(of, first, place)], len(self.runs))

    def delete(self, turn: int) -> None:
        if turn < self.size():
            run, place = self._at(turn)
            of, first, length = self.runs[run]
            self._replace(run, [(of, first, place), (of, first + place + 1, length - place - 1)], None)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (session, action, first, length, turn) of sessions whose size and actions come in order."""
    session, turns = None, None

    def runs() -> pa.RecordBatch:
        found = [] if turns is None else turns.runs
        starts = np.append(0, np.cumsum([x[2] for x in found]))[: len(found)]
        columns = [np.array([x[i] for x in found], np.int64) for i in range(3)]
        return pa.RecordBatch.from_arrays(
            [pa.array([session] * len(found), kind), *map(pa.array, columns), pa.array(starts.astype(np.int64))], ["session", "action", "first", "length", "turn"]
        )

    kind = pa.null()
    for batch in batches:
        kind = batch["session"].type
        for of, number, what, turn in zip(*(batch[c].to_pylist() for c in ("session", "number", "what", "turn")), strict=True):
            if what == "size":
                if turns is not None:
                    yield runs()
                session, turns = of, Turns(turn)
            elif what == "append":
                turns.append(number)
            elif turn is not None and turn >= 0:
                if what == "delete":
                    turns.delete(turn)
                else:
                    turns.cut(turn)
                    turns.append(number)
    if turns is not None:
        yield runs()


def apply_log(messages: DataFrame, actions: DataFrame) -> DataFrame:
    """messages (session_id, turn, role, text) after actions (session_id, seq, what, turn, role, text) in the order of seq.

    Turns of a session count from 0 without gaps. what: "edit" drops all messages from turn on and puts the text there as
    the user's, past the end it appends; "delete" takes out a turn, and those after it move up, past the end it does
    nothing; "append" puts role and text at the end. Blank edits and turns that are null or negative do nothing. Actions
    with equal seq go by what, turn and text. A session that only actions name begins empty; rows without a session_id stay out.
    """
    rows = messages.select("session_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    real = actions.filter(F.col("session_id").isNotNull() & ((F.col("what") != "edit") | F.col("text").rlike(r"(?U)[^\s]")))
    # An action's key is its own, so equal ones of a session are told apart; it is a hash of what orders it.
    acts = real.select("session_id", "seq", "what", F.col("turn").cast("long").alias("turn"), F.when(F.col("what") == "edit", "user").otherwise(F.col("role")).alias("role"), "text")
    order = ["seq", "what", "turn", "role", "text"]
    same = acts.groupBy("session_id", *order).agg(F.count("*").alias("copies"))
    named = same.withColumn("number", F.xxhash64(*order).bitwiseAND(F.lit(2**63 - 1)))
    log = named.select("session_id", "number", "what", "turn", "seq", "text", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    touched = acts.select("session_id").distinct()
    sizes = (
        touched.join(rows.groupBy("session_id").agg(F.count("*").alias("n")), "session_id", "left")
        .select("session_id", F.lit(None).cast("long").alias("number"), F.lit("size").alias("what"), F.coalesce("n", F.lit(0)).cast("long").alias("turn"))
    )
    steps = (
        log.unionByName(sizes, allowMissingColumns=True)
        .repartition("session_id")
        .sortWithinPartitions("session_id", F.col("what") != "size", "seq", "what", "turn", "text", "copy")
        .select(F.col("session_id").alias("session"), "number", "what", "turn")
    )
    kind = messages.schema["session_id"].dataType.simpleString()
    runs = steps.mapInArrow(_folded, f"session {kind}, action long, first long, length long, turn long").withColumnRenamed("session", "session_id")
    piece = F.col("first") + F.col("length") - 1
    old = runs.filter(F.col("action") == _OLD).select(
        "session_id", "first", "length", F.col("turn").alias("start"),
        F.explode(F.sequence(F.floor(F.col("first") / CUT), F.floor(piece / CUT))).alias("piece"),
    )
    inside = F.col("turn").between(F.col("first"), piece)
    moved = (
        rows.withColumn("piece", F.floor(F.col("turn") / CUT))
        .join(old, ["session_id", "piece"])
        .filter(inside)
        .select("session_id", (F.col("start") + F.col("turn") - F.col("first")).alias("turn"), "role", "text")
    )
    new = runs.filter(F.col("action") != _OLD).select("session_id", F.col("action").alias("number"), "turn")
    said = new.join(named.select("session_id", "number", "role", "text"), ["session_id", "number"]).select("session_id", "turn", "role", "text")
    return rows.join(touched, "session_id", "left_anti").unionByName(moved).unionByName(said)
