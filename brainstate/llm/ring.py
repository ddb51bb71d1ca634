"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard has many points on a ring. A key belongs to the shard of the first point clockwise from its own; if that
shard is full when the key's turn comes, the key continues clockwise to the next shard that isn't. Turns are a hash of
the key too, so a key's shard doesn't depend on the order of the table. A shard is full when it holds its capacity:
with a slack s that is the (1 + s)-fold of an even share, rounded up, and few keys move when a shard is added; with
none the capacities add up to the rows, so that all shards end full and their rows differ by one at most.

A key's shard follows from its turn and the turns at which the shards fill up, of which there are as many as shards. These
are found one after the other: keys are counted by shard and by blocks of turns, the block in which the first shard fills is
cut into blocks again, down to one key. So what the driver sees is a count for each shard and block, BLOCKS of
them at most, and no task holds a shard. Only built-in functions are used.

Defined results: rows with null ids have the point and the turn of an empty one; rows with equal ids are told apart by
size and checksum, equal rows are placed each by itself. A null text has size 1 and the checksum of an empty one. With
fewer rows than shards some shards stay empty. A table without rows gives none. Other columns have no part in it.
"""

from __future__ import annotations

from hashlib import md5
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brainstate.llm.common import stored
from brainstate.llm.ordering import md5_number, offsets, ranked

SHARDS = 8
VIRTUAL = 64
#: Blocks of turns whose keys are counted at a time.
BLOCKS = 2048
#: Bits of a place on the ring, and those of the cells by which arcs are looked up.
BITS, CELL_BITS = 60, 8


def arcs(shards: int, virtual: int) -> list[tuple[int, int, list[int]]]:
    """(first place, last place, shards clockwise) of the arcs that end at the ring's points."""
    points = sorted((int(md5(f"{s}/{v}".encode()).hexdigest()[:15], 16), s) for s in range(shards) for v in range(virtual))
    out = []
    for i, (place, _) in enumerate(points):
        clockwise = list(dict.fromkeys(s for _, s in points[i:] + points[:i]))
        before = points[i - 1][0]
        out += [(before + 1, place, clockwise)] if i else [(before + 1, (1 << BITS) - 1, clockwise), (0, place, clockwise)]
    return [x for x in out if x[0] <= x[1]]


def _ring(spark: SparkSession, shards: int, virtual: int) -> DataFrame:
    """(cell, low, high, clockwise): the arcs by the cells they reach into, at most shards * virtual + 1 + 2 ** CELL_BITS rows."""
    shift = BITS - CELL_BITS
    rows = [
        f"({cell}, {low}L, {high}L, array({', '.join(map(str, clockwise))}))"
        for low, high, clockwise in arcs(shards, virtual)
        for cell in range(low >> shift, (high >> shift) + 1)
    ]
    return spark.sql(f"select * from values {', '.join(rows)} as ring(cell, low, high, clockwise)")


def _shard_of(full: list[int | None]) -> Column:
    """The first shard clockwise that isn't full at a key's turn; full: the last turn that each shard takes."""
    last = F.array(*(F.lit(2**62 if x is None else x).cast("long") for x in full))
    return F.get(F.filter("clockwise", lambda s: F.get(last, s) >= F.col("turn")), F.lit(0))


def _filled(rows: DataFrame, n: int, capacity: list[int]) -> list[int | None]:
    """The last turn that each shard takes; -1 if it takes none, None if it never fills."""
    full: list[int | None] = [None if c else -1 for c in capacity]
    held, start = [0] * len(capacity), 0
    while start < n and None in full:
        low, high = start, n
        while True:
            size = ceil((high - low) / BLOCKS)
            block = F.floor((F.col("turn") - F.lit(low)) / F.lit(size)).alias("block")
            counts: dict[int, dict[int, int]] = {}
            inside = rows.filter((F.col("turn") >= low) & (F.col("turn") < high))
            for r in inside.groupBy(_shard_of(full).alias("shard"), block).count().collect():  # at most shards * BLOCKS
                counts.setdefault(r.block, {})[r.shard] = r["count"]
            for b in sorted(counts):
                if any(full[s] is None and held[s] + c >= capacity[s] for s, c in counts[b].items()):
                    break
                for s, c in counts[b].items():
                    held[s] += c
            else:
                return full
            low, high = low + b * size, min(high, low + (b + 1) * size)
            if size == 1:  # one key, which fills its shard
                (s,) = counts[b]
                held[s] += 1
                full[s], start = low, high
                break
    return full


def on_ring(
    docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, slack: float = 0.0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, size, text_crc32, home, shard, slot) of each row of docs.

    home: the shard of the key's own place. slot: its number in its shard, gapless from 0. size: the text's bytes
    in UTF-8 and 1.
    """
    spark = docs.sparkSession
    named = F.coalesce(F.col("id").cast("string"), F.lit(""))
    body = F.coalesce("body", F.lit(""))
    keys = stored(
        docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("body")).select(
            "id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
            md5_number(F.concat(F.lit("turn/"), named)).alias("hash"), md5_number(F.concat(F.lit("ring/"), named)).alias("at"),
        ),
        "keys",
    )
    ordered = ranked(keys, "turns", "hash", "id", "size", "text_crc32")
    parts = F.broadcast(offsets(ordered).select("range", "before"))  # a row for each range, not for rows of the table
    ring = F.broadcast(_ring(spark, shards, virtual))  # of a size that the parameters give
    cell = F.shiftright("at", BITS - CELL_BITS) == F.col("cell")
    rows = stored(
        ordered.join(parts, "range")
        .join(ring, cell & F.col("at").between(F.col("low"), F.col("high")))
        .select("id", "size", "text_crc32", "range", (F.col("before") + F.col("place")).alias("turn"), "clockwise"),
        "rows",
    )
    n = rows.count()
    even = [n // shards + (s < n % shards) for s in range(shards)]
    capacity = [ceil((1 + slack) * n / shards)] * shards if slack else even
    placed = rows.withColumn("shard", _shard_of(_filled(rows, n, capacity))).withColumn("home", F.get("clockwise", F.lit(0)))
    return _with_slots(placed).select(F.col("id").alias(key), "size", "text_crc32", "home", "shard", "slot")


def _with_slots(placed: DataFrame) -> DataFrame:
    """placed with slot: keys of a shard are numbered in their turns, range by range."""
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "range").agg(F.count("*").alias("n"))
    counts = counts.select("shard", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("taken"))
    here = F.row_number().over(Window.partitionBy("shard", "range").orderBy("turn")) - 1
    return placed.join(counts, ["shard", "range"]).withColumn("slot", F.col("taken") + here)
