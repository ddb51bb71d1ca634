"""RT2 and RT4 over long sessions: the exact nearest earlier vector, with blocks of near vectors that needn't be compared.

Some rows are drawn as centres, about one for each `block` rows, and each row joins the centre at the smallest angle. Rows
are first compared inside of their clusters. Then a row asks another cluster only if some member may be nearer than what it has:
by the triangle inequality no member is nearer than the row's angle to the centre less the cluster's largest angle.
Nor is a cluster asked that has no earlier member. So the vectors that travel are those that ask, once for each cluster that they
ask, and a cluster's members once for each slice of rows that ask it. Everything is dealt in groups of about `block` rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brainstate.sources.shared import stored

#: Radians that rounding may take from an angle: that of two equal vectors may come out as 2e-8.
SLACK = 1e-6


def unit(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of length 1."""
    v = np.array(vectors.to_pylist(), float)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _joined(rows: pa.Table, centres: pa.Table) -> pa.Table:
    """rows with the centre at the smallest angle, and that angle."""
    centres = centres.sort_by("centre")
    if not len(rows):
        return rows.append_column("cluster", centres["centre"].slice(0, 0)).append_column("angle", pa.array([], pa.float64()))
    found = angles(unit(rows["v"]), unit(centres["v"]))
    best = found.argmin(axis=1)
    return rows.append_column("cluster", centres["centre"].take(best)).append_column("angle", pa.array(found.min(axis=1)))


def _asking(digits: int | None):
    def run(rows: pa.Table, clusters: pa.Table) -> pa.Table:
        """(session_id, seq, v, slice, cluster): rows and the other clusters that may have a nearer earlier member."""
        names = ["session_id", "seq", "v", "slice"]
        if not len(rows) or not len(clusters):
            return rows.select(names).slice(0, 0).append_column("cluster", clusters["centre"].slice(0, 0))
        least = rows["d"].to_numpy(zero_copy_only=False)
        least = np.where(np.isnan(least), 2.0, least) + (0.0 if digits is None else 10.0**-digits)
        reach = np.arccos(np.clip(1.0 - least, -1.0, 1.0)) + SLACK
        bound = angles(unit(rows["v"]), unit(clusters["v"])) - clusters["radius"].to_numpy()
        asks = (bound <= reach[:, None]) & (clusters["first"].to_numpy() < rows["seq"].to_numpy()[:, None])
        asks &= clusters["centre"].to_numpy() != rows["cluster"].to_numpy()[:, None]
        who, whom = np.nonzero(asks)
        return rows.select(names).take(who).append_column("cluster", clusters["centre"].take(whom))

    return run


def clustered(known: DataFrame, block: int) -> DataFrame:
    """known (session_id, seq, v) with slice (of about `block` rows), slices (how many), cluster (the seq of its centre) and angle."""
    h = F.xxhash64("seq")
    sizes = known.groupBy("session_id").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("slices"), F.min(h).alias("h0"))
    dealt = known.join(sizes, "session_id").withColumn("slice", F.pmod(F.shiftright(h, 20), F.col("slices")))
    # One in `block` rows, and one at least.
    drawn = (F.pmod(h, F.lit(block)) == 0) | (h == F.col("h0"))
    dealt = stored(dealt.select("session_id", "seq", "v", "slice", "slices", drawn.alias("drawn")), "dealt")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice")
    centres = dealt.filter("drawn").select(F.col("session_id").alias("session_id"), F.col("seq").alias("centre"), F.col("v").alias("v"), every)
    kinds = {f.name: f.dataType.simpleString() for f in known.schema.fields}
    rows = dealt.drop("drawn").groupBy("session_id", "slice").cogroup(centres.groupBy("session_id", "slice"))
    schema = f"session_id {kinds['session_id']}, seq {kinds['seq']}, v {kinds['v']}, slice long, slices long, cluster {kinds['seq']}, angle double"
    return stored(rows.applyInArrow(_joined, schema), "clusters")


def asking(rows: DataFrame, best: DataFrame, digits: int | None) -> DataFrame:
    """(session_id, seq, v, slice, cluster): the rows of clustered() and the clusters they must ask, after best (session_id, seq, d)."""
    whole = rows.groupBy("session_id", "cluster").agg(F.max("angle").alias("radius"), F.min("seq").alias("first"))
    centres = rows.filter("seq = cluster").select("session_id", "cluster", "v", "slices")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice")
    named = lambda c: F.col(c).alias(c)  # noqa: E731  a column of its own, as both sides come from one table
    clusters = whole.join(centres, ["session_id", "cluster"]).select(named("session_id"), named("cluster").alias("centre"), named("v"), "radius", "first", every)
    asked = rows.join(best.select("session_id", "seq", "d"), ["session_id", "seq"], "left")
    asked = asked.select("session_id", "seq", "v", "slice", "cluster", "d")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields if f.name != "d")
    groups = asked.groupBy("session_id", "slice").cogroup(clusters.groupBy("session_id", "slice"))
    return groups.applyInArrow(_asking(digits), schema)


def nearest_by_clusters(known: DataFrame, within, across, block: int, digits: int | None) -> DataFrame:
    """(session_id, seq, best: (d, past)) of known (session_id, seq, v).

    within: a function of a group of rows (own, seq, v), which gives what is nearest inside; across: the same for asking
    rows and a memory.
    """
    kinds = {f.name: f.dataType.simpleString() for f in known.schema.fields}
    schema = f"session_id {kinds['session_id']}, seq {kinds['seq']}, d double, past {kinds['seq']}"
    rows = clustered(known, block)
    sizes = rows.groupBy("session_id", "cluster").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("n"))
    parts = rows.join(sizes, ["session_id", "cluster"]).withColumn("own", F.pmod(F.xxhash64("seq"), F.col("n")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    pairs = parts.withColumn("other", every).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    inside = pairs.select("session_id", "cluster", "i", "j", "own", "seq", "v").groupBy("session_id", "cluster", "i", "j").applyInArrow(within, schema)
    inside = stored(inside, "inside")
    best = inside.groupBy("session_id", "seq").agg(F.min("d").alias("d"))
    asks = stored(asking(rows, best, digits), "asking")
    named = lambda df, *names: df.select(*(F.col(c).alias(c) for c in names))
    wanted = named(asks, "session_id", "cluster", "slice").distinct()
    memory = named(parts, "session_id", "cluster", "own", "seq", "v").join(wanted, ["session_id", "cluster"])
    asked = asks.join(named(sizes, "session_id", "cluster", "n"), ["session_id", "cluster"]).withColumn("own", every)
    keys = ["session_id", "cluster", "own", "slice"]
    outside = asked.select(*keys, "seq", "v").groupBy(*keys).cogroup(memory.groupBy(*keys)).applyInArrow(across, schema)
    return inside.unionByName(outside).groupBy("session_id", "seq").agg(F.min(F.struct("d", "past")).alias("best"))
