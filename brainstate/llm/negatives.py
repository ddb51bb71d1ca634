"""Hard negatives of anchors by exact integer products of tiles.

Vectors are quantized to 64-bit integers. Anchors and candidates are dealt to blocks, and each pair of blocks is a tile,
whose scores are one product of matrices by Strassen's recursion: seven products of quadrants in place of
eight, on sides padded with zeros, with exact additions. Sums wrap around at 64 bits, which does no harm, as what they add up to
is the score again; a tile whose scores could be beyond 64 bits is an error and not a wrong number.

A first pass over tiles of one label keeps for each anchor the best few of a tile, its heap of positives. Each positive
gives a window of scores, and a second pass over all tiles keeps the best few of each window from other labels. Heaps of
tiles merge by a limit for each anchor (and window), which Spark applies before it shuffles and again after.

Defined results: rows with a null id, a null label, a null vector, or a component that is null or not finite take no
part; of rows with equal ids the one with the smallest label and vector stands for all. Vectors of different lengths are
padded with zeros, an empty one scores 0. Of equal scores the smaller id comes first. Positives with a negative score
have empty windows. Anchors without positives and positives without negatives give no rows. A table without rows gives
none. Other columns have no part in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brainstate.llm.common import stored

POSITIVES, NEGATIVES = 5, 3
#: A negative's score in percent of the positive's, from and to.
LOW, HIGH = 50, 95
SCALE = 256
#: Anchors and candidates in a tile, about.
ANCHORS, CANDIDATES = 2048, 1024
#: A product with a side of at most so many is taken as it is; whole float products are exact below 2 ** 53.
LEAF, EXACT = 16, 2**53
_NONE = np.iinfo(np.int64).min


def _leaf_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _halved(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    if not depth:
        return _leaf_product(a, b)
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = _halved(a11 + a22, b11 + b22, depth - 1)
    p2 = _halved(a21 + a22, b11, depth - 1)
    p3 = _halved(a11, b12 - b22, depth - 1)
    p4 = _halved(a22, b21 - b11, depth - 1)
    p5 = _halved(a11 + a12, b22, depth - 1)
    p6 = _halved(a21 - a11, b11 + b12, depth - 1)
    p7 = _halved(a12 - a22, b21 + b22, depth - 1)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of int64 matrices; ValueError if it could be beyond 64 bits."""
    (m, k), n = a.shape, b.shape[1]
    most = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if most(a) * most(b) * max(k, 1) >= 2**63:
        raise ValueError("scores may be beyond 64 bits")
    depth = 0
    while min(m, k, n) >> depth > leaf:
        depth += 1
    side = lambda x: -(-x >> depth) << depth
    padded = [np.zeros((side(x.shape[0]), side(x.shape[1])), np.int64) for x in (a, b)]
    padded[0][:m, :k], padded[1][:k, :n] = a, b
    return _halved(*padded, depth)[:m, :n]


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, padded to a width with zeros."""
    vectors = vectors.combine_chunks()
    flat, ends = vectors.flatten().to_numpy(), np.append(0, np.cumsum(vectors.value_lengths().to_numpy()))
    if len(vectors) and (np.diff(ends) == width).all():
        return flat.reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), np.int64)
    for i in range(len(vectors)):
        out[i, : ends[i + 1] - ends[i]] = flat[ends[i] : ends[i + 1]]
    return out


def _scores(a: pa.Table, c: pa.Table) -> np.ndarray:
    width = max([0, *(int(x["vector"].combine_chunks().value_lengths().to_numpy().max()) for x in (a, c))])
    return strassen(_matrix(a["vector"], width), _matrix(c["vector"], width).T)


def _positive_heaps(k: int):
    def run(a: pa.Table, c: pa.Table) -> pa.Table:
        """(anchor, score, other): the k best candidates of a tile for each anchor."""
        if not len(a) or not len(c):
            return pa.table({x: pa.array([], pa.int64()) for x in ("anchor", "score", "other")})
        c = c.sort_by("id")
        ids, anchors = c["id"].to_numpy(), a["id"].to_numpy()
        scores = _scores(a, c)
        mine, other, score = [], [], []
        taken = anchors[:, None] == ids
        for _ in range(min(k, len(ids))):  # of equal scores the first, which has the smallest id
            masked = np.where(taken, _NONE, scores)
            best = masked.argmax(axis=1)
            rows = np.flatnonzero(~taken[np.arange(len(anchors)), best])
            mine.append(anchors[rows])
            other.append(ids[best[rows]])
            score.append(scores[rows, best[rows]])
            taken[rows, best[rows]] = True
        return pa.table({"anchor": np.concatenate(mine), "score": np.concatenate(score), "other": np.concatenate(other)})

    return run


def _window_heaps(k: int, low: int, high: int):
    def run(a: pa.Table, c: pa.Table) -> pa.Table:
        """(anchor, positive, positive_score, score, other): the k best candidates of a tile in each window."""
        names = ("anchor", "positive", "positive_score", "score", "other")
        if not len(a) or not len(c):
            return pa.table({x: pa.array([], pa.int64()) for x in names})
        c = c.sort_by("id")
        ids, anchors = c["id"].to_numpy(), a["id"].to_numpy()
        scores = _scores(a, c)
        scores[a["label"].to_numpy()[:, None] == c["label"].to_numpy()] = _NONE
        # Best first, of equal ones the smallest id.
        rising = ~scores  # rises as scores fall, without overflow
        order = np.argsort(rising, axis=1, kind="stable")
        rising = np.take_along_axis(rising, order, axis=1)
        windows = a["windows"].combine_chunks()
        of = np.repeat(np.arange(len(anchors)), windows.value_lengths().to_numpy())
        flat = windows.flatten()
        positive, wanted = flat.field("other").to_numpy(), flat.field("score").to_numpy()
        found = {x: [] for x in names}
        for row, p, s in zip(of.tolist(), positive.tolist(), wanted.tolist(), strict=True):
            most, least = high * s // 100, -(-low * s // 100)
            if most < least:
                continue
            at = int(np.searchsorted(rising[row], ~most))
            picked = order[row, at : at + k]
            picked = picked[scores[row, picked] >= max(least, _NONE + 1)]
            for x, v in zip(names, (anchors[row], p, s), strict=False):
                found[x].append(np.full(len(picked), v, np.int64))
            found["score"].append(scores[row, picked])
            found["other"].append(ids[picked])
        return pa.table({x: np.concatenate(v) if v else np.zeros(0, np.int64) for x, v in found.items()})

    return run


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def _tiles(rows: DataFrame, asked: DataFrame, a_blocks: Column, c_blocks: Column, *keys: str) -> tuple:
    """asked and rows, grouped by the tiles they meet in: an anchor goes to all blocks of candidates and the other way."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), n)
    a = asked.withColumn("i", own(a_blocks)).withColumn("j", every(c_blocks))
    c = rows.withColumn("j", own(c_blocks)).withColumn("i", every(a_blocks))
    return a.groupBy(*keys, "i", "j"), c.groupBy(*keys, "i", "j")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    tile: tuple[int, int] = (ANCHORS, CANDIDATES),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (id, label, vector of integers).

    is_anchor: a condition on id and label. A positive of an anchor is one of the best other rows of its label. A
    negative has another label and a score from low to high percent of the positive's.
    """
    known = vectors.filter("id is not null and label is not null and vector is not null")
    one = known.select(F.col("id").cast("long").alias("id"), F.struct(F.col("label").cast("long").alias("label"), "vector").alias("x"))
    rows = stored(one.groupBy("id").agg(F.min("x").alias("x")).select("id", "x.*", is_anchor.alias("asked")), "vectors")
    blocks = lambda n, size: F.greatest(F.ceil(n / F.lit(size)), F.lit(1)).cast("long")
    counted = [blocks(F.count_if("asked"), tile[0]).alias("n_a"), blocks(F.count("*"), tile[1]).alias("n_c")]
    of_label = rows.groupBy("label").agg(*counted)
    dealt = stored(rows.join(of_label, "label"), "vectors")
    asked = dealt.filter("asked")
    a, c = _tiles(dealt.select("id", "label", "vector", "n_a", "n_c"), asked, F.col("n_a"), F.col("n_c"), "label")
    heaps = a.cogroup(c).applyInArrow(_positive_heaps(positives), "anchor long, score long, other long")
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "other"))
    first = heaps.withColumn("place", best("anchor")).filter(F.col("place") <= positives)
    windows = stored(first.groupBy("anchor").agg(F.collect_list(F.struct("other", "score")).alias("windows")), "windows")
    n = rows.agg(*counted).first()
    anchors = asked.select(F.col("id"), "label", "vector").join(windows.withColumnRenamed("anchor", "id"), "id")
    a, c = _tiles(rows.select("id", "label", "vector"), anchors, F.lit(n.n_a), F.lit(n.n_c))
    found = a.cogroup(c).applyInArrow(
        _window_heaps(negatives, low, high), "anchor long, positive long, positive_score long, score long, other long"
    )
    return (
        found.withColumn("rank", best("anchor", "positive"))
        .filter(F.col("rank") <= negatives)
        .select(
            F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank",
            F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
        )
    )
