"""Merkle manifest of a dataset by lag and lead windows.

Each row is a leaf, the digest of its fields. In each group the leaves stand in order; at each level every FANOUT
consecutive nodes become their digest, till one is left, the group's root. The groups' roots make the dataset's root
in the same way.

A level takes its siblings from lag and lead columns of fixed offsets, masked by the node's slot in its run and
the run's length, and the row of a run's first child hashes the parent. LEVELS levels are made in one go: the rows
of a block of FANOUT ** LEVELS nodes stay as they are, a node lives on the row of its first leaf, and a level's
offset is FANOUT to the power of the level. So a block is shuffled and sorted once for all its levels, no task holds
a group, and the next go has a FANOUT ** LEVELS-th of the rows. Rows are numbered by ranges of the order
(ordering.ranked). A leaf's proof is its siblings of all levels, which go from block to block by one join.

Defined results: a null field is a mark of its own and not equal to an empty one; a null group is a group,
and comes first; null ids come first in their group; rows with equal ids stand by their leaf, equal rows have equal
leaves and any of their places. A lone leaf is its group's root, a lone group's root is the dataset's root. A table
without rows gives none. Other columns, whatever their names, have no part in it.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brainstate.llm.common import stored
from brainstate.llm.ordering import offsets, ranked

FANOUT = 2
#: Levels that are made over one sorted block of rows.
LEVELS = 9
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts, one after the other, as lower-case hex."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field with its length in bytes, so that no two rows have the same bytes; null has a mark of its own."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row's fields in their order."""
    return digest(*map(field, fields))


def _climbed(base: DataFrame, fanout: int, levels: int) -> DataFrame:
    """base (g, pos, n, node, ...) with path, the siblings (left, right) of each row's nodes at the next levels, and
    top, the node that is reached, on the first row of each of these; block: their number. n: nodes of the group."""
    rows = base.withColumn("block", F.floor(F.col("pos") / F.lit(fanout**levels)))
    w = Window.partitionBy("g", "block").orderBy("pos")
    rows, steps = rows.withColumn("top", F.col("node")), []
    for level in range(levels):
        step = fanout**level
        index = F.floor(F.col("pos") / F.lit(step))
        slot = F.pmod(index, F.lit(fanout))
        run = F.least(F.lit(fanout), F.ceil(F.col("n") / F.lit(step)) - (index - slot))
        masked = lambda here, x: F.coalesce(F.when(here, x.over(w)), F.lit(""))
        left = [masked(slot >= j, F.lag("top", j * step)) for j in range(fanout - 1, 0, -1)]
        right = [masked(slot + j < run, F.lead("top", j * step)) for j in range(1, fanout)]
        # A group that is down to one node is left as it is.
        goes_on = (F.pmod("pos", F.lit(step)) == 0) & (F.col("n") > step)
        rows = rows.withColumn(f"pair_{level}", F.when(goes_on, F.struct(F.concat(*left).alias("left"), F.concat(*right).alias("right"))))
        parent = F.when(slot == 0, digest(F.col("top"), F.col(f"pair_{level}.right")))
        rows = rows.withColumn("top", F.when(goes_on, parent).when(F.col("n") <= step, F.col("top")))
        # A node's siblings are those of all leaves below it, which stand between it and the next node.
        steps.append(F.last(f"pair_{level}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    path = F.filter(F.array(*steps), lambda x: x.isNotNull())
    return rows.withColumn("path", path).drop(*(f"pair_{level}" for level in range(levels)))


def _needed(most: int, fanout: int, levels: int) -> int:
    """Levels that take `most` nodes to one, at most `levels`."""
    n = 0
    while n < levels and fanout**n < most:
        n += 1
    return n


def goes(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[tuple[DataFrame, int]]:
    """leaves (g, pos, n, node, ...), then (g, pos, n, node) of the nodes that each go ends with, up to one for each group; with
    each the levels that are made from it, levels of them but for the last go."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    out, now = [], leaves
    while most > 1:
        here = _needed(most, fanout, levels)
        out.append((now, here))
        size = fanout**here
        rows = _climbed(now.select("g", "pos", "n", "node"), fanout, here)
        tops = rows.filter(F.pmod("pos", F.lit(size)) == 0).select(
            "g", F.col("block").alias("pos"), F.ceil(F.col("n") / F.lit(size)).alias("n"), F.col("top").alias("node")
        )
        now, most = stored(tops, "nodes"), ceil(most / size)
    return [*out, (now, 0)]


def with_paths(made: list[tuple[DataFrame, int]], above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The leaves of goes() with path, all their siblings from below, and the columns of above (g, path, ...)."""
    up = above.withColumn("pos", F.lit(0).cast("long"))
    carried = [c for c in above.columns if c not in ("g", "path")]
    for base, levels in reversed(made[:-1]):
        rows = _climbed(base, fanout, levels)
        upper = up.select("g", F.col("pos").alias("block"), F.col("path").alias("upper_path"), *carried)
        # Both sides are dealt by group and block already.
        joined = rows.join(upper, ["g", "block"])
        up = joined.select(*base.columns, F.concat("path", "upper_path").alias("path"), *carried)
    return made[0][0].join(up.drop("pos"), "g") if len(made) == 1 else up


def _in_order(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows (g, ...) with pos, their number in their group by an order, and n, the group's rows."""
    ordered = ranked(rows, name, "g", *order)
    return (
        ordered.join(offsets(ordered, "g"), ["g", "range"])
        .withColumn("pos", F.col("before") + F.col("place") - F.col("first"))
        .drop("range", "place", "first", "before")
    )


def manifest(
    docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: Sequence[str] = FIELDS,
    tampered: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS,
) -> DataFrame:
    """(order, group, leaf, pos, n, path, subroot, root, folded_root, verified) of each row of docs.

    path: the siblings (left, right) of each level from the leaf to the root. tampered: values of fields that another
    copy of the rows has, as columns of docs; folded_root is recomputed from the leaf of that copy and the path, and verified
    tells whether it is the root.
    """
    named = lambda c: F.col(f"`{c}`")
    true = leaf([named(c) for c in fields])
    other = leaf([(tampered or {}).get(c, named(c)) for c in fields])
    # Texts of groups sort as their bytes do, and null before the empty one.
    key = F.coalesce(F.concat(F.lit("="), named(group).cast("string")), F.lit(""))
    leaves = stored(
        docs.select(named(order).alias("id"), named(group).alias("of"), key.alias("g"), true.alias("node"), other.alias("copy")), "leaves"
    )
    trees = goes(stored(_in_order(leaves, "leaves", "id", "node"), "leaves"), fanout, levels)
    roots = trees[-1][0].select(F.lit("").alias("g"), F.col("g").alias("group"), "node")
    tops = goes(stored(_in_order(roots, "roots", "group"), "roots"), fanout, levels)
    whole = tops[-1][0].select("g", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("node").alias("root"))
    groups = with_paths(tops, whole, fanout).select(F.col("group").alias("g"), "path", F.col("node").alias("subroot"), "root")
    rows = with_paths(trees, groups, fanout)
    folded = F.aggregate("path", F.col("copy"), lambda now, x: digest(x["left"], now, x["right"]))
    return rows.select(
        F.col("id").alias(order), F.col("of").alias(group), F.col("node").alias("leaf"), "pos", "n", "path", "subroot", "root",
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""))
