"""Near-duplicate texts by Order MinHash and banded alignment.

Each text has its k-mers, windows of five words labelled with their occurrence number. A sketch takes, for each of
several hash functions, the few smallest labelled k-mers and keeps them in text order, so texts
agree on an entry if they share these k-mers in the same order. Rows with equal texts are then folded into one node.
Nodes that agree on an entry form a bucket. In each bucket all are compared with a few hubs: the one whose
buckets are largest in all, which finds the text that others were copied from, and those that are
drawn, the likelier the larger their buckets are. This links most of what is similar. Then all members of a
bucket that are still in different classes are compared: small buckets by a join, large ones in blocks of
bounded size and of texts of like length, after bounds by length and by word counts that no pair at the threshold
fails. So no link between texts that share a bucket is lost, however large it is. Verified links are closed to
classes by alternating star contraction.

A pair is verified by aligning the two texts' words inside a band that is wide enough for every
alignment that reaches the threshold. The similarity of two texts is c / (m + n - c), where m and n are their
numbers of words and c is the number of equal words that the best order-keeping alignment matches. At the threshold of
0.8 about a ninth of the words may differ; with 24 entries of three five-word k-mers each, a pair that has a half of
its k-mers in common shares a bucket with a probability of 0.96, one that has two thirds of them nearly always.

Texts meet the hubs they are compared with in blocks of bounded size, in which the hub's text comes once.

Defined results: a text of fewer words than a k-mer is only equal to exact copies, as
are blank texts. Rows with a null text are each a class of their own. Repeated rows are
exact copies. The class id is the smallest doc_id of its class; null ids come last. Other columns, whatever their
names, have no part in it. A table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brainstate.llm.common import slices, stored

K = 5
SIMILARITY = 0.8
#: Entries of a sketch, and the k-mers that each holds.
ENTRIES = 24
ORDERED = 3
#: Hubs that each bucket draws besides its heaviest member.
DRAWN = 2
#: Members of a bucket that a join compares, at most, and members of one of the blocks of larger buckets, about.
JOINED = 32
BLOCK = 512
#: Words of the texts that meet a hub in one block, about.
BLOCK_WORDS = 100_000
#: Slots of the word counts that bound the similarity of two texts from above.
SLOTS = 512

_STEP = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0x100000001B3)
_LAST = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, ENTRIES + 1, dtype=np.uint64) * _STEP)


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of texts without nulls, and for each text and the end of all the number of words before it."""
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    b = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    word = ~((b - np.uint8(9) < 5) | (b == 32))
    edge = np.zeros(len(b) + 1, bool)  # a text begins or ends here
    edge[at] = True
    before, after = np.append(False, word), np.append(word, False)
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    # Words and the gaps between them in turn.
    cuts = np.column_stack([starts, ends]).ravel() if len(starts) else np.zeros(1, np.int64)
    all_of = pa.Array.from_buffers(pa.large_binary(), max(len(cuts) - 1, 0), [None, pa.py_buffer(cuts), pa.py_buffer(b)])
    coded = all_of.dictionary_encode()
    own = pa.DictionaryArray.from_arrays(pa.array(coded.indices.to_numpy()[::2]), coded.dictionary)
    return own, np.searchsorted(starts, at)


def labelled_kmers(texts: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-mers of texts with their occurrence numbers, in text order, those of a text all differ; the
    number of k-mers before each text and the end of all; and the same for the words: their hashes and numbers."""
    coded, at = words_of(texts)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    words = hashes[coded.indices.to_numpy()]
    n = np.diff(at)
    own = np.repeat(np.arange(len(texts)), np.maximum(n - k + 1, 0))
    ends = np.append(0, np.cumsum(np.maximum(n - k + 1, 0)))
    first = np.arange(ends[-1]) + (at[:-1] - ends[:-1])[own]
    h = np.zeros(ends[-1], np.uint64)
    for j in range(k):
        h = h * _PRIME + words[first + j]
    key = _mix(h + own.astype(np.uint64) * _STEP)  # equal for equal k-mers of one text
    order = np.argsort(key, kind="stable")
    s = key[order]
    again = np.append(False, s[1:] == s[:-1]) if len(s) else np.zeros(0, bool)
    starts = np.flatnonzero(~again)
    number = np.zeros(len(h), np.uint64)
    number[order] = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    return _mix(h + number * _STEP), ends, words, at


def sketches(kmers: np.ndarray, ends: np.ndarray, entries: int = ENTRIES, ordered: int = ORDERED) -> np.ndarray:
    """A hash of each entry of each text that has k-mers: its `ordered` smallest k-mers (all, if there are fewer) in
    text order; texts by rows. ends: the number of k-mers before each text and the end of all."""
    sizes = np.diff(ends)
    own = np.flatnonzero(sizes)
    starts, sizes = ends[:-1][own], sizes[own]
    out = np.empty((len(own), entries), np.int64)
    for e in range(entries if len(own) else 0):
        ranks = _mix(kmers ^ _SEEDS[e])
        places = np.full((ordered, len(own)), len(kmers))
        for t in range(ordered):
            some = np.flatnonzero(sizes > t)
            least = np.minimum.reduceat(ranks, starts)
            here = np.flatnonzero(ranks == np.repeat(least, sizes))
            # In a text without other k-mers nothing but taken places is left.
            whose = np.searchsorted(starts, here, "right") - 1
            keep = sizes[whose] > t
            places[t, some] = here[keep]
            ranks[here[keep]] = _LAST
        places.sort(axis=0)
        key = np.full(len(own), _SEEDS[e])
        for t in range(ordered):
            some = sizes > t
            key[some] = _mix(key[some] * _PRIME + kmers[places[t, some]])
        out[:, e] = key.view(np.int64)
    return out


def slot_counts(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of words by slot, a row for each text, as 16-bit integers; the largest stands for all that are larger."""
    slot = (words >> np.uint64(40)).astype(np.int64) % SLOTS + np.repeat(np.arange(len(at) - 1), np.diff(at)) * SLOTS
    counts = np.bincount(slot, minlength=SLOTS * (len(at) - 1)).reshape(-1, SLOTS)
    return np.minimum(counts, 0xFFFF).astype("<u2")


def band_matches(a: list, b: list, low: int, high: int) -> int:
    """Most equal pairs that an order-keeping alignment has with low <= j - i <= high.

    Bit j of a row is 0 where the best alignment so far gains a match at place j of b; the bits of a row come from
    the row above by one addition, for the matches inside the band.
    """
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    whole = (1 << len(b)) - 1
    band = (1 << (high - low + 1)) - 1
    row = whole
    for i, x in enumerate(a):
        matches = places.get(x)
        if matches:
            at = i + low
            matches &= band << at if at >= 0 else band >> -at
            gained = row & matches
            row = (row + gained | row - gained) & whole
    return len(b) - row.bit_count()


def similarity(a: list, b: list, least: float = SIMILARITY) -> float:
    """Similarity of two texts by their words; 0 if it can't reach least."""
    total = len(a) + len(b)
    need = int(np.ceil(least * total / (1 + least) - 1e-9))
    if not a or not b or min(len(a), len(b)) < need:
        return 0.0
    # An alignment with `need` matches skips at most len - need words of either side.
    c = band_matches(a, b, need - len(a), len(b) - need)
    return c / (total - c) if c >= need else 0.0


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 2 << 20):
        kmers, ends, words, at = labelled_kmers(batch["text"])
        flat = sketches(kmers, ends)
        offsets = np.append(0, np.cumsum(np.where(np.diff(ends) > 0, ENTRIES, 0)))
        entries = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.ravel(), pa.int64()))
        slots = pa.array(map(bytes, slot_counts(words, at)), pa.binary())
        columns = [batch["doc_id"], batch["digest"], entries, pa.array(np.diff(at), pa.int64()), slots]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "entries", "size", "slots"])


def _close(least: float):
    """Pairs (a, b) of a pair of blocks that are in different classes and may reach least."""

    def run(table: pa.Table) -> pa.Table:
        own = table["own"].to_numpy()
        node, root = (np.array(table[c].to_pylist(), object) for c in ("node", "root"))
        size = table["size"].to_numpy()
        counts = np.frombuffer(b"".join(table["slots"].to_pylist()), "<u2").reshape(-1, SLOTS)
        full = (counts == 0xFFFF).any(axis=1)
        _, root = np.unique(root, return_inverse=True)
        first, one = own.min(), own.min() == own.max()
        behind = np.flatnonzero(own != first)
        a, b = [], []
        for at, i in enumerate(np.flatnonzero(own == first).tolist()):
            others = np.arange(at + 1, len(own)) if one else behind
            need = np.ceil(least * (size[i] + size[others]) / (1 + least) - 1e-9)
            may = (root[others] != root[i]) & (np.minimum(size[i], size[others]) >= need)
            others, need = others[may], need[may]
            shared = np.minimum(counts[i], counts[others]).sum(axis=1, dtype=np.int64)
            others = others[(shared >= need) | full[i] | full[others]]
            a += [min(node[i], node[j]) for j in others.tolist()]
            b += [max(node[i], node[j]) for j in others.tolist()]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _may_reach(least: float, a: str = "size", b: str = "other_size") -> Column:
    """Whether texts of these numbers of words can be so similar."""
    return F.least(a, b) >= F.ceil((F.col(a) + F.col(b)) * (least / (1 + least)) - 1e-6)


def _unlinked(buckets: DataFrame, nodes: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of members of a bucket that have different roots and may reach least, some of them repeated."""
    # Texts that may reach least lie in one bin of sizes or in neighbouring ones: each stands in its own and the next.
    bin_of = F.floor(F.log("size") / -float(np.log(least)) + 1e-9).cast("int")
    members = stored(
        buckets.select("entry", "node", "size")
        .join(roots, "node", "left")
        .select("entry", F.explode(F.array(bin_of, bin_of + 1)).alias("bin"), "node", F.coalesce("root", "node").alias("root"), "size"),
        "members",
    )
    # The members of a bucket's largest class are only compared with the rest.
    by_root = members.groupBy("entry", "bin", "root").agg(F.count("*").alias("n"))
    mixed = stored(
        by_root.groupBy("entry", "bin")
        .agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"))
        .select("entry", "bin", F.col("main")["root"].alias("main"), F.col("main")["n"].alias("n_main"), "n")
        .filter(F.col("n") > F.col("n_main")),
        "mixed",
    )
    rows = members.join(mixed, ["entry", "bin"]).withColumn("rest", F.col("root") != F.col("main"))
    small = stored(rows.filter(F.col("n") <= JOINED).select("entry", "bin", "node", "root", "size", "rest"), "small")
    x = small.filter("rest").select(
        "entry", "bin", F.col("node").alias("other"), F.col("root").alias("other_root"), F.col("size").alias("other_size")
    )
    joined = (
        x.join(small, ["entry", "bin"])
        .filter((F.col("root") != F.col("other_root")) & _may_reach(least))
        .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    )
    # Blocks of the rest come first; each is compared with itself and all after it, the others only with these.
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    dealt = lambda n: F.pmod(F.xxhash64("node"), n.cast("long")).cast("int")
    large = (
        rows.filter(F.col("n") > JOINED)
        .join(nodes.select("node", "slots"), "node")
        .withColumn("n_r", blocks(F.col("n") - F.col("n_main")))
        .withColumn("n_m", blocks(F.col("n_main")))
        .withColumn("own", F.when(F.col("rest"), dealt(F.col("n_r"))).otherwise(F.col("n_r") + dealt(F.col("n_m"))))
        .withColumn("last", F.when(F.col("rest"), F.col("n_r") + F.col("n_m")).otherwise(F.col("n_r")) - 1)
        .select("entry", "bin", "node", "root", "size", "slots", "own", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
    )
    return joined.union(
        large.select("entry", "bin", "i", "j", "node", "root", "own", "size", "slots")
        .groupBy("entry", "bin", "i", "j")
        .applyInArrow(_close(least), "a binary, b binary")
    )


def _verified(least: float):
    """Links (a, b) of hubs and the texts that follow them in their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, words = None, []
        for batch in slices(batches, "text"):
            coded, at = words_of(batch["text"])
            codes, names = coded.indices.to_numpy(), np.array(coded.dictionary.to_pylist(), object)
            a, b = [], []
            keys = zip(batch["hub"].to_pylist(), batch["node"].to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)
            for of, node, start, end in keys:
                own = names[codes[start:end]].tolist()
                if of == node:
                    hub, words = of, own
                elif of == hub and similarity(words, own, least) > 0:
                    a.append(min(of, node))
                    b.append(max(of, node))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def _links(pairs: DataFrame, held: DataFrame, least: float, name: str) -> DataFrame:
    """(a, b) of the pairs (hub, node, size) that reach least. held: (node, text) of their texts."""
    blocks = stored(
        pairs.groupBy("hub").agg(F.ceil(F.sum("size") / F.lit(BLOCK_WORDS)).cast("long").alias("n")), "blocks"
    )
    rows = pairs.join(blocks, "hub").select("hub", F.pmod(F.xxhash64("node"), "n").alias("block"), "node")
    of_hub = blocks.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"), F.col("hub").alias("node"))
    return stored(
        rows.union(of_hub)
        .join(held.hint("merge"), "node")
        .repartition("hub", "block")
        .sortWithinPartitions("hub", "block", F.col("hub") != F.col("node"))
        .select("hub", "node", "text")
        .mapInArrow(_verified(least), "a binary, b binary"),
        name,
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the smallest node of its component.

    Alternating large-star and small-star steps; each writes its edges to the shared folder.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(df: DataFrame) -> DataFrame:
        """Large-star: link each node's larger neighbours to the smallest of it and its neighbours."""
        both = df.select("a", "b").union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")), "least")
        linked = both.filter(F.col("b") > F.col("a")).join(least, "a")
        return linked.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()

    def contract(df: DataFrame) -> DataFrame:
        """Small-star: link each node and its smaller neighbours to the smallest of them."""
        least = stored(df.groupBy("a").agg(F.min("b").alias("m")), "least")
        rest = df.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return rest.union(least.select("a", F.col("m").alias("b"))).distinct()

    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (seen := mark(now)) != before:
        before = seen
        now = stored(contract(stored(star(now), "edges")), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def node_key(doc_id: Column, text: Column) -> Column:
    """The order of the id and the digest of the text, in one key; null if the text is."""
    number = F.coalesce(doc_id.cast("long"), F.lit(2**63 - 1)).bitwiseXOR(F.lit(-(2**63)))
    return F.concat(F.unhex(F.lpad(F.hex(number), 16, "0")), F.unhex(F.md5(text)))


def _rep(node: Column) -> Column:
    """The smallest doc_id that a node's first eight bytes hold; null if it was null."""
    number = F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long")
    return F.nullif(number.bitwiseXOR(F.lit(-(2**63))), F.lit(2**63 - 1))


def _found(rows: DataFrame, least: float) -> DataFrame:
    """(digest, node, root, n_links, n_copies) of each text of rows (doc_id, text); root is null without links."""
    texts = rows.filter(F.col("text").isNotNull()).withColumn("digest", F.unhex(F.md5("text")))
    nodes = stored(
        texts.select("doc_id", "digest", "text")
        .mapInArrow(_sketched, "doc_id long, digest binary, entries array<long>, size long, slots binary")
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("rep"),
            F.count("*").alias("n_copies"),
            *[F.first(c).alias(c) for c in ("entries", "size", "slots")],
        )
        .withColumn("number", F.coalesce("rep", F.lit(2**63 - 1)).bitwiseXOR(F.lit(-(2**63))))
        .withColumn("node", F.concat(F.unhex(F.lpad(F.hex("number"), 16, "0")), "digest"))
        .drop("number", "rep"),
        "nodes",
    )
    entries = nodes.select("node", "size", F.explode("entries").alias("entry"))
    sizes = stored(entries.groupBy("entry").agg(F.count("*").alias("n")).filter(F.col("n") > 1), "sizes")
    # A text that others were copied from has the most frequent entry of its copies everywhere, a copy only
    # where it is unchanged: the member whose buckets are largest in all stands for the bucket.
    weights = stored(
        entries.join(sizes, "entry")
        .groupBy("node", "size")
        .agg(F.sum("n").alias("weight"), F.collect_list("entry").alias("entries")),
        "weights",
    )
    buckets = weights.select("node", "size", "weight", F.explode("entries").alias("entry"))
    # The row with the smallest id stands for its copies, and of repeated rows one: no other copy's text goes on.
    own = texts.select(node_key(F.col("doc_id"), F.col("text")).alias("node"), "text")
    held = stored(own.join(weights.select("node").hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "held")
    # More hubs are drawn, the heavier the likelier, for what only they are similar to. A node draws the same number in
    # all its buckets, so that it is the hub of many of them and its neighbours meet few different hubs.
    draw = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1 << 20)) * F.pow("weight", F.lit(2))
    hub = F.struct("node", "size")
    hubs = stored(
        buckets.groupBy("entry").agg(
            F.max(F.struct("weight", hub.alias("x")))["x"].alias("heaviest"),
            *[F.max(F.struct(draw(k), hub.alias("x")))["x"].alias(f"hub_{k}") for k in range(DRAWN)],
        ),
        "hubs",
    )
    pairs = stored(
        buckets.join(hubs, "entry")
        .select("node", "size", F.explode(F.array("heaviest", *[f"hub_{k}" for k in range(DRAWN)])).alias("x"))
        .select("node", "size", F.col("x")["node"].alias("hub"), F.col("x")["size"].alias("other_size"))
        .filter((F.col("node") != F.col("hub")) & _may_reach(least))
        .groupBy(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        .agg(F.min(F.struct("hub", "node", "size")).alias("x"))
        .select("a", "b", "x.*"),
        "pairs",
    )
    first = _links(pairs, held, least, "links")
    roots = stored(components(first), "roots")
    others = _unlinked(buckets, nodes, roots, least).distinct().join(pairs, ["a", "b"], "left_anti")
    again = others.join(nodes.select(F.col("node").alias("b"), "size"), "b").select(F.col("a").alias("hub"), F.col("b").alias("node"), "size")
    second = _links(stored(again, "pairs"), held, least, "links")
    # The second links join whole classes of the first ones.
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    joins = (
        second.join(root_of("a"), "a", "left")
        .join(root_of("b"), "b", "left")
        .select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    )
    joined = stored(components(joins), "roots").select(F.col("node").alias("root_1"), F.col("root").alias("root_2"))
    links = first.union(second)
    counts = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    return stored(
        nodes.select("node", "digest", "n_copies")
        .join(roots, "node", "left")
        .withColumn("root_1", F.coalesce("root", "node"))
        .join(joined, "root_1", "left")
        .join(counts, "node", "left")
        .select("digest", "node", F.coalesce("root_2", "root").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"),
        "classes",
    )


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of each row of docs (doc_id, text).

    n_links: verified links of the row's text to other texts, of all pairs that were compared; pairs that are in one
    class by the hubs' links aren't compared again, so a text may have more similar ones. n_copies: rows with equal text.
    """
    rows = _rows(docs)
    one = F.lit(1).cast("long")
    return (
        rows.filter(F.col("text").isNotNull())
        .select("doc_id", F.unhex(F.md5("text")).alias("digest"))
        .join(_found(rows, least), "digest")
        .select("doc_id", _rep(F.coalesce("root", "node")).alias("class_id"), "n_links", "n_copies")
        .unionByName(
            rows.filter(F.col("text").isNull()).select(
                "doc_id", F.col("doc_id").alias("class_id"), (one - 1).alias("n_links"), one.alias("n_copies")
            )
        )
    )


def without_copies(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Rows of docs (doc_id, text, others), one of each class: the one with the smallest id; of repeated rows one.

    Ids need not be unique: a row stands for its class by its id and its text. Rows with a null text all stay.
    """
    key = node_key(F.col("doc_id"), F.col("text"))
    heads = _found(_rows(docs), least).filter(F.coalesce("root", "node") == F.col("node")).select(F.col("node").alias("_head"))
    kept = docs.filter(F.col("text").isNotNull()).withColumn("_node", key)
    kept = kept.join(heads, F.col("_node") == F.col("_head"), "left_semi").dropDuplicates(["_node"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.filter(F.col("text").isNull()))
