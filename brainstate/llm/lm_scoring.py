"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

A token is a word in lower case (A to Z only) or the end of a text; the end also stands
before a text's first token. The model mixes maximum-likelihood estimates,

    P(w | v) = a[b] c(v, w) / c(v) + u[b] c(w) / N + z[b] / (V + 1),

with weights for each bucket b of the context's count, doubling in width. The weights
are learned by expectation-maximisation: one fold of the training texts is held out, the
estimates come from the other folds, and each held-out token enters by the ratios of its
three estimates, kept on a grid of eighths of an octave. The grid's size depends on
the range of the counts and not on the corpus, so only it is sent to the driver, and each
EM step runs over it. Scores then use the counts of all training folds.

Texts become blocks of bounded size, stored once as word numbers. Each block asks for the
counts of its distinct n-grams, in sorted runs of hashes that are dealt by range, so a
frequent n-gram is one entry for each block, however often it occurs. Each range sums
the blocks' own counts and answers in the order that was asked; nothing but
runs of numbers is shuffled, and no table of n-grams is broadcast.

Blocks and ranges both grow with the corpus, so they meet in a tree: at most FAN blocks, about, are
merged into a run of blocks, range by range, and each range of a run is cut again, into FAN ranges at
most, before it meets the same range of other runs. What the last level knows is handed down again,
level by level. A block has FAN rows a level for each order at most, beyond one level; one level is enough
for FAN blocks (32 GB of text) and two for their square.

Defined results: a null text counts as empty and has the end token alone. Rows with
equal or null ids are scored one by one; a null id counts as the empty text in crc32. With
no training text every estimate is uniform.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brainstate.llm.common import slices, stored

FOLDS = 5
#: The fold that is never learned from, and the training fold that the weights are learned on.
EVALUATED = 1
HELD = 4
#: Bytes of text in a block, about, and n-grams in a range, about.
BLOCK_BYTES = 8 << 20
RANGE = 1_500_000
#: Blocks that are merged at once, about, and ranges of a level of the tree.
FAN = 4096
#: Blocks or ranges in a task, about.
A_TASK = 8
#: Steps of the grid in an octave, and steps of expectation-maximisation.
GRID = 8
STEPS = 100

_CACHE = 500_000
_BLOCK = (
    "block long, doc_ids array<long>, folds binary, sizes binary, tokens binary, words binary, n_tokens long"
)
_ASKED = "order int, part long, block long, keys binary, kept binary, held binary"
_ANSWERED = "order int, part long, block long, kept binary, all binary, n_kept long, n_all long, v_all long"
_SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()
_END = np.uint64(xxhash.xxh64_intdigest(b""))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pack(values: np.ndarray) -> bytes:
    """Numbers of at least 0 as the narrowest unsigned type, whose width is the first byte."""
    top = int(values.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def _pack_sorted(keys: np.ndarray) -> bytes:
    """Rising numbers as steps of as many bytes as the largest needs."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack_sorted(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    wide = np.zeros((len(steps), 8), np.uint8)
    wide[:, : data[0]] = steps
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def fold_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def tokens_of(text: str | None) -> list[bytes]:
    """The words of a text; bytes lower and split as the rule says, as they know ASCII alone."""
    return (text or "").encode().lower().split()


def _blocked(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def made() -> pa.RecordBatch:
            nonlocal number, held
            sizes = np.array([len(p) for p in parts])
            words, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")  # frequent words get small numbers
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            planes = rank[inverse].astype("<u4").view(np.uint8).reshape(-1, 4).T.copy()
            row = {
                "block": [number],
                "doc_ids": pa.array([ids[:]], pa.list_(pa.int64())),
                "folds": [bytes(map(fold_of, ids))],
                "sizes": [_pack(sizes)],
                "tokens": [zstandard.compress(planes.tobytes(), 3)],
                "words": [words[order].astype("<u8").tobytes()],
                "n_tokens": [int(sizes.sum())],
            }
            ids.clear()
            parts.clear()
            number, held = number + 1, 0
            return pa.RecordBatch.from_pydict(row)

        for batch in slices(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = tokens_of(text)
                own = np.empty(len(words) + 1, np.uint64)
                own[:-1] = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
                own[-1] = _END
                ids.append(doc_id)
                parts.append(own)
                held += len(text or "") + 1
                if held >= block_bytes:
                    yield made()
        if ids:
            yield made()

    return run


class Block:
    """A stored block: word numbers, the documents they are of, and its distinct n-grams in sorted order."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.folds = np.frombuffer(row["folds"], np.uint8)
        self.sizes = _unpack(row["sizes"]).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        planes = np.frombuffer(zstandard.decompress(row["tokens"]), np.uint8).reshape(4, -1)
        self.tokens = planes.T.copy().view("<u4").ravel().astype(np.int64)
        self.words = np.frombuffer(row["words"], "<u8")
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.starts] = self.tokens[self.starts + self.sizes - 1]  # the end token
        single = _mix(self.words ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        pair = _mix(self.words[self.before] * np.uint64(0x9E3779B97F4A7C15) + self.words[self.tokens])
        self.word_order = np.argsort(single, kind="stable")
        self.single = single[self.word_order]
        self.pair, self.pair_of = np.unique(pair, return_inverse=True)

    def own_counts(self, fold_mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the distinct words and pairs in the documents of the mask."""
        chosen = np.repeat(fold_mask, self.sizes)
        words = np.bincount(self.tokens[chosen], minlength=len(self.words))[self.word_order]
        return words, np.bincount(self.pair_of[chosen], minlength=len(self.pair))

    def spread(self, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: the counts of its context, itself and the pair."""
        by_word = np.empty(len(self.words), np.int64)
        by_word[self.word_order] = words
        return by_word[self.before], by_word[self.tokens], pairs[self.pair_of]


def _cut(order: int, block: int, parts: range, whole: int, keys: np.ndarray, kept: np.ndarray, held: np.ndarray) -> list[tuple]:
    """Rows of _ASKED: a sorted run of n-grams, cut at the borders of some of all the ranges."""
    borders = np.array([(i << 64) // whole for i in parts[1:]], np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(keys, borders), [len(keys)]])
    rows = []
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        at = slice(cuts[i], cuts[i + 1])
        rows.append((order, parts[i], block, _pack_sorted(keys[at]), _pack(kept[at]), _pack(held[at])))
    return rows


def _arrays(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = [pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)]
    return pa.Table.from_arrays(columns, [name for name, _ in fields])


def _asking(parts: int):
    """Rows of _ASKED: the block's n-grams by ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block(row)
                kept = block.own_counts(~np.isin(block.folds, (EVALUATED, HELD)))
                held = block.own_counts(block.folds == HELD)
                for order, keys in ((1, block.single), (2, block.pair)):
                    rows = _cut(order, row["block"], range(parts), parts, keys, kept[order - 1], held[order - 1])
                    yield from _arrays(rows, _ASKED).to_batches()

    return run


def _merged(rows: list[dict]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct n-grams of some rows of _ASKED, and for each row the places of its own among them."""
    runs = [_unpack_sorted(r["keys"]) for r in rows]
    keys, inverse = np.unique(np.concatenate(runs), return_inverse=True)
    return keys, np.split(inverse, np.cumsum([len(r) for r in runs])[:-1])


def _sums(rows: list[dict], places: list[np.ndarray], column: str, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for r, own in zip(rows, places, strict=True):
        out[own] += _unpack(r[column]).astype(np.int64)  # a row's n-grams are distinct
    return out


def _merging(whole: int, cut: int):
    """For a range of a run of blocks: the run's own rows of _ASKED, as if it were one block, this range cut again."""

    def run(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        keys, places = _merged(rows)
        kept, held = (_sums(rows, places, c, len(keys)) for c in ("kept", "held"))
        part = rows[0]["part"]
        parts = range(part * cut, (part + 1) * cut)
        return _arrays(_cut(rows[0]["order"], rows[0]["run"], parts, whole * cut, keys, kept, held), _ASKED)

    return run


def _answer(asked: pa.Table) -> pa.Table:
    """For one range: the sums over all blocks, to each block in the order of its run."""
    rows = asked.to_pylist()
    keys, places = _merged(rows)
    kept, held = (_sums(rows, places, c, len(keys)) for c in ("kept", "held"))
    every = kept + held
    # The sums of the range are told once, in its first row.
    sums = int(kept.sum()), int(every.sum()), int((every > 0).sum())
    out = [
        (r["order"], r["part"], r["block"], _pack(kept[own]), _pack(every[own]), *(sums if i == 0 else (0, 0, 0)))
        for i, (r, own) in enumerate(zip(rows, places, strict=True))
    ]
    return _arrays(out, _ANSWERED)


def _handing_down(key, asked: pa.Table, answers: pa.Table) -> pa.Table:
    """For a range of a run of blocks: what the run was answered, to each of its blocks in the order of its own."""
    rows = asked.to_pylist()
    _, places = _merged(rows)
    told = answers.sort_by("part").to_pylist()
    kept, every = (np.concatenate([_unpack(r[c]).astype(np.int64) for r in told]) for c in ("kept", "all"))
    out = [(r["order"], r["part"], r["block"], _pack(kept[own]), _pack(every[own]), 0, 0, 0) for r, own in zip(rows, places, strict=True)]
    return _arrays(out, _ANSWERED)


def answered(blocks: DataFrame, n_blocks: int, n_tokens: int, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Rows of _ANSWERED for all blocks, and those of the last level, which alone tell the sums."""
    least = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = max(least, -(-2 * n_tokens // RANGE))
    parts = min(fan, needed) if n_blocks > fan else needed
    levels: list[tuple[DataFrame, int, int]] = []
    asked, whole, runs = blocks.mapInArrow(_asking(parts), _ASKED), parts, n_blocks
    while runs > fan:
        runs = -(-runs // fan)
        # Blocks have any numbers, runs those from 0; each level deals them anew.
        asked = asked.withColumn("run", F.pmod(F.xxhash64("block"), F.lit(runs)))
        tasks = max(least, whole * runs // A_TASK)
        dealt = asked.repartition(tasks, "order", "part", "run")
        cut = max(1, min(fan, -(-needed // whole)))
        levels.append((dealt, tasks, cut))
        asked = stored(dealt.groupBy("order", "part", "run").applyInArrow(_merging(whole, cut), _ASKED), "asked")
        whole *= cut
    last = stored(
        asked.repartition(max(least, whole // A_TASK), "order", "part").groupBy("order", "part").applyInArrow(_answer, _ANSWERED), "answers"
    )
    answers = last
    for dealt, tasks, cut in reversed(levels):
        told = answers.withColumn("run", F.col("block")).withColumn("range", F.floor(F.col("part") / cut).cast("long"))
        told = told.repartition(tasks, "order", "range", "run").groupBy("order", "range", "run")
        answers = dealt.groupBy("order", "part", "run").cogroup(told).applyInArrow(_handing_down, _ANSWERED)
    return (stored(answers, "answers") if levels else last), last


def _told(answers: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The counts of a block's words and pairs, put together from the answers of the ranges."""
    rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("order", "part", column)), strict=True))
    none = np.empty(0, np.int64)
    return tuple(
        np.concatenate([none, *(_unpack(data).astype(np.int64) for o, _, data in rows if o == order)])
        for order in (1, 2)
    )


def bucket(context: np.ndarray) -> np.ndarray:
    """Number of the context's bucket: 0 for unseen contexts, then one for each doubling of the count."""
    return np.frexp(context.astype(float))[1] * (context > 0)


def _estimates(context, word, pair, n: int, v: int):
    return pair / np.maximum(context, 1), word / max(n, 1), 1.0 / (v + 1)


def _events(n: int, v: int):
    """(bucket, pair, word, n) of the held-out tokens: logs of the ratios to the uniform estimate on the grid."""

    def run(key, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(blocks.to_pylist()[0])
        context, word, pair = block.spread(*_told(answers, "kept"))
        chosen = np.repeat(block.folds == HELD, block.sizes)
        context, word, pair = context[chosen], word[chosen], pair[chosen]
        a, u, z = _estimates(context, word, pair, n, v)
        with np.errstate(divide="ignore"):
            logs = [np.where(p > 0, np.round(GRID * np.log2(p / z)), -9999).astype(np.int64) for p in (a, u)]
        cells, counts = np.unique(np.stack([bucket(context), *logs]), axis=1, return_counts=True)
        return pa.table({"bucket": cells[0].astype(np.int64), "pair": cells[1], "word": cells[2], "n": counts})

    return run


def learned_weights(cells: np.ndarray) -> dict[int, tuple[float, float, float]]:
    """Weights of pair, word and uniform estimate for each bucket, from cells (bucket, pair, word, n)."""
    out = {}
    for b in np.unique(cells[:, 0]).tolist():
        own = cells[cells[:, 0] == b]
        ratios = np.where(own[:, 1:3] <= -9999, 0.0, 2.0 ** (own[:, 1:3] / GRID))
        p = np.column_stack([ratios, np.ones(len(own))])
        n = own[:, 3].astype(float)
        weights = np.array([0.6, 0.3, 0.1]) if b else np.array([0.0, 0.9, 0.1])
        for _ in range(STEPS):
            share = weights * p
            weights = (n[:, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0)
            weights = weights / weights.sum()
        # The uniform estimate keeps a little, so that no token is impossible.
        weights = np.maximum(weights, [0.0, 0.0, 1e-6])
        out[int(b)] = tuple((weights / weights.sum()).tolist())
    return out


def _scoring(n: int, v: int, weights: dict[int, tuple[float, float, float]]):
    seen = sorted(b for b in weights if b)
    rows = np.zeros((64, 3))
    for b in range(64):  # a bucket without held-out tokens takes the weights of the nearest
        near = min(seen, key=lambda x: abs(x - b)) if seen and b else 0
        rows[b] = weights.get(b, weights.get(near, (0.0, 0.9, 0.1) if b == 0 else (0.6, 0.3, 0.1)))

    def run(key, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(blocks.to_pylist()[0])
        context, word, pair = block.spread(*_told(answers, "all"))
        a, u, z = _estimates(context, word, pair, n, v)
        w = rows[bucket(context)]
        unit = w[:, 0] * (context > 0) + w[:, 1] * (n > 0) + w[:, 2]
        logs = np.log10((w[:, 0] * a + w[:, 1] * u + w[:, 2] * z) / unit)
        base = np.log10((word + 0.5) / (n + 0.5 * (v + 1)))
        known = (word > 0).astype(np.int64)
        return pa.table(
            {
                "doc_id": pa.array(block.doc_ids, pa.int64()),
                "held_out": block.folds == EVALUATED,
                "n_tokens": block.sizes,
                "n_known": np.add.reduceat(known, block.starts),
                "train_tokens": np.full(len(block.sizes), n, np.int64),
                "base_score": np.add.reduceat(base, block.starts),
                "score": np.add.reduceat(logs, block.starts),
            }
        )

    return run


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """Scores of docs (doc_id, text) by a model of those outside the evaluated fold."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = stored(rows.mapInArrow(_blocked(block_bytes), _BLOCK), "blocks")
    n_blocks, total = blocks.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    answers, last = answered(blocks, n_blocks, total, fan)
    n_kept, n, v = last.filter("order = 1").agg(F.sum("n_kept"), F.sum("n_all"), F.sum("v_all")).first()
    n_kept, n, v = n_kept or 0, n or 0, v or 0
    tasks = max(least, n_blocks // A_TASK)
    both = lambda column: blocks.repartition(tasks, "block").groupBy("block").cogroup(
        answers.select("block", "order", "part", column).repartition(tasks, "block").groupBy("block")
    )
    cells = (
        both("kept")
        .applyInArrow(_events(n_kept, v), "bucket long, pair long, word long, n long")
        .groupBy("bucket", "pair", "word")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    weights = learned_weights(np.array(cells, np.int64).reshape(-1, 4))
    return both("all").applyInArrow(_scoring(n, v, weights), _SCORED)
