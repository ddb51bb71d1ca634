"""Best-fit packing of token pieces into sequences, with certified bounds.

Texts become token ids and an end id; only documents longer than a sequence are
cut. Pieces are dealt into groups of bounded size. Each group is packed by
best-fit decreasing, and dual feasible functions (the threshold functions of
Martello and Toth's second bound and the rounding functions of Fekete and Schepers) give a lower
bound of its sequences. A group that meets its bound is certified; it gives away only its
least filled sequence. A group with a gap gives away several of its least filled ones for each sequence over
its bound. What was given away is dealt into new, fewer groups across the old ones and
packed again, as long as that saves sequences.

Only rows of a few numbers are shuffled, never texts or ids. Defined results: a null
text counts as empty and becomes one piece with the end id alone. Rows with equal or null
ids are packed one by one. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import count, filterfalse

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brainstate.llm.common import slices, stored

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: Pieces in a group, on average.
GROUP = 8192
#: Sequences that a group gives away for each one over its bound.
GIVEN = 16

_ITEM = "doc_id long, piece int, start long, length long, ids_crc32 long"
_CLOSING = ".,;:!?"
_SPACE = re.compile(r"\s")
#: Bytes of a generation of cached parts and their ids, about, and those of an entry besides its part and ids.
_CACHE = 64 << 20
_ENTRY = 150


def _white(b: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 texts are part of a white space character."""
    white = (b - np.uint8(9) < 5) | (b == 32)
    lead = np.flatnonzero((b - np.uint8(0xE1) < 3) | (b == 0xC2))
    if len(lead):
        one, two, three = b[lead], b[np.minimum(lead + 1, len(b) - 1)], b[np.minimum(lead + 2, len(b) - 1)]
        short = (one == 0xC2) & ((two == 0x85) | (two == 0xA0))
        low = (three - np.uint8(0x80) < 11) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF)
        long = (one == 0xE1) & (two == 0x9A) & (three == 0x80) | (one == 0xE3) & (two == 0x80) & (three == 0x80)
        long |= (one == 0xE2) & ((two == 0x80) & low | (two == 0x81) & (three == 0x9F))
        for k in range(3):
            white[(lead[long] if k == 2 else lead[short | long]) + k] = True
    return white


def parts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Parts of texts without nulls, and for each text and the end of all the number of parts before it.

    The pre-tokenizer never joins across a single blank or line feed between other characters, except that
    the blank belongs to what follows it: texts are cut there.
    """
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    b = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    first, last = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]] - 1
    white = _white(b)
    single = (b == 32) | (b == 10)
    single[1:] &= ~white[:-1]
    single[:-1] &= ~white[1:]
    single[first] = single[last] = False
    cut = single.copy()
    cut[1:] |= single[:-1] & (b[:-1] == 10)
    cut[first] = True
    starts = np.append(np.flatnonzero(cut), len(b))
    cut_up = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(b)])
    return cut_up, np.searchsorted(starts, at)


class Encoder:
    """Ids of texts, as the tokenizer gives them.

    Each distinct part of a slice is looked up once; two generations of a bounded cache keep the frequent parts.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.fixed = dict(zip(map(str.encode, ("\n", *_CLOSING)), self._ids(["\n", *_CLOSING]), strict=True))
        self.line_feed = np.frombuffer(self.fixed[b"\n"], "<u4")[0]
        self.new, self.old, self.size = dict(self.fixed), {}, 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _keep(self, some: list[bytes], ids: list[bytes]) -> None:
        self.new.update(zip(some, ids, strict=True))
        self.size += _ENTRY * len(some) + sum(map(len, some)) + sum(map(len, ids))

    def _learn(self, unknown: list[bytes]) -> None:
        """Encode unknown parts; a closing mark after a letter is a token of its own, so the part before it is enough."""
        marked, words = [], set()
        for x in unknown:
            if x[-1:] in self.fixed and (x[-2:-1].isalpha() or x[-2:-1] > b"\x7f" and x[:-1].decode()[-1].isalpha()):
                marked.append(x)
                x = x[:-1]
            words.add(x)
        words.difference_update(self.new)
        plain = [x for x in words if len(x.split()) == 1 and (x.isascii() or not _SPACE.search(x.decode(), x[0] == 32))]
        for at in range(0, len(plain), 200):
            some = plain[at : at + 200]
            (raw,) = self._ids([b"\n".join(some).decode()])
            cuts = np.flatnonzero(np.frombuffer(raw, "<u4") == self.line_feed) * 4
            if len(cuts) == len(some) - 1:
                self._keep(some, [raw[a:b] for a, b in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)], strict=True)])
            else:
                self._keep(some, self._ids([x.decode() for x in some]))
        others = list(words.difference(plain))
        self._keep(others, self._ids([x.decode() for x in others]))
        self._keep(marked, [self.new[x[:-1]] + self.fixed[x[-1:]] for x in marked])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids before each text and the end of all."""
        cut, at = parts(texts)
        coded = cut.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self.size > _CACHE:
            self.old, self.new, self.size = self.new, dict(self.fixed), 0
        unknown = list(filterfalse(self.new.__contains__, distinct))
        if self.old:
            known = [x for x in unknown if x in self.old]
            self._keep(known, [self.old[x] for x in known])
            unknown = list(filterfalse(self.new.__contains__, unknown))
        if unknown:
            self._learn(unknown)
        ids = pa.array(map(self.new.__getitem__, distinct), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
        return np.frombuffer(ids.buffers()[2] or b"", "<u4"), ends[at] // 4


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs (doc_id, text)."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            ids, at = encode(batch["text"].fill_null(""))
            for doc_id, a, b in zip(batch["doc_id"].to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                n = b - a + 1
                start, size = 0, (n - 1) % capacity + 1
                for k in range((n + capacity - 1) // capacity):
                    crc = zlib.crc32(ids[a + start : min(a + start + size, b)])
                    if start + size == n:
                        crc = zlib.crc32(end, crc)
                    rows.append((doc_id, k, start, size, crc))
                    start, size = start + size, capacity
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ITEM)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that pieces of these lengths need at least, by dual feasible functions."""
    counts = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    sizes = np.arange(capacity + 1)
    best = -(-int((counts * sizes).sum()) // capacity)
    n_from = counts[::-1].cumsum()[::-1]  # pieces of at least this length
    mass = np.append(0, (counts * sizes).cumsum())  # mass[x]: of pieces shorter than x
    for t in range(1, capacity // 2 + 1):
        # Lengths over capacity - t count as a whole sequence, those under t as nothing.
        large = int(n_from[capacity - t + 1])
        best = max(best, large - (-int(mass[capacity - t + 1] - mass[t]) // capacity))
    for k in range(1, 21):
        # Length x counts as floor((k + 1) x) / k, or as x where (k + 1) x is whole.
        scaled = (k + 1) * sizes
        units = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * units).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Sequence of each piece, packed by best-fit decreasing."""
    out = np.empty(len(lengths), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled, used = 0, 0  # bit r of filled: some sequence has r places left
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = filled >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            place = open_at[left].pop()
            if not open_at[left]:
                filled &= ~(1 << left)
        else:
            left, place, used = capacity, used, used + 1
        out[i] = place
        if left - size:
            open_at[left - size].append(place)
            filled |= 1 << (left - size)
    return out


def _packed(capacity: int, given: int, round_no: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True])
        lengths = rows["length"].to_numpy()
        place = best_fit(lengths, capacity)
        used = int(place.max()) + 1
        fill = np.bincount(place, weights=lengths, minlength=used)
        gap = used - lower_bound(lengths, capacity)
        away = np.argsort(fill, kind="stable")[: 1 + given * gap]
        away = away[fill[away] < capacity]
        order = np.argsort(place, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.append(True, np.diff(place[order]) > 0)
        offset = np.empty(len(rows), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(rows))))
        group = int(rows["part"].iloc[0])
        return rows.assign(
            sequence_id=(round_no << 54) | (group << 24) | place, offset=offset, away=np.isin(place, away)
        )[["row", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "away"]]

    return run


def _dealt(items: DataFrame, n: int, group: int, round_no: int, capacity: int) -> DataFrame:
    parts = max(1, -(-n // group))
    part = F.pmod(F.xxhash64("row", F.lit(round_no)), F.lit(parts))
    return stored(
        items.withColumn("part", part)
        .groupBy("part")
        .applyInPandas(
            _packed(capacity, GIVEN, round_no), f"row long, {_ITEM}, sequence_id long, offset long, away boolean"
        ),
        "packed",
    )


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """items (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    items = stored(items.select(*columns).withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = items.filter(F.col("length") >= capacity)
    done = [
        whole.select(
            *columns,
            (F.col("row") + F.lit(1 << 62)).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        )
    ]
    rest = items.filter(F.col("length") < capacity)
    now = _dealt(rest, rest.count(), group, 1, capacity)
    for round_no in count(2):  # each round saves a sequence at least
        away = now.filter("away")
        n, before = away.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        if before < 2:
            break
        again = _dealt(away.select("row", *columns), n, group, round_no, capacity)
        if again.agg(F.count_distinct("sequence_id")).first()[0] >= before:
            break
        done.append(now.filter("not away").select(*columns, "sequence_id", "offset"))
        now = again
    out = now.select(*columns, "sequence_id", "offset")
    for df in done:
        out = out.unionByName(df)
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces of docs (doc_id, text) and their places in sequences."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    return pack(pieces(docs, path))
