"""N-best segmentation of texts into the pieces of a SentencePiece vocabulary, and decoding.

A segment is cut before each blank that follows another character, and around line feeds. No
piece of the vocabulary goes across such a cut (checked when it is loaded), so the lattice of a
text is the chain of its segments' lattices. In a segment, a forward Viterbi pass gives the
best score of each prefix, which is the exact heuristic for an A-star search backward from
its end: every path that it completes is the next best one. The n best of a text come
from its segments with the least loss, merged exactly.

A piece scores -log(2 + rank), a Zipf estimate of its log probability from its place
in the vocabulary. Characters that no piece has are spelled in bytes, each scoring
less than any piece.

Texts are cut up in Arrow, and each distinct segment of a slice is looked up once. New segments share
one forward and one backward pass in numpy over the edges that a trie of the pieces gives; long ones have passes of
their own. The backward pass tells what a segment's second segmentation loses, so only the few segments of a
text that lose least are searched.

Everything is a projection of each row. Defined results: a null text counts as empty and
has no pieces and the score 0. A text that holds the vocabulary's own blank mark decodes
to a blank there. Of segmentations with equal scores, the best one is that whose last pieces are longest, and the
others come in any order. A long text without blanks is one segment, in memory as large as its edges.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections.abc import Iterator
from itertools import filterfalse, repeat
from operator import itemgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brainstate.llm.common import slices

MODEL = "piece_bpe_32k.model"
N_BEST = 4
BLANK = "▁"
#: Bytes of a generation of cached segments, about, and those of an entry besides its segment and ids.
_CACHE = 64 << 20
_ENTRY = 300
#: Longest segment that shares its passes with others, segments in one such pass, and rows of a batch that goes out.
_SHORT = 64
_SHARED = 4096
_ROWS = 256
_total, _loss, _ids = itemgetter(1), itemgetter(0), itemgetter(1)


class _Known(dict):
    """A cache bounded in bytes; two generations keep what is frequent. size: bytes of the ids in values."""

    def __init__(self, size):
        super().__init__()
        self.of, self.size, self.older = size, 0, {}

    def keep(self, keys: list, values: list) -> None:
        self.update(zip(keys, values, strict=True))
        self.size += _ENTRY * len(keys) + sum(map(len, keys)) + self.of(values)

    def lack(self, keys: list) -> list:
        """Those of keys that neither generation has; what the older one has comes into the newer one."""
        if self.size > _CACHE:
            self.older, self.size = dict(self), 0
            self.clear()
        missing = list(filterfalse(self.__contains__, keys))
        old = [x for x in missing if x in self.older]
        self.keep(old, list(map(self.older.__getitem__, old)))
        return list(filterfalse(self.__contains__, missing)) if old else missing


def segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Segments of texts without nulls, and for each text and the end of all the number of segments before it.

    A blank is set before each text that isn't empty, and the vocabulary's own blank marks become blanks.
    """
    texts = texts.cast(pa.large_string())
    blank, nothing = pa.scalar(" ", texts.type), pa.scalar("", texts.type)
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), nothing, pc.binary_join_element_wise(blank, texts, nothing))
    texts = pc.replace_substring(texts, BLANK, " ")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    b = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    before = np.append(np.uint8(0), b[:-1])[: len(b)]
    blank, feed = b == 32, b == 10
    cut = blank & (before != 32) | feed & (before != 10) | ~blank & ~feed & (before == 10)
    cut[at[:-1][at[:-1] < at[1:]]] = True
    starts = np.append(np.flatnonzero(cut), len(b))
    cut_up = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(b)])
    return cut_up, np.searchsorted(starts, at)


class Vocabulary:
    """Pieces with their scores, the n best segmentations of texts, and the way back to text."""

    def __init__(self, path: str, n_best: int = N_BEST):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.n_best = n_best
        self.scores = {names[i]: ((i,), -math.log(2 + rank)) for rank, i in enumerate(plain)}
        crossing = [p for p in self.scores if BLANK in p.lstrip(BLANK) or "\n" in p]
        if crossing:
            raise ValueError(f"pieces go across a cut: {crossing[:5]}")
        self.longest = max(map(len, self.scores))
        self.bytes = [0] * 256
        for i in range(size):
            if model.is_byte(i):
                self.bytes[int(names[i][3:5], 16)] = i
        self.byte_score = -math.log(2 + size) - 1.0
        spelled = [b""] * size
        for i in plain:
            spelled[i] = names[i].replace(BLANK, " ").encode()
        for value, i in enumerate(self.bytes):
            spelled[i] = bytes([value])
        self.spelled = pa.array(spelled, pa.large_binary())
        self.prefixes: dict[str, tuple] = {p[:k]: () for p in self.scores for k in range(1, len(p))} | self.scores
        self._plant()
        self.known = _Known(lambda entries: sum(map(len, map(_ids, entries))))
        self.losses = _Known(lambda entries: sum(100 + len(ids) for found in entries for _, ids in found))

    def _plant(self) -> None:
        """The trie of the pieces: keys (node and next character) in order, the nodes they lead to, and their pieces."""
        node = {"": 0} | {p: i for i, p in enumerate(sorted(self.prefixes), 1)}
        keys = np.array([node[p[:-1]] << 21 | ord(p[-1]) for p in self.prefixes], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array([node[p] for p in self.prefixes], np.int32)[order]
        self.first = np.zeros(0x110000, np.int32)  # the node of each first character; 0: no piece begins so
        at_root = self.keys < 1 << 21
        self.first[self.keys[at_root]] = self.to[at_root]
        self.piece_of = np.full(len(node), -1, np.int32)
        self.piece_of[[node[p] for p in self.scores]] = np.arange(len(self.scores))
        self.piece_score = np.array([score for _, score in self.scores.values()])
        self.piece_ids = pa.array([np.array(ids, "<u4").tobytes() for ids, _ in self.scores.values()], pa.large_binary())

    def _lattice(self, segment: str) -> tuple[list[list[tuple]], list[float]]:
        """For each place, its edges (start, best score through the edge, ids), and its best score."""
        get, longest, n = self.prefixes.get, self.longest, len(segment)
        edges: list[list[tuple]] = [[] for _ in range(n + 1)]
        forward = [0.0, *[-math.inf] * n]
        for start in range(n):
            base = forward[start]
            for end in range(start + 1, min(n, start + longest) + 1):
                found = get(segment[start:end])
                if found is None:
                    break  # no piece begins like this
                if found:
                    total = base + found[1]
                    edges[end].append((start, total, found[0]))
                    if total > forward[end]:
                        forward[end] = total
            if segment[start] not in self.scores:
                raw = segment[start].encode()
                total = base + self.byte_score * len(raw)
                edges[start + 1].append((start, total, tuple(self.bytes[b] for b in raw)))
                forward[start + 1] = max(total, forward[start + 1])
        return edges, forward

    def segmentations(self, segment: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """Score and ids of the n best segmentations, best first."""
        edges, forward = self._lattice(segment)
        out: list[tuple[float, tuple[int, ...]]] = []
        # Open paths (what the best path through here loses, order, place, ids behind), the best first.
        # As the forward scores are exact, each stands for a whole path: no more are kept than are still wanted.
        queue: list[tuple] = [(0.0, 0, len(segment), None)]
        order = 0
        while queue:
            lost, _, place, ids = queue.pop(0)
            if place == 0:
                path: list[int] = []
                while ids is not None:
                    path += ids[0]
                    ids = ids[1]
                out.append((forward[-1] - lost, tuple(path)))
                continue
            wanted, best = n - len(out), forward[place]
            for start, score, own in edges[place]:
                loss = lost + best - score
                if len(queue) < wanted or loss < queue[-1][0]:
                    order += 1
                    insort(queue, (loss, order, start, (own, ids)))
                    del queue[wanted:]
        return out

    def entry(self, segment: str) -> tuple[float, bytes, float]:
        """Best score, best ids as bytes, and what the second segmentation loses, of one segment."""
        edges, forward = self._lattice(segment)
        n = len(segment)
        came, ids, place = [-1] * (n + 1), [], n  # came[end]: where the best path's edge to end starts
        while place:
            start, _, own = max(edges[place], key=_total)
            came[place] = start
            ids.append(own)
            place = start
        # Any other path has an edge that the best one hasn't: the best path through such an edge is the second.
        best, second = forward[n], math.inf
        behind = [-math.inf] * n + [0.0]
        for end in range(n, 0, -1):
            after, here = behind[end], came[end]
            for start, total, _ in edges[end]:
                through = total + after
                if best - through < second and start != here:
                    second = best - through
                if through - forward[start] > behind[start]:
                    behind[start] = through - forward[start]
        flat = [i for own in reversed(ids) for i in own]
        return best, np.array(flat, "<u4").tobytes(), max(second, 0.0)

    def _edges(self, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, end, piece) of all edges of segments; chars: of all, ends: of its segment for each. Pieces from
        len(scores) on stand for the characters that are spelled in bytes, by their place in the last result."""
        at, node = np.arange(len(chars)), self.first[chars]
        spelled = np.flatnonzero(self.piece_of[node] < 0)
        others, own = np.unique(chars[spelled], return_inverse=True)
        found = [(spelled, spelled + 1, len(self.scores) + own)]
        at, node = at[node > 0], node[node > 0]
        depth = 1
        while len(at):
            piece = self.piece_of[node]
            ok = piece >= 0
            found.append((at[ok], at[ok] + depth, piece[ok]))
            ok = at + depth < ends[at]
            at, node = at[ok], node[ok]
            key = node.astype(np.int64) << 21 | chars[at + depth]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[place] == key
            at, node = at[ok], self.to[place[ok]]
            depth += 1
        return *map(np.concatenate, zip(*found, strict=True)), others

    def entries(self, some: list[str]) -> list[tuple[float, bytes, float]]:
        """What `entry` gives, of many short segments at once."""
        chars = np.frombuffer("".join(some).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, some), np.int64, len(some))
        ends = np.cumsum(sizes)
        segment = np.repeat(np.arange(len(some)), sizes)
        start, end, piece, others = self._edges(chars, ends[segment])
        raw = [chr(c).encode() for c in others.tolist()]
        score = np.append(self.piece_score, [self.byte_score * len(x) for x in raw])[piece]
        ids = pa.array([np.array([self.bytes[v] for v in x], "<u4").tobytes() for x in raw], pa.large_binary())
        # Each segment has one place more than characters.
        own = segment[start]
        end_place, local = end + own, end - (ends - sizes)[own]
        start_place = start + own
        order = np.argsort(local.astype(np.uint8), kind="stable")
        steps = np.searchsorted(local[order], np.arange(1, _SHORT + 2))
        start_place, end_place, score, own, piece = (x[order] for x in (start_place, end_place, score, own, piece))
        begin = ends - sizes + np.arange(len(some))
        forward = np.full(len(chars) + len(some), -np.inf)
        forward[begin] = 0.0
        behind = np.full(len(forward), -np.inf)
        behind[ends + np.arange(len(some))] = 0.0
        spans = [slice(a, b) for a, b in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True) if a < b]
        total = np.empty(len(score))
        for x in spans:
            total[x] = forward[start_place[x]] + score[x]
            np.maximum.at(forward, end_place[x], total[x])
        for x in reversed(spans):
            np.maximum.at(behind, start_place[x], score[x] + behind[end_place[x]])
        # The best path comes from the first of the best starts.
        top = total == forward[end_place]
        came = np.full(len(forward), len(forward))
        np.minimum.at(came, end_place[top], start_place[top])
        on_path = np.zeros(len(forward), bool)
        place, stop = ends + np.arange(len(some)), begin
        while len(place):
            on_path[place] = True
            place = came[place]
            open_yet = place > stop
            place, stop = place[open_yet], stop[open_yet]
        top &= on_path[end_place] & (came[end_place] == start_place)
        best = forward[ends + np.arange(len(some))]
        second = np.full(len(some), np.inf)
        rest = ~top
        np.minimum.at(second, own[rest], best[own[rest]] - (total[rest] + behind[end_place[rest]]))
        chosen = np.flatnonzero(top)
        chosen = chosen[np.argsort(start_place[chosen])]
        flat = pa.concat_arrays([self.piece_ids, ids]).take(pa.array(piece[chosen]))
        at = np.frombuffer(flat.buffers()[1], np.int64)[np.append(0, np.cumsum(np.bincount(own[chosen], minlength=len(some))))]
        data = flat.buffers()[2].to_pybytes()
        found = [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return list(zip(best.tolist(), found, np.maximum(second, 0.0).tolist(), strict=True))

    def _learn(self, unknown: list[bytes]) -> None:
        names = [x.decode().replace(" ", BLANK) for x in unknown]
        long = [i for i, x in enumerate(names) if len(x) > _SHORT]
        self.known.keep([unknown[i] for i in long], [self.entry(names[i]) for i in long])
        short = [i for i, x in enumerate(names) if len(x) <= _SHORT]
        for k in range(0, len(short), _SHARED):
            some = short[k : k + _SHARED]
            self.known.keep([unknown[i] for i in some], self.entries([names[i] for i in some]))

    def _losses(self, segment: bytes) -> list[tuple[float, bytes]]:
        """What each of the n best segmentations loses, and its ids as bytes; the first is the best one that is known."""
        found = self.segmentations(segment.decode().replace(" ", BLANK), self.n_best)
        best = self.known[segment][1]
        own = [(found[0][0] - score, np.array(ids, "<u4").tobytes()) for score, ids in found]
        # Of segmentations with equal scores, another one may come first here.
        return [(0.0, best), *(x for x in own if x[1] != best)][: self.n_best]

    def n_encode_all(self, texts: pa.Array) -> list[tuple[list[bytes], list[float]]]:
        """Ids and scores of the n best segmentations of each text, best first."""
        cut, at = segments(texts)
        coded = cut.dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self._learn(self.known.lack(distinct))
        scores, ids, second = zip(*map(self.known.__getitem__, distinct), strict=True) if distinct else ((), (), ())
        score_of, second_of = np.array(scores)[codes], np.array(second)[codes]
        flat = pa.array(ids, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
        data = flat.buffers()[2].to_pybytes() if len(flat) else b""
        full = np.flatnonzero(at[:-1] < at[1:])
        best = np.zeros(len(texts))
        best[full] = np.add.reduceat(score_of, at[:-1][full]) if len(full) else 0.0
        # Only the n - 1 segments whose second best loses least can differ in one of the n best.
        text_of = np.repeat(np.arange(len(texts)), np.diff(at))
        least: list[list[int]] = [[] for _ in range(len(texts))]
        for _ in range(self.n_best - 1 if len(full) else 0):
            lowest = np.full(len(texts), np.inf)
            lowest[full] = np.minimum.reduceat(second_of, at[:-1][full])
            here = np.flatnonzero((second_of == lowest[text_of]) & np.isfinite(second_of))
            whose, first = np.unique(text_of[here], return_index=True)
            second_of[here[first]] = np.inf
            for t, i in zip(whose.tolist(), here[first].tolist(), strict=True):
                least[t].append(i)
        wanted = list({distinct[codes[i]] for some in least for i in some})
        new = self.losses.lack(wanted)
        self.losses.keep(new, list(map(self._losses, new)))
        out = []
        for a, b, own_best, some in zip(ends[at[:-1]].tolist(), ends[at[1:]].tolist(), best.tolist(), least, strict=True):
            paths: list[tuple[float, tuple]] = [(0.0, ())]  # loss, and (place, ids) of the segments that differ
            for i in some:
                others = self.losses[distinct[codes[i]]][1:]
                changed = [(loss + x, (*parts, (i, own))) for loss, parts in paths for x, own in others]
                paths = heapq.nsmallest(self.n_best, paths + changed, key=_loss)
            n_ids = []
            for _, parts in paths:
                whole, done = [], a
                for i, own in sorted(parts):
                    whole += data[done : ends[i]], own
                    done = int(ends[i + 1])
                n_ids.append(b"".join((*whole, data[done:b])))
            out.append((n_ids, [own_best - loss for loss, _ in paths]))
        return out

    def n_encode(self, text: str) -> tuple[list[bytes], list[float]]:
        """Ids and scores of the n best segmentations of a text, best first."""
        return self.n_encode_all(pa.array([text], pa.string()))[0]

    def encode(self, text: str) -> tuple[bytes, list[float]]:
        """Ids of the best segmentation of a text, and the scores of its n best."""
        ids, scores = self.n_encode(text)
        return ids[0], scores

    def decode_all(self, ids: pa.Array) -> pa.Array:
        """The texts of ids as little-endian bytes, without nulls."""
        ids = ids.cast(pa.large_binary())
        at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] // 4
        flat = np.frombuffer(ids.buffers()[2] or b"", "<u4")[at[0] : at[-1]]
        raw = self.spelled.take(pa.array(flat))
        ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1][at - at[0]]
        full = ends[:-1] < ends[1:]
        kept = np.ones(ends[-1], bool)
        kept[ends[:-1][full]] = False  # the blank that was set before each text
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[: ends[-1]][kept]
        ends = ends - np.append(0, np.cumsum(full))
        texts = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        try:
            return texts.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # ids that don't spell UTF-8
            return pa.array([x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())

    def decode(self, ids: bytes) -> str:
        """The text of ids as little-endian bytes."""
        return self.decode_all(pa.array([ids], pa.binary()))[0].as_py()


_loaded: dict[tuple[str, int], Vocabulary] = {}


def vocabulary(path: str, n_best: int) -> Vocabulary:
    if (path, n_best) not in _loaded:
        _loaded[path, n_best] = Vocabulary(path, n_best)
    return _loaded[path, n_best]


def _with_n_best(batch: pa.RecordBatch, words: Vocabulary) -> pa.RecordBatch:
    n_ids, scores = zip(*words.n_encode_all(batch["text"].fill_null("")), strict=True)
    columns = [
        pa.array([x[0] for x in n_ids], pa.binary()),
        pa.array(scores, pa.list_(pa.float64())),
        pa.array(n_ids, pa.list_(pa.binary())),
    ]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "ids", "scores", "n_ids"])


def _with_text(batch: pa.RecordBatch, words: Vocabulary) -> pa.RecordBatch:
    lists = batch["n_ids"]
    at = lists.offsets.to_numpy()
    texts = words.decode_all(lists.values.slice(at[0], at[-1] - at[0]))
    n_decoded = pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), texts)
    columns = [words.decode_all(batch["ids"]), n_decoded]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "decoded", "n_decoded"])


def _mapped(rows: DataFrame, added: dict[str, T.DataType], path: str, n_best: int, column: str, *steps) -> DataFrame:
    """rows with the columns that the steps add to slices of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, n_best)
        for batch in slices(batches, column, 4 << 20):
            for step in steps:
                batch = step(batch, words)
            yield from map(batch.slice, range(0, batch.num_rows, _ROWS), repeat(_ROWS))

    schema = T.StructType([*rows.schema.fields, *(T.StructField(k, v) for k, v in added.items())])
    return rows.mapInArrow(run, schema)


_N_BEST = {
    "ids": T.BinaryType(),
    "scores": T.ArrayType(T.DoubleType()),
    "n_ids": T.ArrayType(T.BinaryType()),
}
_DECODED = {"decoded": T.StringType(), "n_decoded": T.ArrayType(T.StringType())}


def with_pieces(docs: DataFrame, model: str | None = None, n_best: int = N_BEST, text: str = "text") -> DataFrame:
    """(doc_id, text, ids, scores, n_ids) of docs: ids as little-endian bytes, the scores and the ids of the n best."""
    rows = docs.select("doc_id", docs[f"`{text}`"].alias("text"))
    return _mapped(rows, _N_BEST, model or public_tokenizers.path(MODEL), n_best, "text", _with_n_best)


def with_decoded(pieces: DataFrame, model: str | None = None) -> DataFrame:
    """pieces (doc_id, text, ids, scores, n_ids) with the columns `decoded`, of ids, and `n_decoded`."""
    rows = pieces.select("doc_id", "text", *_N_BEST)
    return _mapped(rows, _DECODED, model or public_tokenizers.path(MODEL), N_BEST, "ids", _with_text)


def with_round_trip(docs: DataFrame, model: str | None = None, n_best: int = N_BEST, text: str = "text") -> DataFrame:
    """What with_decoded(with_pieces(docs)) gives, in one pass."""
    rows = docs.select("doc_id", docs[f"`{text}`"].alias("text"))
    path = model or public_tokenizers.path(MODEL)
    return _mapped(rows, _N_BEST | _DECODED, path, n_best, "text", _with_n_best, _with_text)
