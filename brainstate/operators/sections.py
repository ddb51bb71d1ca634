"""TR2: a Butterworth band-pass by second-order sections, forward and backward over a whole recording, by blocks.

A filter is a linear system: what a block leaves behind is an affine map of the state it begins with, a power of the
system's matrix and the state that the block's samples make from rest. So blocks are first filtered from rest, each for itself;
a scan over these maps gives the state that each block begins with; then blocks are filtered from there. A map fades with its
length, so the scan of a block looks at as many blocks before it as the filter rings, whatever the block's size. The same
again, from the end to the beginning. At both ends the recording is extended oddly, and the filter begins there in the
steady state of the first value.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brainstate.sources.shared import stored

#: Samples that are filtered by one product of matrices.
STEP = 128
#: A state that has faded to this share of itself is gone.
FADED = 1e-40


def band_sections(fs: float, low: float, high: float, order: int) -> np.ndarray:
    """(b0, b1, b2, a1, a2) of each section of a digital Butterworth band-pass."""
    warped = [2 * fs * np.tan(np.pi * f / fs) for f in (low, high)]
    center, width = np.sqrt(warped[0] * warped[1]), warped[1] - warped[0]
    prototype = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order)) * width / 2
    root = np.sqrt(prototype**2 - center**2 + 0j)
    analog = np.concatenate([prototype + root, prototype - root])
    poles = (2 * fs + analog) / (2 * fs - analog)
    upper = sorted(poles[poles.imag > 0], key=lambda p: (abs(p), p.real))
    real = sorted(poles[poles.imag == 0].real)
    pairs = [(-2 * p.real, abs(p) ** 2) for p in upper] + [(-(p + q), p * q) for p, q in zip(real[::2], real[1::2], strict=True)]
    # One zero at 0 Hz and one at half the rate for each section; each has gain 1 in the middle of the band.
    middle = np.exp(2j * np.arctan(center / (2 * fs)))
    out = []
    for a1, a2 in pairs:
        gain = abs((1 + a1 / middle + a2 / middle**2) / (1 - 1 / middle**2))
        out.append((gain, 0.0, -gain, a1, a2))
    return np.array(out)


class Sections:
    """Sections one after the other as one system: state' = a @ state + b * x, y = c @ state + d * x."""

    def __init__(self, fs: float, low: float, high: float, order: int):
        self.args = fs, low, high, order

    def __reduce__(self):
        return Sections, self.args

    @cached_property
    def system(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        sections = band_sections(*self.args)
        n = 2 * len(sections)
        a, b, c, d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
        for k, (b0, b1, b2, a1, a2) in enumerate(sections):
            i = 2 * k
            # The section's input is c @ state + d * x; its output b0 times that and its first state.
            for row, (bj, aj) in enumerate(((b1, a1), (b2, a2))):
                a[i + row] = (bj - aj * b0) * c
                a[i + row, i] -= aj
                b[i + row] = (bj - aj * b0) * d
            a[i, i + 1] += 1
            c, d = b0 * c, b0 * d
            c[i] += 1
        return a, b, c, d

    @cached_property
    def products(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of STEP samples: outputs from inputs, outputs from the state before, and the powers of the system up to STEP."""
        a, b, c, d = self.system
        powers = [np.eye(len(a))]
        for _ in range(STEP):
            powers.append(powers[-1] @ a)
        powers = np.array(powers)
        answer = np.append(d, [c @ p @ b for p in powers[: STEP - 1]])
        lag = np.arange(STEP)[:, None] - np.arange(STEP)
        return np.where(lag >= 0, answer[np.maximum(lag, 0)], 0.0), np.array([c @ p for p in powers[:STEP]]), powers

    @cached_property
    def rings(self) -> int:
        """Samples after which a state has faded."""
        a, n = self.system[0], 1
        while np.abs(np.linalg.matrix_power(a, n)).max() > FADED:
            n *= 2
        return n

    def steady(self, value: np.ndarray) -> np.ndarray:
        """The state of each channel after a constant value has gone in for ever."""
        a, b, *_ = self.system
        return np.linalg.solve(np.eye(len(a)) - a, b)[:, None] * value

    def faded(self, state: np.ndarray, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.system[0], n) @ state

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs for x (samples x channels) and the state after them."""
        b = self.system[1]
        answers, echoes, powers = self.products
        y = np.empty_like(x)
        for at in range(0, len(x), STEP):
            part = x[at : at + STEP]
            n = len(part)
            y[at : at + n] = answers[:n, :n] @ part + echoes[:n] @ state
            state = powers[n] @ state + (powers[n - 1 :: -1] @ b).T @ part
        return y, state

    def zero_phase(self, x: np.ndarray, pad: int) -> np.ndarray:
        """The whole of a recording, forward and backward."""
        pad = min(pad, len(x) - 1)
        whole = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad else x
        y, _ = self.run(whole, self.steady(whole[0]))
        y, _ = self.run(y[::-1], self.steady(y[-1]))
        return y[::-1][pad : pad + len(x)]


def _packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.float64).tobytes()


def _blocks(filters: Sections):
    """A row for each block: its samples in order, and the state that they leave behind from rest."""

    def run(table: pa.Table) -> pa.Table:
        idx, first = np.unique(table["sample_idx"].to_numpy(), return_index=True)
        x = np.array(table["ch"].take(first).to_pylist(), float)
        _, state = filters.run(x, np.zeros((len(filters.system[1]), x.shape[1])))
        one = lambda v, kind: pa.array([v], kind)
        ts = table["ts"].take(first).combine_chunks()
        return pa.table(
            {
                "session_id": table["session_id"][:1], "block": table["block"][:1], "n": one(len(idx), pa.int64()), "idx": one(idx.tolist(), pa.list_(pa.int64())),
                "ts": pa.ListArray.from_arrays(pa.array([0, len(ts)], pa.int32()), ts), "x": one(_packed(x), pa.binary()), "left": one(_packed(state), pa.binary()),
            }
        )

    return run


def _state(filters: Sections, packed: bytes) -> np.ndarray:
    return np.frombuffer(packed).reshape(len(filters.system[1]), -1)


def _begun(filters: Sections, start: bytes, maps: list[dict]) -> np.ndarray:
    """The state after maps (n, left), which begin with the state start."""
    state = _state(filters, start)
    for m in maps:
        state = filters.faded(state, m["n"]) + _state(filters, m["left"])
    return state


def _forward(filters: Sections):
    """Blocks filtered from the state they begin with, and what they leave behind on the way back from rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1) for i in range(len(batch))):
                state = _begun(filters, row["start"][0].as_py(), row["maps"][0].as_py() or [])
                x = np.frombuffer(row["x"][0].as_py()).reshape(-1, state.shape[1])
                y, _ = filters.run(x, state)
                _, left = filters.run(y[::-1], np.zeros_like(state))
                columns = [row[c] for c in ("session_id", "block", "n", "idx", "ts")]
                packed = [pa.array([_packed(v)], pa.binary()) for v in (y, left)]
                yield pa.RecordBatch.from_arrays([*columns, *packed], ["session_id", "block", "n", "idx", "ts", "x", "left"])

    return run


def _backward(filters: Sections):
    """Samples filtered on the way back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1) for i in range(len(batch))):
                state = _begun(filters, row["start"][0].as_py(), row["maps"][0].as_py() or [])
                x = np.frombuffer(row["x"][0].as_py()).reshape(-1, state.shape[1])
                y = filters.run(x[::-1], state)[0][::-1]
                n, channels = y.shape
                rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * channels, pa.int32()), pa.array(y.ravel()))
                session = row["session_id"].take(pa.array(np.zeros(n, np.int64)))
                yield pa.RecordBatch.from_arrays([session, row["idx"].flatten(), row["ts"].flatten(), rows], ["session_id", "sample_idx", "ts", "ch"])

    return run


def _ends(filters: Sections, pad: int):
    """The states that the first block begins with, and the last one on the way back, from both ends of a recording."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        x = np.concatenate([np.frombuffer(b).reshape(-1, len(_state(filters, s).T)) for b, s in zip(table["x"].to_pylist(), table["left"].to_pylist(), strict=True)])
        sizes = table["n"].to_pylist()
        side = np.repeat(table["head"].to_numpy(zero_copy_only=False), sizes), np.repeat(table["tail"].to_numpy(zero_copy_only=False), sizes)
        head, tail = x[side[0]], x[side[1]]
        p = min(pad, len(head) - 1)
        early = 2 * head[0] - head[p:0:-1]
        start = filters.steady((early if p else head)[0])
        if p:
            _, start = filters.run(early, start)
        # The state at the end comes from the blocks at the tail, which reach as far as the filter rings.
        state = np.zeros_like(start)
        for n, left, first, last in zip(sizes, *(table[c].to_pylist() for c in ("left", "first", "tail")), strict=True):
            state = start if first else state
            state = filters.faded(state, n) + _state(filters, left) if last else state
        late = 2 * tail[-1] - tail[-2 : -p - 2 : -1]
        if p:
            y, _ = filters.run(late, state)
            _, back = filters.run(y[::-1], filters.steady(y[-1]))
        else:
            back = filters.steady(filters.run(tail, filters.steady(tail[0]))[0][-1])
        return pa.table({"session_id": table["session_id"][:1], "start": pa.array([_packed(start)], pa.binary()), "back": pa.array([_packed(back)], pa.binary())})

    return run


def bandpass_mu(
    samples: DataFrame, fs: float = 250.0, low: float = 8.0, high: float = 12.0, order: int = 4,
    block_seconds: float = 60.0, pad_seconds: float = 10.0,
) -> DataFrame:
    """TR2: zero-phase band-pass of continuous recordings (session_id, sample_idx, ts, ch), the same for any size of blocks.

    A repeated sample counts once. Recordings have no gaps; the samples around one are taken as neighbours.
    """
    filters, size, pad = Sections(fs, low, high, order), max(int(block_seconds * fs), 1), int(pad_seconds * fs)
    kind, ts = (samples.schema[c].dataType.simpleString() for c in ("session_id", "ts"))
    packed = f"session_id {kind}, block long, n long, idx array<long>, ts array<{ts}>, x binary, left binary"
    rows = samples.select("session_id", "sample_idx", "ts", "ch", F.floor(F.col("sample_idx") / F.lit(size)).alias("block"))
    blocks = stored(rows.groupBy("session_id", "block").applyInArrow(_blocks(filters), packed), "blocks")
    near = -(-filters.rings // size) + 1
    of_session = Window.partitionBy("session_id")
    up, down = of_session.orderBy("block"), of_session.orderBy(F.desc("block"))
    before = F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, -1))
    after = F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1))
    # Blocks within reach of an end of their recording; a bounded number of samples and a block more.
    edges = blocks.select("session_id", "block", "n").withColumns({"before": F.coalesce(before, F.lit(0)), "after": F.coalesce(after, F.lit(0))})
    edges = edges.select("session_id", "block", (F.col("before") == 0).alias("first"), (F.col("before") <= pad).alias("head"), (F.col("after") <= max(pad, filters.rings)).alias("tail"))
    ends = blocks.select("session_id", "block", "n", "x", "left").join(edges.filter("head or tail"), ["session_id", "block"])
    ends = stored(ends.groupBy("session_id").applyInArrow(_ends(filters, pad), f"session_id {kind}, start binary, back binary"), "ends")

    def begun(df: DataFrame, order_by, end: str) -> DataFrame:
        maps = F.collect_list(F.struct("n", "left")).over(order_by.rowsBetween(-near, -1))
        states = df.select("session_id", "block", maps.alias("maps")).join(ends.select("session_id", F.col(end).alias("start")), "session_id")
        return df.drop("left").join(states, ["session_id", "block"])

    forward = stored(begun(blocks, up, "start").mapInArrow(_forward(filters), packed), "forward")
    return begun(forward, down, "back").mapInArrow(_backward(filters), f"session_id {kind}, sample_idx long, ts {ts}, ch array<double>")
