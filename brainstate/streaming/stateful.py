"""State of a session in a stream: spectra of segments (ST1) and the debounce of episodes (ST2).

Both keep what they need of a session in Spark's state store and use timers of event time: for what waits for earlier
rows, and to forget a session that has been idle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brainstate.functions.scoring import NEUTRAL
from brainstate.operators.signal import band_means, welch_frequencies, welch_psd


def wait(handle: StatefulProcessorHandle, *at_us: int | None) -> None:
    """One timer, at the earliest of these times."""
    for timer in handle.listTimers():
        handle.deleteTimer(timer)
    if times := [x for x in at_us if x is not None]:
        handle.registerTimer(min(times) // 1000 + 1)


class SegmentSpectra(StatefulProcessor):
    """Band powers of a session's windows, by count of samples.

    Samples go into a window as soon as all before them are there, so it doesn't matter in which order they come. A segment is
    transformed once, when its last sample is there. What stays are the samples of segments that aren't whole,
    less than n_fft of them, and the spectra of segments whose windows aren't, at most window / hop of them and
    none of hop >= window. A gap that the watermark has passed is a gap: no window spans it.
    """

    COLUMNS = ("session_id", "start_idx", "ts", "theta", "alpha", "beta")
    STATE = "run_start long, settled long, last_us long, channels int, idx binary, us binary, ch binary, starts binary, spectra binary"

    def __init__(self, fs: float, window: int, hop: int, n_fft: int, idle_us: int):
        self.fs, self.window, self.hop, self.n_fft, self.idle_us = fs, window, hop, n_fft, idle_us
        freqs, self.kept = welch_frequencies(fs, n_fft)
        self.freqs = freqs[self.kept]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [(x["sample_idx"].to_numpy(np.int64), x["ts"].astype("datetime64[us]").to_numpy().astype(np.int64), np.stack(x["ch"].to_numpy()).astype(np.float64)) for x in rows if len(x)]
        yield self._advanced(key, [np.concatenate(x) for x in zip(*frames, strict=True)], timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        out = self._advanced(key, None, now)
        if self.held.exists() and self.held.get()[2] + self.idle_us <= now:
            self.held.clear()
            wait(self.handle)
        yield out

    def _advanced(self, key, new: list[np.ndarray] | None, watermark: int) -> pd.DataFrame:
        if not self.held.exists() and new is None:
            return pd.DataFrame(columns=self.COLUMNS)
        idx = us = starts = np.zeros(0, np.int64)
        channels = new[2].shape[1] if new else 0
        data, spectra = np.zeros((0, channels)), np.zeros((0, len(self.freqs)))
        run_start, settled, last = 0, 0, 0
        if self.held.exists():
            run_start, settled, last, channels, *packed = self.held.get()
            idx, us, starts = (np.frombuffer(packed[i], np.int64) for i in (0, 1, 3))
            data = np.frombuffer(packed[2], np.float64).reshape(-1, channels)
            spectra = np.frombuffer(packed[4], np.float64).reshape(-1, len(self.freqs))
        if new:
            fresh = new[0] >= settled  # what is before has been there, or is too late
            last = max(last, int(new[1].max()))
            idx, us, data = (np.concatenate([a, b[fresh]]) for a, b in zip((idx, us, data), new, strict=True))
            idx, first = np.unique(idx, return_index=True)
            us, data = us[first], data[first]
        found = []
        while True:
            at = int(np.searchsorted(idx, settled))
            if at < len(idx) and idx[at] > settled:
                if us[at] > watermark:
                    break  # waits for what is before it
                run_start = settled = int(idx[at])
                idx, us, data = idx[at:], us[at:], data[at:]
                starts, spectra, at = starts[:0], spectra[:0], 0
            if at == len(idx):
                break
            end = settled + int(np.argmin(np.append(idx[at:] - settled == np.arange(len(idx) - at), False)))
            rows, starts, spectra = self._windows(run_start, settled, end, idx, us, data, starts, spectra)
            found += rows
            settled = end
            keep = (idx > settled - self.n_fft) & (idx >= run_start) | (idx >= settled)
            idx, us, data = idx[keep], us[keep], data[keep]
        waiting = int(us[np.searchsorted(idx, settled)]) if len(idx) and idx[-1] >= settled else None
        wait(self.handle, waiting, last + self.idle_us)
        self.held.update((run_start, settled, last, channels, *(np.ascontiguousarray(x).tobytes() for x in (idx, us, data, starts, spectra))))
        rows = pd.DataFrame(found, columns=self.COLUMNS[1:])
        rows["ts"] = pd.to_datetime(rows["ts"], unit="us")
        rows.insert(0, "session_id", key[0])
        return rows

    def _windows(self, run_start, settled, end, idx, us, data, starts, spectra) -> tuple[list, np.ndarray, np.ndarray]:
        """Rows of the windows that end after settled and not after end, and the segments that later ones need."""
        parts = np.arange(self.window // self.n_fft) * self.n_fft
        low = max(run_start, settled - self.n_fft + 1)
        grid = np.concatenate([np.arange(-(-(low - p) // self.hop), (end - self.n_fft - p) // self.hop + 1) * self.hop + p for p in parts])
        grid = np.unique(grid[(grid >= low) & (grid + self.n_fft <= end)])
        if len(grid):
            cut = data[np.searchsorted(idx, grid)[:, None] + np.arange(self.n_fft)]  # segments x n_fft x channels
            power = welch_psd(np.moveaxis(cut, 2, 0), self.fs).mean(axis=0)[:, self.kept]
            starts, spectra = np.concatenate([starts, grid]), np.concatenate([spectra, power])
        first = max(-(-run_start // self.hop), (settled - self.window) // self.hop + 1, 0)
        wins = np.arange(first, (end - self.window) // self.hop + 1) * self.hop
        rows = []
        if len(wins):
            order = np.argsort(starts)
            at = order[np.searchsorted(starts, wins[:, None] + parts, sorter=order)]
            powers = band_means(self.freqs, spectra[at].mean(axis=1))
            ends = us[np.searchsorted(idx, wins + self.window - 1)]
            rows = list(zip(wins.tolist(), ends.tolist(), *(p.tolist() for p in powers), strict=True))
        later = max(run_start, ((end - self.window) // self.hop + 1) * self.hop)
        return rows, starts[starts >= later], spectra[starts >= later]


class Debounce:
    """The state machine of one session: candidate, first_seen, last_reported, active event (times in micros)."""

    def __init__(self, sustain: float, state: tuple = (None, None, None, None)):
        self.sustain = int(sustain * 1e6)
        self.candidate, self.first_seen, self.last_reported, self.active = state

    def state(self) -> tuple:
        return self.candidate, self.first_seen, self.last_reported, self.active

    def step(self, now: int, label: str) -> Iterator[tuple[str, str, int, str | None]]:
        """(action, evt_id, time, state) of what a hop does; an end comes before a start."""
        if label == NEUTRAL:
            if self.active:
                yield "end", self.active, now, None
            self.candidate = self.first_seen = self.last_reported = self.active = None
        elif label != self.candidate:
            self.candidate, self.first_seen = label, now
        elif now - self.first_seen >= self.sustain and label != self.last_reported:
            if self.active:
                yield "end", self.active, now, None
            self.active, self.last_reported = f"evt_{now // 1_000_000}", label
            yield "start", self.active, now, label


class EpisodeLog(StatefulProcessor):
    """Starts and ends of a session's episodes, from hops in any order within the watermark's delay.

    Hops wait until the watermark has passed them and are then taken in order. What stays is the machine's five values, the
    timer and the hops that wait, as one value: a call for a session reads it once and writes it once, whatever the number of hops.
    A session without hops for the idle time is forgotten, and begins anew if it comes back.
    """

    COLUMNS = ("session_id", "action", "evt_id", "at_us", "state", "vector")
    STATE = "candidate string, first_seen long, last_reported string, active string, last_us long, timer long, waiting binary"
    HOPS = pa.schema([("us", pa.int64()), ("tie", pa.int64()), ("label", pa.string()), ("vector", pa.list_(pa.float64()))])

    def __init__(self, sustain: float, idle_us: int):
        self.sustain, self.idle_us = sustain, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [pa.table([pa.array(r[f.name].tolist(), f.type) for f in self.HOPS], schema=self.HOPS) for r in rows]
        yield self._settled(key, new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settled(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def _settled(self, key, new: list[pa.Table], watermark: int) -> pd.DataFrame:
        *state, last, timer, waiting = self.held.get() or (None,) * 7
        machine, out = Debounce(self.sustain, tuple(state)), []
        hops = pa.concat_tables([*([pa.ipc.open_stream(waiting).read_all()] if waiting else ()), *new]) if waiting or new else self.HOPS.empty_table()
        us = hops["us"].to_numpy()
        ready = us <= watermark
        if ready.any():
            passed = hops.filter(pa.array(ready))
            passed = passed.take(pa.array(np.lexsort((passed["tie"].to_numpy(), passed["us"].to_numpy()))))
            for at, label, vector in zip(passed["us"].to_pylist(), passed["label"].to_pylist(), passed["vector"], strict=True):
                out += [(key[0], *action, vector.as_py() if action[0] == "start" else None) for action in machine.step(at, label)]
                last = at
            hops, us = hops.filter(pa.array(~ready)), us[~ready]
        self._keep(machine, last, timer, hops, us, idle=not new and last is not None and last + self.idle_us <= watermark)
        return pd.DataFrame(out, columns=self.COLUMNS)

    def _keep(self, machine: Debounce, last: int | None, timer: int | None, hops: pa.Table, us: np.ndarray, idle: bool) -> None:
        """The state, and one timer: for the first hop that waits, or for the end of the idle time."""
        times = ([int(us.min())] if len(us) else []) + ([] if last is None else [last + self.idle_us])
        forget = not len(us) and (idle or not times)
        at = None if forget else min(times) // 1000 + 1
        if timer != at:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if at is not None:
                self.handle.registerTimer(at)
        if forget:
            self.held.clear()
            return
        packed = None
        if len(us):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.HOPS) as writer:
                writer.write_table(hops.combine_chunks())
            packed = sink.getvalue().to_pybytes()
        self.held.update((*machine.state(), last, at, packed))
