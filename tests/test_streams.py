"""State of streams and the memories they write, against batch forms and plain loops."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from brainstate.operators.signal import band_means, welch_frequencies, welch_psd
from brainstate.streaming.stateful import Debounce, EpisodeLog, SegmentSpectra
from brainstate.streaming.streams import memorize, memory

BASE = 10**15


class Handle:
    """What a processor asks of Spark for one key."""

    def __init__(self):
        self.states, self.timers = {}, []

    class State:
        value = None

        def exists(self):
            return bool(self.value)

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        put = update

        def clear(self):
            self.value = None

    def getValueState(self, name, schema):
        return self.states.setdefault(name, self.State())

    getListState = getValueState

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, watermark_us):
        self.ms = max(watermark_us, 0) // 1000

    def getCurrentWatermarkInMs(self):
        return self.ms


def run(processor, batches, delay_us):
    """Rows of a processor over batches (frames with us), as Spark would call it, and its handle."""
    handle, watermark, out = Handle(), 0, []
    processor.init(handle)
    for frame in [*batches, None, None]:
        if frame is None:
            watermark += 10**13
        else:
            frame = frame[frame["us"] > watermark]
        if frame is not None and len(frame):
            out += processor.handleInputRows(("s",), iter([frame]), Clock(watermark))
            watermark = max(watermark, int(frame["us"].max()) - delay_us)
        for _ in range(3):
            if [x for x in handle.timers if x <= watermark // 1000]:
                out += processor.handleExpiredTimer(("s",), Clock(watermark), None)
    return pd.concat(out, ignore_index=True), handle


def windows_of(idx, data, fs, window, hop, n_fft):
    """The features of each window whose samples are all there."""
    at = {int(i): k for k, i in enumerate(idx)}
    freqs, kept = welch_frequencies(fs, n_fft)
    out = {}
    for start in range(0, int(idx.max()) + 1, hop):
        if all(i in at for i in range(start, start + window)):
            x = data[[at[i] for i in range(start, start + window)]].T
            cut = x[:, : window // n_fft * n_fft].reshape(len(x), -1, n_fft)
            out[start] = band_means(freqs[kept], welch_psd(cut, fs).mean(axis=(0, 1))[kept])
    return out


@pytest.mark.parametrize(("window", "hop", "n_fft"), [(64, 4, 32), (64, 20, 32), (50, 7, 16), (32, 40, 32)])
@pytest.mark.parametrize("holes", [(), (130,), (0, 131, 132, 400)])
def test_spectra_of_shuffled_samples(window, hop, n_fft, holes):
    r = np.random.default_rng(window + hop)
    idx = np.array([i for i in range(700) if i not in holes])
    data = r.normal(size=(len(idx), 2))
    order = np.argsort(idx + r.integers(0, 40, len(idx)))  # samples are up to 40 places late
    batches = []
    for part in np.array_split(order, 23):
        part = np.concatenate([part, part[:2]])  # some come twice
        us = BASE + idx[part] * 1000
        batches.append(pd.DataFrame({"sample_idx": idx[part], "ts": pd.to_datetime(us, unit="us"), "us": us, "ch": list(data[part])}))
    sizes, processor = [], SegmentSpectra(64.0, window, hop, n_fft, 10**12)
    advanced = processor._advanced

    def measured(*args):
        out = advanced(*args)
        *_, i, _, _, starts, spectra = processor.held.get()
        sizes.append((len(i) // 8, len(starts) // 8))
        return out

    processor._advanced = measured
    got, handle = run(processor, batches, 100_000)
    expected = windows_of(idx, data, 64.0, window, hop, n_fft)
    assert got["start_idx"].tolist() == sorted(expected)
    assert np.allclose(got[["theta", "alpha", "beta"]], [expected[s] for s in got["start_idx"]])
    assert (got["ts"] == pd.to_datetime(BASE + (got["start_idx"] + window - 1) * 1000, unit="us")).all()
    # The state: samples of the segment at hand and those that wait, spectra of the windows at hand.
    assert max(n for n, _ in sizes) <= n_fft + 100 + 40 and max(n for _, n in sizes) <= -(-window // hop) * (window // n_fft)
    assert not handle.states["held"].exists() and not handle.timers  # an idle session is forgotten


def test_episodes_of_shuffled_hops():
    r = np.random.default_rng(1)
    labels = np.repeat(r.choice(["A", "B", "neutral"], 60, p=[0.5, 0.4, 0.1]), r.integers(1, 7, 60))
    us, tie = BASE + np.arange(len(labels)) // 2 * 1_000_000, np.arange(len(labels))
    machine, expected = Debounce(1.0), []
    for u, k, label in zip(us.tolist(), tie, labels, strict=True):
        expected += [("s", *a, [float(k)] if a[0] == "start" else None) for a in machine.step(u, label)]
    order = np.argsort(tie + r.integers(0, 8, len(tie)))
    rows = pd.DataFrame({"us": us, "tie": tie, "label": labels, "vector": [[float(k)] for k in tie]}).iloc[order]
    processor = EpisodeLog(1.0, 10**12)
    got, handle = run(processor, np.array_split(rows, 17), 20_000_000)
    assert [tuple(x) for x in got.itertuples(index=False)] == expected and len(expected) > 20
    assert not any(s.exists() for s in handle.states.values()) and not handle.timers


def test_a_session_is_read_and_written_once_a_batch():
    """Calls of the state store for a batch of a session don't follow the hops that wait."""
    calls = []

    class Counted(Handle.State):
        def __getattribute__(self, name):
            if name in ("exists", "get", "update", "put", "clear"):
                calls.append(name)
            return super().__getattribute__(name)

    handle, processor = Handle(), EpisodeLog(1.0, 10**12)
    handle.State = Counted
    handle.listTimers = lambda: calls.append("listTimers") or list(handle.timers)
    processor.init(handle)
    for batch in range(3):
        us = BASE + np.arange(50) * 1_000_000 - batch
        frame = pd.DataFrame({"us": us, "tie": np.arange(50), "label": "A", "vector": [None] * 50})
        calls.clear()
        assert not len(pd.concat(processor.handleInputRows(("s",), iter([frame]), Clock(0))))
        assert calls == ["get", "update"] and len(handle.timers) == 1
    out = pd.concat(processor.handleExpiredTimer(("s",), Clock(BASE + 10**10), None))
    assert out["at_us"].tolist() == [BASE + 1_000_000 - 2] and out["vector"].tolist() == [None]


def test_batches_merge_into_both_memories(spark, tmp_path):
    """Starts and ends in different batches, a batch that runs again, and a similar start in the same batch and before."""
    second = 1_000_000
    v = {"a": [1.0, 0.0], "b": [0.0, 1.0], "a2": [2.0, 0.01]}
    batches = [
        [("s1", "start", "e1", BASE, "calm", v["a"]), ("s2", "start", "e1", BASE, "focus", v["b"]), ("s4", "start", "x", BASE, "unknown", v["a"])],
        [("s1", "end", "e1", BASE + 96 * second, None, None), ("s1", "start", "e2", BASE + 96 * second, "happy", v["b"])],
        [("s1", "end", "e2", BASE + 99 * second, None, None), ("s1", "start", "e3", BASE + 120 * second, "calm", v["a2"]),
         ("s1", "start", "e4", BASE + 150 * second, "happy", v["b"])],
        [("s3", "start", "e1", BASE, "calm", v["a"])],
        [("s1", "start", "e3", BASE + 120 * second, "calm", v["a2"]), ("s9", "end", "e1", BASE, None, None)],
        [],
    ]
    schema = "session_id string, action string, evt_id string, at_us long, state string, vector array<double>"
    path = str(tmp_path / "store")
    for i in (0, 1, 1, 2, 2, 3, 4, 5):
        memorize(spark.createDataFrame(batches[i], schema), path, i, buckets=4)
    text = {(r.session_id, r.evt_id): r for r in memory(spark, path, "text").collect()}
    eeg = {(r.session_id, r.evt_id): r for r in memory(spark, path, "eeg").collect()}
    assert set(text) == set(eeg) == {("s1", "e1"), ("s1", "e2"), ("s1", "e3"), ("s1", "e4"), ("s2", "e1"), ("s3", "e1")}
    at = lambda us: dt.datetime.fromtimestamp(us / 1e6, dt.timezone.utc).strftime("%Y年%m月%d日 %H时%M分%S秒")
    assert text["s1", "e1"].document.endswith(f"【结束时间】: {at(BASE + 96 * second)}\n【持续总时长】: 1分36秒")
    assert text["s1", "e2"].document.endswith("【持续总时长】: 3秒") and text["s1", "e3"].document.endswith("[状态持续中...]")
    assert all(r.context == text[k].document == text[k].context and r.start_us == text[k].start_us for k, r in eeg.items())
    similar = {k: r.similar_context for k, r in eeg.items()}
    assert similar["s1", "e3"] == text["s1", "e1"].document and similar["s1", "e4"] == text["s1", "e2"].document
    assert {similar[k] for k in similar if k not in {("s1", "e3"), ("s1", "e4")}} == {"无相似记忆"}
    assert len(list((tmp_path / "store" / "text").glob("version=*/bucket=*"))) <= 2 * 4
    assert memory(spark, str(tmp_path / "none")).count() == 0
