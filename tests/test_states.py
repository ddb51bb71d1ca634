"""Spectra, scores and episodes against golden values and a plain loop."""

import datetime as dt
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from brainstate.functions.scoring import classify
from brainstate.operators.dashboard import poll_metrics
from brainstate.operators import episode_blocks
from brainstate.operators.episodes import episodes, label_runs, neutral_epochs
from brainstate.operators.sections import Sections, band_sections, bandpass_mu
from brainstate.operators.signal import (
    average_reference, band_power, band_power_long, psd_long, window_features, zero_phase_gain,
)
from brainstate.streaming.stateful import Debounce

START = dt.datetime(2024, 1, 1)
MODES = {
    "m1": ([(6, 5.0)], (3.125, 0, 0), "fatigue"),
    "m2": ([(10, 5.0)], (0, 2.5, 0), "calm"),
    "m3": ([(20, 5.0)], (0, 0, 0.735294), "focus"),
    "m4": ([(10, 3.5), (20, 3.5)], (0, 1.225, 0.360294), "happy"),
    "m5": ([(6, 3.5), (20, 3.5)], (1.53125, 0, 0.360294), "distress"),
    "m0": ([], (0, 0, 0), "neutral"),
}


def recorded(spark, n=1000, fs=250.0):
    rows = []
    for name, (waves, _, _) in MODES.items():
        x = sum((a * np.sin(2 * np.pi * f * np.arange(n) / fs) for f, a in waves), np.zeros(n))
        rows += [(name, i, START + dt.timedelta(seconds=i / fs), [float(v)] * 8) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "session_id string, sample_idx long, ts timestamp, ch array<double>")


def test_golden_spectra(spark):
    found = {r.session_id: r for r in classify(window_features(recorded(spark))).collect()}
    for name, (_, powers, label) in MODES.items():
        r = found[name]
        assert np.allclose((r.theta, r.alpha, r.beta), powers, atol=1e-5), name
        assert r.label == label
    assert found["m4"].calm_idx == pytest.approx(15.45, abs=0.01)
    assert found["m4"].focus_idx == pytest.approx(15.91, abs=0.01)
    assert found["m5"].fatigue_idx == pytest.approx(16.19, abs=0.01)


def test_blocks_and_gaps_change_nothing(spark):
    samples = recorded(spark, 2000).filter("session_id = 'm4'")
    one = window_features(samples, hop=25, wins_per_block=1000).orderBy("win_id").collect()
    many = window_features(samples, hop=25, wins_per_block=3).orderBy("win_id").collect()
    assert len(one) == 41
    assert [(a.win_id, a.ts) for a in one] == [(b.win_id, b.ts) for b in many]
    assert np.allclose([a.vector for a in one], [b.vector for b in many])
    holes = window_features(samples.filter("sample_idx <> 1100"), hop=25)
    assert [r.win_id for r in holes.orderBy("win_id").collect()] == [0, 1, 2, 3, 4]


def test_bandpass_gain_and_phase():
    filters, n = Sections(250.0, 8.0, 12.0, 4), 1 << 14
    pulse = np.zeros((n, 1))
    pulse[n // 2] = 1
    spectrum = np.fft.rfft(np.roll(filters.zero_phase(pulse, 0)[:, 0], -n // 2))
    assert np.abs(spectrum - zero_phase_gain(n, 250.0, 8.0, 12.0, 4)).max() < 1e-12  # no phase at all
    t = np.arange(5000) / 250.0
    for f, gain in ((10, 1.0), (3, 0.0), (30, 0.0)):
        x = np.sin(2 * np.pi * f * t)[:, None]
        y = filters.zero_phase(x, 2500)
        assert np.abs(y - gain * x)[1500:3500].max() < 0.02


def filtered(sections, x):
    """A plain loop over the sections, from the steady state of the first sample."""
    y = x.tolist()
    for b0, b1, b2, a1, a2 in sections.tolist():
        steady = y[0] * (b0 + b1 + b2) / (1 + a1 + a2)
        s2 = b2 * y[0] - a2 * steady
        s1 = b1 * y[0] - a1 * steady + s2
        for i, v in enumerate(y):
            out = b0 * v + s1
            s1, s2 = b1 * v - a1 * out + s2, b2 * v - a2 * out
            y[i] = out
    return np.array(y)


def test_bandpass_of_any_blocks_equals_a_plain_loop(spark):
    r = np.random.default_rng(0)
    sessions = {"long": r.normal(size=(2100, 2)) + 3, "short": r.normal(size=(700, 2)), "few": r.normal(size=(9, 2)), "one": np.ones((1, 2))}
    rows = [(s, i, START + dt.timedelta(seconds=i / 250), v.tolist()) for s, x in sessions.items() for i, v in enumerate(x)]
    rows += rows[5:8]  # repeated samples
    r.shuffle(rows)
    df = spark.createDataFrame([tuple(x) for x in rows], "session_id string, sample_idx long, ts timestamp, ch array<double>")
    expected = {}
    for s, x in sessions.items():
        pad = min(250, len(x) - 1)
        for c in range(2):
            v = x[:, c]
            whole = np.concatenate([2 * v[0] - v[pad:0:-1], v, 2 * v[-1] - v[-2 : -pad - 2 : -1]]) if pad else v
            sections = band_sections(250.0, 8.0, 12.0, 4)
            expected[s, c] = filtered(sections, filtered(sections, whole)[::-1])[::-1][pad : pad + len(v)]
    for seconds in (0.2, 1.0, 100.0):
        got = bandpass_mu(df, block_seconds=seconds, pad_seconds=1.0).orderBy("sample_idx").collect()
        assert len(got) == sum(map(len, sessions.values()))
        for (s, c), y in expected.items():
            assert np.abs(np.array([x.ch[c] for x in got if x.session_id == s]) - y).max() < 1e-9
    assert bandpass_mu(df.limit(0)).count() == 0


def test_average_reference(spark):
    df = spark.createDataFrame([([1.0, 2.0, 6.0],)], "ch array<double>")
    assert average_reference(df).first().ch == [-2.0, -1.0, 3.0]


def found_episodes(spark, sessions, sustain=3.0):
    rows = [(s, START + dt.timedelta(seconds=i), x) for s, labels in sessions.items() for i, x in labels]
    df = episodes(spark.createDataFrame(rows, "session_id string, ts timestamp, label string"), sustain)
    at = lambda x: None if x is None else (x - START).total_seconds()
    return sorted((r.session_id, r.state, at(r.start_ts), at(r.end_ts)) for r in df.collect())


def test_hops_of_equal_times_follow_their_index(spark):
    """Three hops share each time; the loop reads them by sample_idx."""
    rng = np.random.default_rng(5)
    rows, expected = [], []
    for s in range(12):
        machine, opened = Debounce(1.0), []
        labels = np.repeat(rng.choice(["A", "B", "neutral"], 30, p=[0.5, 0.4, 0.1]), rng.integers(1, 9, 30)).tolist()
        for i, label in enumerate(labels):
            rows.append((s, START + dt.timedelta(seconds=i // 3), i, label))
            for action, _, us, state in machine.step(i // 3 * 1_000_000, label):
                if action == "start":
                    opened.append([s, state, us / 1e6, None])
                else:
                    opened[-1][3] = us / 1e6
        expected += map(tuple, opened)
    rng.shuffle(rows)
    hops = spark.createDataFrame([tuple(r) for r in rows], "session_id long, ts timestamp, sample_idx long, label string")
    at = lambda x: None if x is None else (x - START).total_seconds()
    got = [(r.session_id, r.state, at(r.start_ts), at(r.end_ts)) for r in episodes(hops, 1.0).collect()]
    assert len(got) > 20
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_band_power_equals_its_long_form(spark):
    features = window_features(recorded(spark)).select("session_id", "win_id", "psd", "vector").cache()
    short = {r.session_id: (r.theta, r.alpha, r.beta) for r in band_power(features).collect()}
    long = {r.session_id: (r.theta, r.alpha, r.beta) for r in band_power_long(psd_long(features)).collect()}
    for r in features.collect():
        assert np.allclose(short[r.session_id], r.vector) and np.allclose(long[r.session_id], r.vector)


def test_ticks_over_a_long_gap(spark):
    """A gap of three hours of seconds, points between ticks, two points in one tick, nulls."""
    points = [(0.5, 1.0), (2.2, None), (2.7, 3.0), (4.0, 4.0), (10_804.5, 5.0)]
    rows = [("s", START + dt.timedelta(seconds=t), v) for t, v in points]
    made = poll_metrics(spark.createDataFrame(rows, "session_id string, ts timestamp, v double"), ["v"]).collect()
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    got = sorted((r.us // 1_000_000 - base, r.v) for r in made)
    expected = [(k, [v for t, v in points if t <= k and v is not None][-1]) for k in range(1, 10_806)]
    assert got == expected


def named(text):
    return [(i, {"n": "neutral"}.get(x, x)) for i, x in enumerate(text) if x != " "]


CASES = {
    "AAAAn": [("A", 3, 4)],
    "AAAn": [],
    "AAAABAAAAn": [("A", 3, 9)],
    "AAAABBBBn": [("A", 3, 7), ("B", 7, 8)],
    "AAAAnAAAA": [("A", 3, 4), ("A", 8, None)],
    "AAAA": [("A", 3, None)],
    "A": [],
}


def test_episode_cases(spark):
    got = found_episodes(spark, {k: named(k) for k in CASES})
    assert got == sorted((k, *e) for k, found in CASES.items() for e in found)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ABCn", min_size=1, max_size=40), min_size=8, max_size=20), st.sampled_from([0.0, 1.0, 3.0]))
def test_episodes_equal_the_loop(spark, texts, sustain):
    sessions = {f"{i}": named(text) for i, text in enumerate(texts)}
    expected = []
    for s, hops in sessions.items():
        machine, opened = Debounce(sustain), []
        for i, label in hops:
            for action, _, us, state in machine.step(i * 1_000_000, label):
                if action == "start":
                    opened.append([s, state, us / 1e6, None])
                else:
                    opened[-1][3] = us / 1e6
        expected += [tuple(x) for x in opened]
    assert found_episodes(spark, sessions, sustain) == sorted(expected)


def test_blocks_of_hops_equal_the_windows(spark):
    """Runs over many blocks, blocks of one hop, blocks without hops, times shared by hops."""
    r = np.random.default_rng(8)
    rows = []
    for s in range(10):
        labels = np.repeat(r.choice(["A", "B", "neutral"], 25, p=[0.5, 0.35, 0.15]), r.integers(1, 12, 25)).tolist()
        seconds = np.cumsum(r.choice([0, 1, 1, 2, 60], len(labels), p=[0.2, 0.4, 0.2, 0.15, 0.05])).tolist()
        rows += [(s, START + dt.timedelta(seconds=t), i, x) for i, (t, x) in enumerate(zip(seconds, labels, strict=True))]
    hops = spark.createDataFrame(rows, "session_id long, ts timestamp, sample_idx long, label string").cache()
    columns = ["session_id", "ts", "sample_idx", "run_id", "hop_no", "run_start", "epoch", "reset_ts"]
    runs = sorted(map(tuple, label_runs(neutral_epochs(hops)).select(columns).collect()))
    whole = sorted(map(repr, episodes(hops, 3.0).collect()))
    assert len(whole) > 30
    for block in (1.0, 5.0, 1e6):
        assert sorted(map(tuple, episode_blocks.label_runs(hops, block).select(columns).collect())) == runs
        assert sorted(map(repr, episode_blocks.episodes(hops, 3.0, block, 0).select(episodes(hops).columns).collect())) == whole
    assert sorted(map(repr, episode_blocks.episodes(hops, 3.0).select(episodes(hops).columns).collect())) == whole
    assert episode_blocks.episodes(hops.limit(0)).count() == 0
    plan = episode_blocks.label_runs(hops, 5.0)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"\[session_id#\d+L, block#\d+L\], \[ts#", plan) and not re.search(r"\[session_id#\d+L\], \[ts#", plan)
