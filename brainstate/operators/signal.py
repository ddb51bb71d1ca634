"""Spectral features of sample streams (SP1 to SP5) and the average reference of recordings (TR1).

Samples are rows (session_id, sample_idx, ts, ch). Heavy work is dealt by session and
block of samples, each with the halo that its edges need, so a session of days is spread over
many tasks and only the halo is copied.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bands as (name, from, to), half open.
BANDS = (("theta", 4.0, 8.0), ("alpha", 8.0, 13.0), ("beta", 13.0, 30.0))
FS = 250.0
F_MIN, F_MAX = 1.0, 50.0


def sliding_windows(samples: DataFrame, window: int = 1000, hop: int = 250) -> DataFrame:
    """SP1: (session_id, win_id, start_idx, ts, n) of each full window; window w starts at sample w * hop.

    The readable form: each sample goes to all its windows. window_features doesn't do that.
    """
    last = F.floor(F.col("sample_idx") / hop)
    first = F.greatest(F.ceil((F.col("sample_idx") - window + 1) / hop), F.lit(0))
    wins = samples.filter(last >= first).select(
        "session_id", "ts", F.explode(F.sequence(first, last)).alias("win_id")
    )
    return (
        wins.groupBy("session_id", "win_id")
        .agg(F.max("ts").alias("ts"), F.count("*").alias("n"))
        .filter(F.col("n") == window)
        .withColumn("start_idx", F.col("win_id") * hop)
    )


def welch_frequencies(fs: float, n_fft: int) -> tuple[np.ndarray, np.ndarray]:
    """All frequencies of a transform, and which are kept."""
    f = np.fft.rfftfreq(n_fft, 1 / fs)
    return f, (f >= F_MIN) & (f <= F_MAX)


def welch_psd(segments: np.ndarray, fs: float) -> np.ndarray:
    """SP2: one-sided power density of segments (..., n_fft), with a periodic Hamming window and means removed."""
    n = segments.shape[-1]
    taper = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n)
    spectrum = np.fft.rfft((segments - segments.mean(axis=-1, keepdims=True)) * taper, axis=-1)
    power = (spectrum.real**2 + spectrum.imag**2) / (fs * (taper**2).sum())
    power[..., 1 : None if n % 2 else -1] *= 2
    return power


def band_means(freqs: np.ndarray, power: np.ndarray) -> list[np.ndarray]:
    """SP4 in numpy: trapezoids over the bins of a band, divided by the band's nominal width."""
    out = []
    for _, low, high in BANDS:
        inside = (freqs >= low) & (freqs < high)
        f, p = freqs[inside], power[..., inside]
        out.append(((p[..., 1:] + p[..., :-1]) / 2 * np.diff(f)).sum(axis=-1) / (high - low))
    return out


def _psd_at(data: np.ndarray, at: np.ndarray, fs: float, window: int, n_fft: int) -> np.ndarray:
    """SP2 and SP3 of the windows that begin at places of data (channels x samples): each segment is transformed once."""
    starts = at[:, None] + np.arange(window // n_fft) * n_fft
    unique, inverse = np.unique(starts, return_inverse=True)
    segments = data[:, unique[:, None] + np.arange(n_fft)]  # channels x segments x n_fft
    power = welch_psd(segments, fs).mean(axis=0)  # over channels
    return power[inverse.reshape(starts.shape)].mean(axis=1)


def _windows_of_block(fs: float, window: int, hop: int, n_fft: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    freqs, kept = welch_frequencies(fs, n_fft)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("sample_idx").sort_values("sample_idx")
        idx = rows["sample_idx"].to_numpy()
        block, size = int(rows["block"].iloc[0]), int(rows["size"].iloc[0])
        wins = np.arange(block * size, (block + 1) * size)
        at = np.searchsorted(idx, wins * hop)
        end = at + window - 1
        whole = end < len(idx)
        whole[whole] = (idx[at[whole]] == wins[whole] * hop) & (idx[end[whole]] == wins[whole] * hop + window - 1)
        wins, at, end = wins[whole], at[whole], end[whole]
        columns = ["session_id", "win_id", "ts", "psd", "theta", "alpha", "beta"]
        if not len(wins):
            return pd.DataFrame(columns=columns)
        data = np.stack(rows["ch"].to_numpy()).astype(np.float64).T  # channels x samples
        psd = _psd_at(data, at, fs, window, n_fft)[:, kept]
        theta, alpha, beta = band_means(freqs[kept], psd)
        return pd.DataFrame(
            {
                "session_id": rows["session_id"].iloc[0],
                "win_id": wins,
                "ts": rows["ts"].to_numpy()[end],
                "psd": list(psd),
                "theta": theta,
                "alpha": alpha,
                "beta": beta,
            }
        )

    return run


def window_features(
    samples: DataFrame, fs: float = FS, window: int = 1000, hop: int = 250, n_fft: int | None = None, wins_per_block: int = 240
) -> DataFrame:
    """SP1 to SP5: (session_id, win_id, ts, psd, theta, alpha, beta, vector) of each full window."""
    n_fft = n_fft or min(int(fs * 2), window)
    step = wins_per_block * hop
    # Window w lies in block w / wins_per_block; the block's samples reach window - hop beyond its last start.
    first = F.greatest(F.floor((F.col("sample_idx") - window + hop) / step), F.lit(0))
    dealt = samples.select(
        "session_id",
        "sample_idx",
        "ts",
        "ch",
        F.lit(wins_per_block).alias("size"),
        F.explode(F.sequence(first, F.floor(F.col("sample_idx") / step))).alias("block"),
    )
    kind, ts = (samples.schema[c].dataType.simpleString() for c in ("session_id", "ts"))
    schema = f"session_id {kind}, win_id long, ts {ts}, psd array<double>, theta double, alpha double, beta double"
    out = dealt.groupBy("session_id", "block").applyInPandas(_windows_of_block(fs, window, hop, n_fft), schema)
    return feature_vector(out)


def _windows_at_ends(fs: float, window: int, n_fft: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    freqs, kept = welch_frequencies(fs, n_fft)

    def run(rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        columns = ["session_id", "chunk", "end_idx", "ts", "psd", "theta", "alpha", "beta"]
        rows, ends = rows.drop_duplicates("sample_idx").sort_values("sample_idx"), ends.sort_values("end_idx")
        idx, last = rows["sample_idx"].to_numpy(), ends["end_idx"].to_numpy()
        at = np.searchsorted(idx, last - window + 1)
        whole = at + window - 1 < len(idx)
        whole[whole] = (idx[at[whole]] == last[whole] - window + 1) & (idx[at[whole] + window - 1] == last[whole])
        if not whole.any():
            return pd.DataFrame(columns=columns)
        at, data = at[whole], np.stack(rows["ch"].to_numpy()).astype(np.float64).T
        psd = _psd_at(data, at, fs, window, n_fft)[:, kept]
        theta, alpha, beta = band_means(freqs[kept], psd)
        found = {"session_id": ends["session_id"].iloc[0], "chunk": ends["chunk"].to_numpy()[whole], "end_idx": last[whole]}
        found |= {"ts": rows["ts"].to_numpy()[at + window - 1], "psd": list(psd), "theta": theta, "alpha": alpha, "beta": beta}
        return pd.DataFrame(found)

    return run


def chunk_features(
    samples: DataFrame, fs: float = FS, window: int = 1000, n_fft: int | None = None, block_samples: int = 60_000
) -> DataFrame:
    """SP1 to SP5 as samples arrive: (session_id, chunk, end_idx, ts, psd, theta, alpha, beta, vector), one row for each chunk.

    samples have the chunk that brought them. A chunk's window is the last `window` samples up to its last one; a chunk that comes
    before so many are there, or after a gap in them, gives nothing. Chunks may have any size. They meet the samples
    in the block in which their windows begin, and only the halo of a block is copied.
    """
    n_fft = n_fft or min(int(fs * 2), window)
    size = F.lit(block_samples)
    ends = samples.groupBy("session_id", "chunk").agg(F.max("sample_idx").alias("end_idx")).filter(F.col("end_idx") >= window - 1)
    ends = ends.select(*(F.col(c).alias(c) for c in ends.columns)).withColumn("block", F.floor((F.col("end_idx") - window + 1) / size))
    first = F.greatest(F.floor((F.col("sample_idx") - window + 1) / size), F.lit(0))
    dealt = samples.select("session_id", "sample_idx", "ts", "ch", F.explode(F.sequence(first, F.floor(F.col("sample_idx") / size))).alias("block"))
    kinds = {c: samples.schema[c].dataType.simpleString() for c in ("session_id", "chunk", "ts")}
    schema = f"session_id {kinds['session_id']}, chunk {kinds['chunk']}, end_idx long, ts {kinds['ts']}, psd array<double>, theta double, alpha double, beta double"
    groups = dealt.groupBy("session_id", "block").cogroup(ends.groupBy("session_id", "block"))
    return feature_vector(groups.applyInPandas(_windows_at_ends(fs, window, n_fft), schema))


def psd_long(features: DataFrame, fs: float = FS, n_fft: int = 500) -> DataFrame:
    """SP3: (session_id, win_id, freq, power), one row for each bin of the mean density."""
    freqs, kept = welch_frequencies(fs, n_fft)
    names = F.array(*[F.lit(float(f)) for f in freqs[kept]])
    pairs = F.arrays_zip(names.alias("freq"), F.col("psd").alias("power"))
    return features.select("session_id", "win_id", F.inline(pairs)).toDF("session_id", "win_id", "freq", "power")


def band_power(features: DataFrame, fs: float = FS, n_fft: int = 500) -> DataFrame:
    """SP4: (session_id, win_id, theta, alpha, beta) from (session_id, win_id, psd), the mean densities.

    A trapezoid rule is a sum of the bins by fixed weights, so each window's powers come from its own row.
    """
    freqs, kept = welch_frequencies(fs, n_fft)
    bins = int(kept.sum())
    columns = []
    for (name, _, _), weights in zip(BANDS, band_means(freqs[kept], np.eye(bins)), strict=True):
        terms = F.zip_with("psd", F.array(*[F.lit(float(x)) for x in weights]), lambda p, x: p * x)
        columns.append(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x).alias(name))
    return features.select("session_id", "win_id", *columns)


def band_power_long(psd: DataFrame) -> DataFrame:
    """SP4 of the long form (session_id, win_id, freq, power), whose bins are shuffled to their windows."""
    band = F.lit(None).cast("string")
    width = F.lit(None).cast("double")
    for name, low, high in BANDS:
        inside = (F.col("freq") >= low) & (F.col("freq") < high)
        band, width = F.when(inside, name).otherwise(band), F.when(inside, high - low).otherwise(width)
    rows = psd.withColumns({"band": band, "width": width}).filter(F.col("band").isNotNull())
    w = Window.partitionBy("session_id", "win_id", "band").orderBy("freq")
    area = (F.col("power") + F.lead("power").over(w)) / 2 * (F.lead("freq").over(w) - F.col("freq")) / F.col("width")
    rows = rows.withColumn("area", F.coalesce(area, F.lit(0.0)))
    return rows.groupBy("session_id", "win_id").agg(
        *[F.sum(F.when(F.col("band") == name, F.col("area"))).alias(name) for name, _, _ in BANDS]
    )


def feature_vector(df: DataFrame) -> DataFrame:
    """SP5: the three powers as a vector."""
    return df.withColumn("vector", F.array("theta", "alpha", "beta"))


def average_reference(samples: DataFrame) -> DataFrame:
    """TR1: subtract the mean over channels from each sample."""
    mean = F.aggregate("ch", F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size("ch")
    return samples.withColumn("ch", F.transform("ch", lambda x: x.cast("double") - mean))


def zero_phase_gain(n: int, fs: float, low: float, high: float, order: int) -> np.ndarray:
    """Squared magnitude of a digital Butterworth band-pass, the gain of filtering forward and backward."""
    warp = lambda f: np.tan(np.pi * np.minimum(f, fs / 2 * (1 - 1e-9)) / fs)
    at, a, b = warp(np.fft.rfftfreq(n, 1 / fs)), warp(low), warp(high)
    with np.errstate(divide="ignore", over="ignore"):
        return 1 / (1 + ((at**2 - a * b) / (at * (b - a))) ** (2 * order))
