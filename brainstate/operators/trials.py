"""Trials of recorded sessions: cues, epochs and ERD features (PF1 to PF5, TR3 to TR7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cue codes and their labels, channel places from 0, and epochs in seconds around a cue.
CUE_LABELS = {"769": "左手", "770": "右手", "771": "双脚", "772": "舌头"}
CHANNELS = {"c3": 7, "cz": 9, "c4": 11}
EPOCHS = {"base": (-1.5, -0.5), "task": (0.5, 4.0)}
EPS = 1e-10
NO_MEMORY = "No past memory available."


def filter_cues(cues: DataFrame) -> DataFrame:
    """PF1: the cues of the four movements."""
    return cues.filter(F.col("code").isin(*CUE_LABELS))


def label_cues(cues: DataFrame) -> DataFrame:
    """PF2: label of each cue's code; null for other codes."""
    pairs = [F.lit(x) for pair in CUE_LABELS.items() for x in pair]
    return cues.withColumn("label", F.try_element_at(F.create_map(*pairs), F.col("code")))


def number_trials(cues: DataFrame, order: str = "sample_idx") -> DataFrame:
    """PF3: trial_id from 0 in order of onset within a session."""
    w = Window.partitionBy("session_id").orderBy(order)
    return cues.withColumn("trial_id", F.row_number().over(w) - 1)


def pick_trials(trials: DataFrame, wanted: DataFrame) -> DataFrame:
    """PF3: the trials that wanted (session_id, trial_id) asks for; ids that don't exist give no row."""
    return trials.join(wanted, ["session_id", "trial_id"], "left_semi")


def onset_seconds(cues: DataFrame, fs: float = 250.0) -> DataFrame:
    """PF4: onset in seconds."""
    return cues.withColumn("onset", F.col("sample_idx") / F.lit(fs))


def pick_channels(samples: DataFrame, channels: dict[str, int] | None = None) -> DataFrame:
    """PF5: columns c3, cz and c4 of the channel array."""
    return samples.withColumns({k: F.get("ch", F.lit(i)) for k, i in (channels or CHANNELS).items()})


def epoch_join(
    cues: DataFrame, samples: DataFrame, epochs: dict[str, tuple[float, float]] | None = None, bucket: float = 4.0
) -> DataFrame:
    """TR3: samples (session_id, t, ...) of each cue's (session_id, trial_id, onset, ...) epochs, ends included.

    A range join as an equi-join: epochs are spread over time buckets, a few for each, and only samples of
    the same session and bucket are compared.
    """
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("epoch"), (F.col("onset") + a).alias("t0"), (F.col("onset") + b).alias("t1"))
            for k, (a, b) in (epochs or EPOCHS).items()
        ]
    )
    at = lambda t: F.floor(F.col(t) / F.lit(bucket))
    spread = cues.select("*", F.inline(rows)).withColumn("bucket", F.explode(F.sequence(at("t0"), at("t1"))))
    cut = samples.withColumn("bucket", at("t")).join(spread, ["session_id", "bucket"])
    return cut.filter(F.col("t").between(F.col("t0"), F.col("t1"))).drop("bucket", "t0", "t1")


def _variance(held: Column, channel: str) -> Column:
    """Population variance of a field of an array's elements, nulls left out, summed in the array's order."""
    state = lambda n, mean, squares: F.struct(n.alias("n"), mean.alias("mean"), squares.alias("squares"))

    def add(s: Column, sample: Column) -> Column:
        x = sample[channel]
        mean = s["mean"] + (x - s["mean"]) / (s["n"] + 1)
        return F.when(x.isNull(), s).otherwise(state(s["n"] + 1, mean, s["squares"] + (x - mean) * (x - s["mean"])))

    zero = F.lit(0.0)
    return F.aggregate(held, state(zero, zero, zero), add, lambda s: F.try_divide(s["squares"], s["n"]))


def epoch_variance(cut: DataFrame) -> DataFrame:
    """TR4: population variance of each channel in both epochs of a trial; a trial needs samples in both.

    Samples are summed in the order of time (and sample_idx, if they have it), so that the last bits don't depend on how rows are dealt.
    """
    order = ["t", *(c for c in ("sample_idx",) if c in cut.columns)]
    sample = F.struct(*order, *[F.col(c).cast("double").alias(c) for c in CHANNELS])
    of = lambda e, x: F.when(F.col("epoch") == e, x)
    held = cut.groupBy("session_id", "trial_id", "label").agg(
        *[F.count(of(e, F.col("c3"))).alias(f"n_{e}") for e in EPOCHS], *[F.sort_array(F.collect_list(of(e, sample))).alias(e) for e in EPOCHS]
    )
    columns = [_variance(F.col(e), c).alias(f"{e}_{c}") for e in EPOCHS for c in CHANNELS]
    return held.filter(" and ".join(f"n_{e} > 0" for e in EPOCHS)).select("session_id", "trial_id", "label", *columns)


def erd_percent(variances: DataFrame, eps: float = EPS) -> DataFrame:
    """TR5: change from base to task in percent. eps is in squared units of the samples."""
    change = {
        f"{c}_erd": (F.col(f"task_{c}") - F.col(f"base_{c}")) / (F.col(f"base_{c}") + F.lit(eps)) * 100
        for c in CHANNELS
    }
    return variances.withColumns(change)


def half_even(x: Column, places: int) -> Column:
    """A double with so many decimals, as numpy and SQL engines round: the nearest whole multiple, ties to even."""
    scale = F.lit(10.0**places)
    return F.rint(x * scale) / scale


def trial_features(erd: DataFrame) -> DataFrame:
    """TR6: label, ERDs with two decimals, and the vector of the unrounded ones."""
    names = [f"{c}_erd" for c in CHANNELS]
    vector = F.array(*names).alias("vector")
    return erd.select("session_id", "trial_id", "label", *[half_even(F.col(n), 2).alias(n) for n in names], vector)


def trial_report(trials: DataFrame, nearest: DataFrame) -> DataFrame:
    """TR7: each trial with the one that nearest (session_id, trial_id, past_id, distance) found for it."""
    past = trials.select("session_id", F.col("trial_id").alias("past_id"), F.struct("label", "c3_erd", "cz_erd", "c4_erd").alias("past"))
    found = nearest.filter(F.col("past_id").isNotNull()).join(past, ["session_id", "past_id"])
    return trials.join(found, ["session_id", "trial_id"], "left").withColumn(
        "memory_text", F.coalesce(F.to_json("past"), F.lit(NO_MEMORY))
    )
