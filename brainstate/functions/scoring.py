"""Mental-state scores from band powers (CL1 to CL5), as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The states in the order that breaks ties, and the least score of a state.
STATES = ("calm", "fatigue", "focus", "happy", "distress")
NEUTRAL = "neutral"
MIN_SCORE = 0.4
BETA_WEIGHT = 3.5


def relative_power(df: DataFrame) -> DataFrame:
    """CL1: p_theta, p_alpha, p_beta, the share of each band."""
    total = F.col("theta") + F.col("alpha") + F.col("beta") + F.lit(1e-6)
    return df.withColumns({f"p_{b}": F.col(b) / total for b in ("theta", "alpha", "beta")})


def state_scores(df: DataFrame) -> DataFrame:
    """CL2: a raw score column for each state, from the shares."""
    t, a, b = (F.col(f"p_{x}") for x in ("theta", "alpha", "beta"))
    w = BETA_WEIGHT
    rules = {
        "calm": (a > 0.5, a),
        "fatigue": (t > 0.5, t),
        "focus": (b > 0.2, b * w),
        "happy": ((a > 0.3) & (b > 0.15), a * b * w * 2),
        "distress": ((t > 0.3) & (b > 0.15), t * b * w * 2),
    }
    return df.withColumns({k: F.when(test, value).otherwise(F.lit(0.0)) for k, (test, value) in rules.items()})


def pick_state(df: DataFrame) -> DataFrame:
    """CL3: label, the state with the largest score, the first of equals; neutral below the least score."""
    best = F.greatest(*STATES)
    label = F.when(best < MIN_SCORE, NEUTRAL)
    for s in STATES:
        label = label.when(F.col(s) == best, s)
    return df.withColumn("label", label)


def sharpen_scores(df: DataFrame) -> DataFrame:
    """CL4: the winner's score at most 1, the others' a fifth; neutral rows keep theirs."""

    def sharp(s: str) -> Column:
        x = F.col(s)
        return (
            F.when(F.col("label") == NEUTRAL, x)
            .when(F.col("label") == s, F.least(x, F.lit(1.0)))
            .otherwise(x * 0.2)
        )

    return df.withColumns({s: sharp(s) for s in STATES})


def state_indices(df: DataFrame) -> DataFrame:
    """CL5: the scores in percent."""
    return df.withColumns({f"{s}_idx": F.col(s) * 100 for s in STATES})


def classify(df: DataFrame, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """CL1 to CL5; or CL6, a model of the user's: a pandas UDF from vector to struct(label, the five scores)."""
    if model is None:
        return state_indices(sharpen_scores(pick_state(state_scores(relative_power(df)))))
    out = df.withColumn("made", model(F.col("vector")))
    return state_indices(out.withColumns({k: F.col(f"made.{k}") for k in ("label", *STATES)}).drop("made"))
