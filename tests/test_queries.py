"""Every query of the library gives the rows of its SQL."""

from decimal import ROUND_HALF_EVEN, Decimal

import duckdb
import numpy as np
import pandas as pd
import pytest
from compare import same

from brainstate.plans import log_queries, state_queries

QUERIES = state_queries.QUERIES | log_queries.QUERIES
SQL = state_queries.SQL | log_queries.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, name):
    same(QUERIES[name](spark, small), SQL[name], small)


def test_trials_of_all_cues(spark, small):
    """All four movements, and trials whose base has no variance."""
    trials = QUERIES["tr6_trial_features"](spark, small).collect()
    assert {r.label for r in trials} == {"左手", "右手", "双脚", "舌头"}
    assert any(x > 20 for r in trials for x in r.vector_log)  # 1e-10 is the base
    whole = {(r.session_id, r.trial_id) for r in trials}
    for name in ("tr4_epoch_variance", "tr5_erd_percent", "tr7_trial_report"):
        assert {(r.session_id, r.trial_id) for r in QUERIES[name](spark, small).collect()} == whole


def test_nearest_of_all_trials(spark, small):
    vectors = {}
    for r in log_queries.tr.trial_features(log_queries._erd(spark, small)).collect():
        vectors.setdefault(r.session_id, {})[r.trial_id] = np.array(r.vector)
    for r in QUERIES["tr7_trial_report"](spark, small).collect():
        v = vectors[r.session_id][r.trial_id]
        past = {i: x for i, x in vectors[r.session_id].items() if i < r.trial_id and x.any()} if v.any() else {}
        distances = {i: 1 - v @ x / (np.linalg.norm(v) * np.linalg.norm(x)) for i, x in past.items()}
        assert (r.no_memory is not None) == (not past)
        if past:
            assert distances[r.past_id] == pytest.approx(min(distances.values()), abs=2e-9)


def test_display_round_of_all_events(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet").collect()
    exact = {r.event_id: float((Decimal(str(r.value)) * 3).quantize(Decimal("0.1"), ROUND_HALF_EVEN)) for r in events}
    assert {r.event_id: r.shown for r in QUERIES["dw5_display_round"](spark, small).collect()} == exact


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_recording_is_broadcast(spark, small):
    """Small files of long recordings look like small tables."""
    assert "Broadcast" not in QUERIES["io2_read_recording"](spark, small)._jdf.queryExecution().executedPlan().toString()


def test_two_decimals_of_large_changes(spark):
    """Near ties of large doubles go as in SQL."""
    whole = np.random.default_rng(5).integers(10**8, 10**9, 4000) + 0.005 * np.random.default_rng(6).integers(0, 200, 4000)
    values = pd.DataFrame({"trial_id": range(12000), "x": np.concatenate([whole, np.nextafter(whole, 0), -np.nextafter(whole, 1e9)])})
    rows = spark.createDataFrame(values).selectExpr("1L as session_id", "trial_id", "'l' as label", "x as c3_erd", "x / 1e8 as cz_erd", "x as c4_erd")
    got = log_queries.tr.trial_features(rows).toPandas().sort_values("trial_id")
    sql = duckdb.sql("select round_even(x, 2) as c3, round_even(x / 1e8, 2) as cz from values order by trial_id").df()
    assert (got["c3_erd"].to_numpy() == sql["c3"].to_numpy()).all() and (got["cz_erd"].to_numpy() == sql["cz"].to_numpy()).all()


def test_variances_of_rows_in_any_order(spark):
    """The last bits don't depend on how rows are dealt."""
    x = np.random.default_rng(7).normal(100, 1, 3000)
    rows = pd.DataFrame({"session_id": 1, "trial_id": np.arange(3000) % 30, "label": "l", "epoch": np.where(np.arange(3000) % 4 < 2, "base", "task"), "sample_idx": np.arange(3000), "t": np.arange(3000) / 9.0, "c3": x, "cz": x * 2, "c4": x * x})
    results = []
    for order in (rows, rows[::-1], rows.sample(frac=1, random_state=1)):
        made = log_queries.tr.epoch_variance(spark.createDataFrame(order).repartition(3)).toPandas()
        results.append(made.sort_values("trial_id").to_numpy().tolist())
    assert results[0] == results[1] == results[2]
    one = rows[(rows.trial_id == 3) & (rows.epoch == "task")]
    assert results[0][3][6] == pytest.approx(one.c3.var(ddof=0), rel=1e-12)
