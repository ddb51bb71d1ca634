"""Dashboard series by ranges against the window forms and plain loops."""

import datetime as dt
import math
import random

import pytest

from brainstate.operators import dashboard, dashboard_ranges
from brainstate.sources.ranges import offsets, ranked

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "session_id string, ts timestamp, poll_no long, v double, w double, range string, place string, before string"


def points(seed, sizes):
    """Sessions of given sizes, one of them without an id; v and w are null at times, times differ."""
    draw = random.Random(seed)
    value = lambda: None if draw.random() < 0.4 else float(draw.randint(-3, 9))
    rows = []
    for session, size in sizes.items():
        at = draw.sample(range(1, 4 * size + 1), size)
        rows += [(session, START + dt.timedelta(milliseconds=700 * a), a, value(), value(), f"r{a}", "p", "b") for a in at]
    draw.shuffle(rows)
    return rows


def key(row):
    return tuple((x is not None, x) for x in row)


def rounded(rows):
    out = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows]
    return sorted(out, key=key)


@pytest.fixture(scope="module")
def given(spark):
    rows = points(7, {"long": 400, "short": 3, "one": 1, None: 90})
    return rows, spark.createDataFrame(rows, SCHEMA)


def sessions(rows):
    found = {}
    for r in sorted(rows, key=lambda r: r[1]):
        found.setdefault(r[0], []).append(r)
    return found.values()


@pytest.mark.parametrize("ranges, block", [(1, 65_536), (5, 60), (23, 7)])
def test_rolling_mean(given, ranges, block):
    rows, df = given
    got = dashboard_ranges.rolling_mean(df, "v", n=7, block=block, ranges=ranges)
    assert got.columns == [*df.columns, "points", "mean"]
    expected = []
    for of in sessions(rows):
        for i, r in enumerate(of):
            near = [x[3] for x in of[max(0, i - 6) : i + 1] if x[3] is not None]
            expected.append((*r, len(near), math.fsum(near) / len(near) if near else None))
    clean = lambda rs: rounded((r[0], r[2], *r[-2:]) for r in rs)
    assert clean(got.collect()) == clean(expected)


def test_rolling_mean_of_more_hops_than_a_block(given):
    rows, df = given
    got = dashboard_ranges.rolling_mean(df, "v", n=50, block=3, ranges=9)
    whole = dashboard.rolling_mean(df, "v", n=50)
    assert rounded(got.select("poll_no", "session_id", "points", "mean").collect()) == rounded(whole.select("poll_no", "session_id", "points", "mean").collect())


@pytest.mark.parametrize("ranges", [1, 6, 31])
def test_other_series_by_ranges(given, ranges):
    rows, df = given
    same = lambda a, b: (a.columns, rounded(a.collect())) == (b.columns, rounded(b.collect()))
    assert same(dashboard_ranges.carry_forward(df, ["v", "w"], ranges=ranges), dashboard.carry_forward(df, ["v", "w"]))
    assert same(dashboard_ranges.poll_metrics(df, ["v", "w"], ranges=ranges), dashboard.poll_metrics(df, ["v", "w"]))
    assert same(dashboard_ranges.new_events_only(df, stamp="v", ranges=ranges), dashboard.new_events_only(df, stamp="v"))


def test_carry_forward_and_new_events_by_plain_loops(given):
    rows, df = given
    carried, fresh = [], []
    for of in sessions(rows):
        last, seen = None, None
        for r in of:
            last = r[3] if r[3] is not None else last
            carried.append((r[0], r[2], last))
            own = r[3] if r[3] is not None else 0.0
            if own > (seen if seen is not None else 0.0):
                fresh.append((r[0], r[2]))
            seen = own if seen is None else max(seen, own)
    got = dashboard_ranges.carry_forward(df, ["v"], ranges=8).select("session_id", "poll_no", "v").collect()
    assert rounded(got) == rounded(carried)
    got = dashboard_ranges.new_events_only(df, stamp="v", ranges=8).select("session_id", "poll_no").collect()
    assert rounded(got) == rounded(fresh)


def test_a_long_session_spreads_over_ranges(given):
    _, df = given
    parts = offsets(ranked(df.drop("range", "place"), "spread", "session_id", "ts", ranges=8), "session_id").collect()
    of = [r for r in parts if r.session_id == "long"]
    assert len(of) > 4 and {r.n for r in of} == {400}
    assert sorted(r.before for r in of)[0] == 0


def test_equal_times_and_empty_tables(spark, given):
    _, df = given
    none = df.filter("false")
    assert dashboard_ranges.rolling_mean(none, "v").count() == 0
    assert dashboard_ranges.carry_forward(none, ["v"]).count() == 0
    assert dashboard_ranges.poll_metrics(none, ["v"]).count() == 0
    assert dashboard_ranges.new_events_only(none, stamp="v").count() == 0
    ties = spark.createDataFrame([("a", START, i, 1.0, None, "", "", "") for i in range(300)], SCHEMA)
    got = dashboard_ranges.rolling_mean(ties, "v", n=60, block=60, ranges=4).collect()
    assert sorted(r.points for r in got) == sorted(min(i + 1, 60) for i in range(300))
