"""Minutes between events, by the known cases of gaps, midnight and overlap."""

from datetime import datetime, timedelta

import pytest

from recollect.operators import activity as act

DAY = datetime(2026, 8, 11, 9)


def events(spark, **sessions):
    rows = [(name, i, DAY + timedelta(minutes=m)) for name, minutes in sessions.items() for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, "session_id string, id long, created_at timestamp_ntz")


@pytest.mark.parametrize("minutes, total", [([0, 10, 20], 20), ([0, 10, 120, 125], 15), ([0], 0), ([], 0), ([0, 30], 30), ([0, 31], 0), ([0.75 * i for i in range(200)], 149)])
def test_total(spark, minutes, total):
    got = act.total_minutes(events(spark, a=minutes), ["session_id"]).collect()
    assert (got[0].minutes if got else 0) == total


def test_overlapping_sessions_count_once_when_merged(spark):
    e = events(spark, main=[0, 10, 20], fork=[5, 15])
    assert {r.session_id: r.minutes for r in act.total_minutes(e, ["session_id"]).collect()} == {"main": 20, "fork": 10}
    assert act.total_minutes(e, []).first().minutes == 20


def test_split_at_midnight(spark):
    e = events(spark, a=[14 * 60 + 50, 15 * 60 + 10])
    assert {r.day: r.minutes for r in act.daily_minutes(e, []).collect()} == {"2026-08-11": 10, "2026-08-12": 10}


def test_range_and_single_event_session(spark):
    e = events(spark, long=[-20, 0, 10], one=[5])
    sessions = spark.createDataFrame([("long", "p"), ("one", "p"), ("idle", "p")], "id string, project string")
    got = {r.session_id: (r.day, r.minutes) for r in act.timesheet(sessions, e, "2026-08-11 09:00:00", "2026-08-12").collect()}
    assert got == {"long": ("2026-08-11", 10), "one": ("2026-08-11", 0)}


def test_trailing_window_leaves_its_far_end_out(spark):
    e = events(spark, a=[0, 1, 2])
    assert [r.in_window for r in act.trailing_count(e, ["session_id"], 120).orderBy("id").collect()] == [1, 2, 2]


def test_limits_of_calls_without_a_key(spark):
    from datetime import datetime, timedelta

    at = datetime(2026, 3, 1)
    calls = [(None if i % 2 else "a", i, at + timedelta(minutes=20 * (i // 2))) for i in range(40)]
    frame = spark.createDataFrame(calls, "session_id string, id long, created_at timestamp_ntz")
    got = {r.id: r.admitted for r in act.rate_limited(frame, ["session_id"], 2, 3600).collect()}
    assert len(got) == 40 and all(got[i] == got[i + 1] for i in range(0, 40, 2)) and sum(got.values()) == 2 * sum(got[i] for i in range(0, 40, 2)) < 40


def test_limits_of_very_many_calls_in_one_window(spark):
    """A window with all of 300,000 calls: neither their counts nor what is followed grows with its square."""
    frame = spark.range(300_000).selectExpr("'a' AS session_id", "id", "TIMESTAMP_NTZ '2026-03-01 00:00:00' + (id * 7919 % 300000) * INTERVAL '1' SECOND AS created_at")
    got = [r.s for r in act.rate_limited(frame, ["session_id"], 3, 86_400).filter("admitted").selectExpr("id * 7919 % 300000 AS s").orderBy("s").collect()]
    assert got == [k * 86_400 + i for k in range(4) for i in range(3)]
    assert act.rate_limited(frame, ["session_id"], 3, 86_400).count() == 300_000
