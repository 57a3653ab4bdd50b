from datetime import datetime, timedelta

import pytest

from cartlight.sources.starschema import event_schema, scan
from cartlight.streaming import realtime

FOLDER = "/root/testdata/sf0.001"
START, DAY = datetime(2025, 1, 1, 12), timedelta(days=1)


def test_all_days_equal_the_batch(spark, tmp_path):
    events = realtime.read_events(spark, f"{FOLDER}/events.parque[t]", event_schema())
    target = str(tmp_path / "days")
    realtime.write_daily_revenue(events, target, str(tmp_path / "state")).awaitTermination()
    got = {tuple(r) for r in realtime.read_days(spark, target).collect()}
    assert got and got == {tuple(r) for r in realtime.daily_revenue(scan(spark, FOLDER, "events")).collect()}


def _arrive(spark, source, rows):
    frame = spark.createDataFrame(
        [(i, ts, 1, kind, value, None) for i, (ts, kind, value) in enumerate(rows)], event_schema())
    frame.coalesce(1).write.mode("append").parquet(source)


def test_files_that_arrive_later(spark, tmp_path):
    """A restarted query goes on where it stopped, and events count however late they come."""
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(*rows):
        _arrive(spark, source, rows)
        events = realtime.read_events(spark, source, event_schema())
        realtime.write_daily_revenue(events, target, state).awaitTermination()
        return sorted((str(r["day"]), r["purchases"], r["revenue"]) for r in realtime.read_days(spark, target).collect())

    assert arrive((START, "purchase", 10.0), (START, "view", 99.0)) == [("2025-01-01", 1, 10.0)]
    assert arrive((START + 9 * DAY, "purchase", 5.0)) == [("2025-01-01", 1, 10.0), ("2025-01-10", 1, 5.0)]
    assert arrive((START, "purchase", 0.004)) == [("2025-01-01", 2, 10.004), ("2025-01-10", 1, 5.0)]


@pytest.mark.parametrize("files", [None, 1, 1000])
def test_the_number_of_files_in_a_batch_changes_nothing(spark, tmp_path, files):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for days in (0, 10, 1, 2, 20):
        _arrive(spark, source, [(START + days * DAY, "purchase", 1.0)])
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    events = realtime.read_events(spark, source, event_schema(), files)
    realtime.write_daily_revenue(events, target, state).awaitTermination()
    assert sorted(r["day"].day for r in realtime.read_days(spark, target).collect()) == [1, 2, 3, 11, 21]
    assert spark.conf.get("spark.sql.shuffle.partitions") == partitions


def _deliver(spark, source, rows):
    frame = spark.createDataFrame([(i, ts, user, kind, value, None) for i, ts, user, kind, value in rows], event_schema())
    frame.coalesce(1).write.mode("append").parquet(source)


def test_repeated_events_count_once_also_after_a_restart(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        events = realtime.distinct_events(realtime.read_events(spark, source, event_schema()))
        realtime.write_daily_revenue(events, target, state).awaitTermination()
        return {str(r["day"]): (r["purchases"], r["revenue"]) for r in realtime.read_days(spark, target).collect()}

    _deliver(spark, source, [(1, START, 7, "purchase", 10.0), (1, START, 7, "purchase", 10.0), (2, START, 8, "purchase", 5.0)])
    assert run() == {"2025-01-01": (2, 15.0)}
    _deliver(spark, source, [(1, START, 7, "purchase", 10.0), (3, START + 40 * DAY, 7, "purchase", 1.0)])
    _deliver(spark, source, [(2, START, 8, "purchase", 5.0), (4, START, 8, "purchase", 0.5)])
    assert run() == {"2025-01-01": (3, 15.5), "2025-02-10": (1, 1.0)}
    assert run() == {"2025-01-01": (3, 15.5), "2025-02-10": (1, 1.0)}


def test_distinct_events_of_a_batch(spark):
    rows = [(1, START + DAY, 1, "view", 2.0, None), (1, START, 1, "view", 1.0, None), (None, START, 1, "a", 1.0, None), (None, START, 1, "b", 1.0, None)]
    got = realtime.distinct_events(spark.createDataFrame(rows, event_schema())).collect()
    assert sorted((r["event_id"] or 0, r["event_type"], r["value"]) for r in got) == [(0, "a", 1.0), (1, "view", 1.0)]


def test_sessions_over_restarts_equal_the_batch(spark, tmp_path):
    """Files come one by one, with repeats and a restart between them; a last event far later ends all sessions."""
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    minute, rows = timedelta(minutes=1), []
    for k in range(120):
        rows.append((k, START + (k * 7 % 120) * 4 * minute // 3 + (k // 40) * 200 * minute, k % 4, "purchase" if k % 3 else "view", 1.25))
    rows.sort(key=lambda r: r[1])
    parts = [rows[:50], rows[30:80] + rows[40:45], rows[70:]]
    last = [(1000, START + 30 * DAY, 99, "view", 0.0)]

    def run():
        events = realtime.read_events(spark, source, event_schema())
        realtime.write_sessions(realtime.user_sessions(events), target, state).awaitTermination()
        return sorted(tuple(r) for r in realtime.read_sessions(spark, target).collect())

    sizes = []
    for part in [*parts, last]:
        _deliver(spark, source, part)
        sizes.append(len(run()))
    frame = spark.createDataFrame([(i, ts, u, kind, v, None) for i, ts, u, kind, v in rows], event_schema())
    expected = sorted(tuple(r) for r in realtime.user_sessions(frame).collect())
    assert run() == expected and sizes == sorted(sizes) and sizes[0] < sizes[-1]
    plain = {}
    for _, ts, user, kind, value in rows:
        mine = plain.setdefault(user, [])
        if not mine or ts - mine[-1][1] >= 30 * minute:
            mine.append([ts, ts, 0, 0, 0.0])
        mine[-1][1] = ts
        mine[-1][2:] = [mine[-1][2] + 1, mine[-1][3] + (kind == "purchase"), mine[-1][4] + (value if kind == "purchase" else 0)]
    assert [(r[0], *r[3:]) for r in expected] == [(u, *s[2:]) for u in sorted(plain) for s in plain[u]]
