"""Timestamps against Python's own zone data, and every edge case of the operator."""

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from dispatchline.operators.timestamps import normalise_timestamps

FEEDS = [(1, "a", "Europe/London", "dmy"), (5, "b", "America/New_York", "mdy"), (6, "c", "Asia/Kolkata", "dmy"), (7, "d", "Australia/Adelaide", "dmy"), (8, "e", "Europe/Dublin", None)]
UTC = timezone.utc


def run(spark, rows, feeds=FEEDS):
    m = spark.createDataFrame([(i, t, f, w) for i, (t, f, w) in enumerate(rows)], "row_id bigint, received_at string, feed_id int, created_at timestamp")
    f = spark.createDataFrame(feeds, "feed_id int, feed_name string, zone_name string, date_order string")
    return {r.row_id: r for r in normalise_timestamps(m, f).collect()}


def micros(t):
    return (t - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def test_round_trip_over_formats_and_zones(spark):
    rng, rows, want = random.Random(3), [], []
    for feed, _, name, order in FEEDS[:4]:
        zone = ZoneInfo(name)
        for _ in range(60):
            at = datetime(2025, 1, 1, tzinfo=UTC) + timedelta(seconds=rng.randrange(36_000_000), microseconds=rng.randrange(10**6))
            local = at.astimezone(zone)
            wall = local.replace(tzinfo=None)
            folds = {wall.replace(tzinfo=zone, fold=k).astimezone(UTC) for k in (0, 1)}
            once = len(folds) == 1
            d, m = (local.day, local.month) if order == "dmy" else (local.month, local.day)
            second, minute = at.replace(microsecond=0), at.replace(microsecond=0, second=0)
            milli = at.replace(microsecond=at.microsecond // 1000 * 1000)
            sign = local.strftime("%z")
            for text, result, needs in [
                (local.strftime("%Y-%m-%dT%H:%M:%S.%f") + sign, at, True),
                (local.strftime("%Y-%m-%d %H:%M:%S ") + sign[:3] + ":" + sign[3:], second, True),
                (local.strftime("%a, %d %b %Y %H:%M:%S ") + local.tzname(), second, True),
                (local.strftime("%Y-%m-%dT%H:%M:%S") + sign[:3] + ":" + sign[3:] + f"[{name}]", second, True),
                (at.strftime("%Y%m%dT%H%M%SZ"), second, True),
                (str(micros(at) // 1000), milli, True),
                (str(micros(at)), at, True),
                (f"{micros(at) // 10**6}.0", second, True),
                (f"{d}/{m}/{local.year} {local.strftime('%I:%M %p').lstrip('0')}", minute, once),
                (f"\t{d}.{m}.{local.year % 100} {local.strftime('%H:%M:%S')} ", second, once),
                (f"{local.strftime('%B')} {local.day}, {local.year} {local.strftime('%I:%M').lstrip('0')} {'a.m.' if local.hour < 12 else 'p.m.'}", minute, once),
                (f"{local.day} {local.strftime('%b')} {local.year}, {local.strftime('%H:%M')}", minute, once),
                (local.strftime("%Y-%m-%d %H:%M:%S,%f"), at, once),
            ]:
                if needs:
                    rows.append((text, feed, at))
                    want.append(micros(result))
    got = run(spark, rows)
    assert [(rows[i][0], got[i].utc_us) for i in range(len(rows))] == [(rows[i][0], want[i]) for i in range(len(rows))]


@pytest.mark.parametrize(
    ("text", "feed", "status"),
    [
        (None, 1, "unreadable"), ("", 1, "unreadable"), ("yesterday", 1, "unreadable"), ("2026-04-31 12:30", 1, "unreadable"), ("0000-00-00 00:00:00", 1, "unreadable"), ("31/02/2026 10:04:00", 1, "unreadable"),
        ("12/25/2025 10:00:00", 1, "unreadable"), ("2025-13-05T09:12:00", 1, "unreadable"), ("25:61", 1, "unreadable"), ("x" * 100_000, 1, "unreadable"), ("13:00 PM", 1, "unreadable"), ("1/2/2025 13:00 PM", 1, "unreadable"),
        ("2025-10-26 01:30", 1, "ambiguous_fold"), ("2025-03-30 01:30", 1, "nonexistent"), ("2025-11-02 01:30", 5, "ambiguous_fold"), ("2025-06-01 10:00 XYZ", 1, "unknown_zone"), ("2025-06-01 10:00", 99, "unknown_zone"), ("2025-06-01 10:00", None, "unknown_zone"),
    ],
)
def test_what_denotes_no_instant(spark, text, feed, status):
    r = run(spark, [(text, feed, datetime(2025, 6, 1))])[0]
    assert (r.status, r.utc_us) == (status, None)


def test_marks_decide_and_letters_follow_the_feed(spark):
    at = datetime(2025, 7, 1, 12)
    got = run(spark, [("2025-10-26 01:30+01:00", 1, at), ("2025-07-01 12:00:00 IST", 6, at), ("2025-07-01 12:00:00 IST", 8, at), ("2025-07-01 12:00 UTC", 99, at), ("1751371200", None, at)])
    assert [got[i].utc_us for i in range(5)] == [micros(datetime(2025, 10, 26, 0, 30, tzinfo=UTC)), micros(datetime(2025, 7, 1, 6, 30, tzinfo=UTC)), micros(datetime(2025, 7, 1, 11, tzinfo=UTC)), micros(datetime(2025, 7, 1, 12, tzinfo=UTC)), 1751371200 * 10**6]


def test_order_is_learned_where_none_is_declared(spark):
    rows = [(f"{m}/{d}/2025 10:00:00", 8, datetime(2025, m, d, 11)) for m in (2, 3, 4, 6) for d in (5, 14, 20, 27)]
    got = run(spark, rows)
    assert all(got[i].status == "resolved" and got[i].utc_us == micros(datetime(2025, m, d, 10, tzinfo=ZoneInfo("Europe/Dublin")).astimezone(UTC)) for i, (m, d) in enumerate((m, d) for m in (2, 3, 4, 6) for d in (5, 14, 20, 27)))


def test_the_fit_decides_and_can_outvote_a_declared_order(spark):
    at = datetime(2025, 7, 1)
    rows = [(f"{m}/{d}/2025 10:00:00", 1, datetime(2025, m, d, 11)) for m in range(1, 13) for d in range(13, 29)]
    rows += [("2/11/2025 10:00:00", 1, datetime(2025, 2, 11, 11)), ("5/6/2025 10:00:00", 1, datetime(2025, 7, 1)), ("2025-05-06 10:00:00", 1, datetime(2025, 7, 1)), ("2/11/2025 10:00:00", 2, datetime(2025, 2, 11, 11))]
    m = spark.createDataFrame([(i, t, f, w) for i, (t, f, w) in enumerate(rows)], "row_id bigint, received_at string, feed_id int, created_at timestamp")
    f = spark.createDataFrame([(1, "a", "Europe/London", "dmy"), (2, "b", "Europe/London", "dmy")], "feed_id int, feed_name string, zone_name string, date_order string")
    fitted, unfitted = ({r.row_id: r for r in normalise_timestamps(m, f, steps=n).collect()} for n in (40, 0))
    n = len(rows)
    month_first, day_first = micros(datetime(2025, 2, 11, 10, tzinfo=UTC)), micros(datetime(2025, 11, 2, 10, tzinfo=UTC))
    assert (fitted[n - 4].utc_us, unfitted[n - 4].utc_us) == (month_first, day_first)
    assert (fitted[n - 3].status, unfitted[n - 3].utc_us) == ("ambiguous_order", micros(datetime(2025, 6, 5, 9, tzinfo=UTC)))
    assert fitted[0].utc_us == micros(datetime(2025, 1, 13, 10, tzinfo=UTC)) and unfitted[0].status == "unreadable"
    assert fitted[n - 2].utc_us == unfitted[n - 2].utc_us == micros(datetime(2025, 5, 6, 9, tzinfo=UTC))
    assert unfitted[n - 1].utc_us == day_first and fitted[n - 1].utc_us != month_first


def test_too_many_zones_are_refused(spark):
    with pytest.raises(ValueError, match="zones"):
        run(spark, [("2025-06-01 10:00", 1, datetime(2025, 6, 1))], [(i, "x", f"Zone/{i}", "dmy") for i in range(1001)])


def test_order_stays_open_without_evidence(spark):
    assert run(spark, [("5/6/2025 10:00:00", 8, datetime(2026, 1, 1))])[0].status == "ambiguous_order"


def test_empty_table_repeated_rows_and_clashing_columns(spark):
    assert run(spark, []) == {}
    m = spark.createDataFrame([(1, "2025-06-01 10:00", 1, datetime(2025, 6, 1), "x", 3)] * 2, "row_id bigint, received_at string, feed_id int, created_at timestamp, zone string, wall int")
    f = spark.createDataFrame(FEEDS, "feed_id int, feed_name string, zone_name string, date_order string").withColumn("row_id", F.lit(1))
    assert [r.status for r in normalise_timestamps(m, f).collect()] == ["resolved", "resolved"]
