from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from vacantia.operators import timestamps as ts

CASES = [
    # value, zone, order, day, instant
    ("2024-02-03T04:05:06+02:00", None, None, "2024-02-03", "2024-02-03T02:05:06.000Z"),
    ("2024-02-03 04:05:06.987654-0330", None, None, "2024-02-03", "2024-02-03T07:35:06.987Z"),
    ("20240203T210229Z", "Asia/Tokyo", None, "2024-02-03", "2024-02-03T21:02:29.000Z"),
    ("20240229", "UTC", None, "2024-02-29", "2024-02-29T00:00:00.000Z"),
    ("1707212045314261", None, None, "2024-02-06", "2024-02-06T09:34:05.314Z"),
    ("1707212045314", None, None, "2024-02-06", "2024-02-06T09:34:05.314Z"),
    ("1707212045", None, None, "2024-02-06", "2024-02-06T09:34:05.000Z"),
    ("7/2/24, 4:04 PM", "Europe/Berlin", "DMY", "2024-02-07", "2024-02-07T15:04:00.000Z"),
    ("7/2/24, 12:04 AM", "America/New_York", "MDY", "2024-07-02", "2024-07-02T04:04:00.000Z"),
    ("2024-02-27 23:23:44 America/New_York", "UTC", None, "2024-02-27", "2024-02-28T04:23:44.000Z"),
    ("2024-02-27T23:23:44-05:00[America/New_York]", "UTC", None, "2024-02-27", "2024-02-28T04:23:44.000Z"),
    ("Mon, 8 Apr 2024 01:41:08 EDT", None, None, "2024-04-08", "2024-04-08T05:41:08.000Z"),
    ("21 août 2026", None, None, "2026-08-21", "2026-08-21T00:00:00.000Z"),
    ("4 de junio de 2024", None, None, "2024-06-04", "2024-06-04T00:00:00.000Z"),
    ("31. Dezember 2025", None, None, "2025-12-31", "2025-12-31T00:00:00.000Z"),
    ("March 22nd, 2025", None, None, "2025-03-22", "2025-03-22T00:00:00.000Z"),
    ("Oct 27, 2024 2:30 AM", "Europe/Berlin", None, "2024-10-27", "2024-10-27T00:30:00.000Z"),  # twice: the earlier one
    ("2024-03-31T02:30:00", "Europe/Berlin", None, "2024-03-31", "2024-03-31T01:30:00.000Z"),  # skipped: forward by the gap
    ("31/02/2025 14:28", None, "DMY", None, None),
    ("2025-13-40T02:54:00", None, None, None, None),
    ("2025-01-01T25:00:00", None, None, None, None),
    ("0000-00-00 00:00:00", None, None, None, None),
    ("yesterday at 16:42", None, None, None, None),
    ("", None, None, None, None),
    ("   ", None, None, None, None),
    (None, "UTC", "DMY", None, None),
    ("x" * 100_000, None, None, None, None),
    ("2024-01-01 10:00:00", "No/Where", None, "2024-01-01", None),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, *c[:3], "kept") for i, c in enumerate(CASES)], "i int, value string, zone string, ord string, __tsx string")
    got = ts.with_parsed(df, F.col("value"), "day", "micros", F.col("zone"), F.col("ord")).withColumn("text", ts.instant_text(F.col("micros"))).orderBy("i").collect()
    assert [(str(r.day) if r.day else None, r.text) for r in got] == [c[3:] for c in CASES]


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Asia/Kathmandu", "Australia/Sydney", "UTC"])
def test_every_hour_against_python(spark, zone):
    local = [datetime(2024, 1, 1) + timedelta(hours=7 * k) for k in range(1500)] + [datetime(2024, m, d, h, 30) for m, d in [(3, 31), (10, 27), (3, 10), (11, 3), (4, 7), (10, 6)] for h in range(4)]
    df = spark.createDataFrame([(i, x.strftime("%d.%m.%Y %H:%M")) for i, x in enumerate(local)], "i int, value string")
    got = [r.micros for r in ts.with_parsed(df, F.col("value"), "day", "micros", F.lit(zone)).orderBy("i").collect()]
    want = [int(x.replace(tzinfo=ZoneInfo(zone), fold=0).timestamp()) * 1_000_000 for x in local]
    assert got == want


def test_day_numbers_of_all_dates(spark):
    days = [datetime(1900, 1, 1, tzinfo=timezone.utc) + timedelta(days=k) for k in range(0, 109_000, 13)]
    df = spark.createDataFrame([(i, x.strftime("%Y%m%d")) for i, x in enumerate(days)], "i int, value string")
    got = [str(r.day) for r in ts.with_parsed(df, F.col("value"), "day", "micros").orderBy("i").collect()]
    assert got == [x.strftime("%Y-%m-%d") for x in days]


def test_empty_tables_and_repeats(spark):
    jobs = spark.createDataFrame([(1, "03/04/2025"), (1, "03/04/2025"), (2, None), (3, "2025-04-03")], "id bigint, posted_on string")
    posts = spark.createDataFrame([(7, "g", "4/3/25, 10:00"), (8, "unknown", "4/3/25, 10:00")], "id bigint, source_group string, message_date string")
    msgs = spark.createDataFrame([], "source_group string, source_message_id string, message_date string")
    groups = spark.createDataFrame([("g", "Europe/Berlin", "MDY")], "source_group string, tz_name string, date_order string")
    got = {tuple(r) for r in ts.found(jobs, posts, msgs, groups).collect()}
    assert got == {("jobs", "1", "2025-04-03"), ("job_postings", "7", "2025-04-03T08:00:00.000Z"), ("job_postings", "8", "2025-03-04T10:00:00.000Z")}


def test_padded_values_are_read(spark):
    df = spark.createDataFrame([(" " * 90 + "2024-01-01T10:00:00Z" + "\u00a0" * 5000,), ("2024-01-01T10:00:00Z" + " " * 50_000 + "x",)], "value string")
    assert [str(r.day) for r in ts.with_parsed(df, F.col("value"), "day", "micros").collect()] == ["2024-01-01", "None"]
