from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from mnemospark.functions.instants import add_instant, with_instant

CASES = [
    ("2025-07-23T17:28:06.722Z", None, None, "2025-07-23T17:28:06.722"),
    ("2025-07-23T17:28:06.123456789Z", None, None, "2025-07-23T17:28:06.123456"),
    ("2025-07-23t17:28:06z", None, None, "2025-07-23T17:28:06"),
    ("20250929T210537Z", None, None, "2025-09-29T21:05:37"),
    (" 2025-01-02 03:04:05 ", "Asia/Seoul", None, "2025-01-01T18:04:05"),
    ("2025-06-24 13:23:19,857", "Europe/Berlin", None, "2025-06-24T11:23:19.857"),
    ("2026-01-11T19:14:55.232897-03:30", "Asia/Seoul", None, "2026-01-11T22:44:55.232897"),
    ("2025-10-25T05:50:44+11:00[Australia/Sydney]", None, None, "2025-10-24T18:50:44"),
    ("1792265486", None, None, "2026-10-17T19:31:26"),
    ("1787397120.738", None, None, "2026-08-22T11:12:00.738"),
    ("1776513523392", None, None, "2026-04-18T11:58:43.392"),
    ("1742397589541090", None, None, "2025-03-19T15:19:49.541090"),
    ("1747136176 +0900", None, None, "2025-05-13T11:36:16"),
    ("03/04/2026 10:11:12", None, "dmy", "2026-04-03T10:11:12"),
    ("03/04/2026 10:11:12", None, "mdy", "2026-03-04T10:11:12"),
    ("08/13/2026 12:26:03 AM", "America/New_York", "mdy", "2026-08-13T04:26:03"),
    ("25.08.2026 12:09", None, None, "2026-08-25T12:09:00"),
    ("Sat, 23 May 2026 13:17:49 +0530", None, None, "2026-05-23T07:47:49"),
    ("Sun Sep  7 11:07:33 2025", "Europe/London", None, "2025-09-07T10:07:33"),
    ("Sun May 3 07:22:12 2026 +1000", None, None, "2026-05-02T21:22:12"),
    ("Oct 17, 2026 8:02:53 AM PDT", None, None, "2026-10-17T15:02:53"),
    ("2025년 9월 14일 오후 12:12:22", None, None, "2025-09-14T12:12:22"),
    ("2025년 9월 14일 오전 12:12:22", None, None, "2025-09-14T00:12:22"),
    ("2025-11-02 01:30:00", "America/New_York", None, "2025-11-02T05:30:00"),  # twice: the earlier
    ("2025-03-09 02:30:00", "America/New_York", None, None),  # never
    ("2025-02-30 02:30:00", None, None, None),
    ("2025-02-28 24:30:00", None, None, None),
    ("31/31/2026 10:11:12", None, "dmy", None),
    ("13/13/2026 1:11:12 PM", None, "mdy", None),
    ("2026-01-01 1:11:60", None, None, None),
    ("", None, None, None), ("yesterday 14:15", None, None, None), ("T00:00Z", None, None, None), ("N/A", None, None, None), (None, None, None, None),
    ("9" * 500, None, None, None),
]


def micros(iso: str) -> int:
    return (datetime.fromisoformat(iso).replace(tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def test_forms_and_policies(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, v string, tz string, o string, want string")
    for r in add_instant(df, "v", "us", "tz", "o").collect():
        assert r["us"] == (micros(r["want"]) if r["want"] else None), r


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.datetimes(datetime(2024, 1, 1), datetime(2027, 1, 1)), st.sampled_from(["Europe/Berlin", "America/St_Johns", "Australia/Sydney"])), min_size=1, max_size=40))
def test_local_times_as_zoneinfo_has_them(spark, times):
    df = spark.createDataFrame([(t.strftime("%Y-%m-%d %H:%M:%S"), z) for t, z in times], "v string, tz string")
    for r in add_instant(df, "v", "us", "tz").collect():
        local = datetime.fromisoformat(r["v"]).replace(tzinfo=ZoneInfo(r["tz"]))
        utc = local.astimezone(UTC)
        exists = utc.astimezone(ZoneInfo(r["tz"])).replace(tzinfo=None) == local.replace(tzinfo=None)
        assert r["us"] == (int(utc.timestamp()) * 1_000_000 if exists else None)


def test_machines_supply_zone_and_order(spark):
    machines = spark.createDataFrame([("a", "Asia/Seoul", "mdy"), ("a", "Asia/Seoul", "mdy"), ("b", None, None)], "machine string, tz string, date_order string")
    df = spark.createDataFrame([(1, "a", "02/03/2026 09:00:00"), (2, None, "02/03/2026 09:00:00"), (3, "b", "02/03/2026 09:00:00"), (4, "zz", None)], "i int, machine string, ts string")
    got = {r["i"]: r["us"] for r in with_instant(df, machines, "ts", "us").collect()}
    assert got == {1: micros("2026-02-03T00:00:00"), 2: micros("2026-03-02T09:00:00"), 3: micros("2026-03-02T09:00:00"), 4: None}


@pytest.mark.parametrize("columns", [["utc_us", "tz"]])
def test_clashing_and_empty(spark, columns):
    machines = spark.createDataFrame([], "machine string, tz string, date_order string")
    df = spark.createDataFrame([], "machine string, ts string, utc_us long, tz string")
    out = with_instant(df, machines, "ts")
    assert out.count() == 0 and set(columns) <= set(out.columns)


def test_p5_over_tables(spark, sf):
    from mnemospark.plans.times import p5_found

    got = p5_found(spark, sf)
    assert got.columns == ["src", "row_id", "utc_us"] and got.count() == got.distinct().count() > 100
