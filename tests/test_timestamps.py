import random

import pytest

from larkspur.functions.timestamps import normalised_tables, restamp_tables, to_utc_us, with_utc
from larkspur.functions.zones import database_version, transitions
from stamp_reference import read

CASES = [
    ("2024-12-17T01:19:17+00:00", "ymd", "UTC", 1734398357000000),
    ("  2024-12-17t01:19:17z ", "ymd", "Asia/Tokyo", 1734398357000000),
    ("2024-12-17 01:19:17,9999999", "ymd", "UTC", 1734398357999999),
    ("2024-12-17", "ymd", "America/New_York", 1734411600000000),
    ("20241217T0119Z", "ymd", "UTC", 1734398340000000),
    ("1734398357.5", "ymd", "Asia/Tokyo", 1734398357500000),
    ("1734398357123", "ymd", "UTC", 1734398357123000),
    ("02/03/2025 10:00", "mdy", "UTC", 1738576800000000),
    ("02/03/2025 10:00", "dmy", "UTC", 1740909600000000),
    ("2.3.2025", "dmy", "UTC", 1740873600000000),
    ("17/12/2024", "ymd", "UTC", None),
    ("2025/03/02", "dmy", "UTC", 1740873600000000),
    ("12/17/2024", "dmy", "UTC", None),
    ("Mar 2, 2025 12:05 AM", "ymd", "UTC", 1740873900000000),
    ("2 MARCH 2025 12:05:00 EST", "ymd", "Europe/Berlin", 1740935100000000),
    ("2025-03-09 02:30:00 America/New_York", "ymd", "UTC", 1741505400000000),  # skipped: the offset before
    ("2025-11-02 01:30:00", "ymd", "America/New_York", 1762061400000000),  # repeated: the first
    ("2025-11-02 01:30 EST", "ymd", "America/New_York", 1762065000000000),
    ("2025-03-30T02:30:00+02:00[Europe/Berlin]", "ymd", "UTC", 1743294600000000),
    ("2025-02-30", "ymd", "UTC", None),
    ("2025-04-19T25:10:00+00:00", "ymd", "UTC", None),
    ("2025-04-19 13:00 PM", "ymd", "UTC", None),
    ("28 SEP 2000T15:32:04 cest", "ymd", "UTC", 970147924000000),
    ("Sep 28, 2000t15:32", "ymd", "UTC", 970155120000000),
    ("28 SEP 2000x15:32:04", "ymd", "UTC", None),
    ("2 Mar 2025 10:54 pm+05:30", "ymd", "UTC", 1740936240000000),
    ("24 Foo 2025", "ymd", "UTC", None),
    ("20251340", "ymd", "UTC", None),
    ("T10:22:00Z", "ymd", "UTC", None),
    ("", "ymd", "UTC", None),
    (None, "ymd", "UTC", None),
    ("x" * 100_000, "ymd", "UTC", None),
    ("２０２４-12-17", "ymd", "UTC", None),
]


@pytest.mark.parametrize("stamp,order,zone,want", CASES)
def test_stamp(stamp, order, zone, want):
    assert to_utc_us([stamp], [order], [zone]) == [want]


def test_against_a_plain_reader():
    rnd = random.Random(4)
    zones = ["UTC", "America/New_York", "Europe/London", "Australia/Sydney", "Asia/Kolkata", "Africa/Casablanca"]
    dates = ["{y}-{m:02}-{d:02}", "{y}/{m:02}/{d:02}", "{m}/{d}/{y}", "{d:02}.{m:02}.{y}", "{d} {n} {y}", "{n} {d}, {y}", "{y}{m:02}{d:02}"]
    times = ["", " {h:02}:{i:02}", "T{h:02}:{i:02}:{s:02}", " {h:02}:{i:02}:{s:02}.{f}", " {k}:{i:02} {p}", " {k}:{i:02}{p}"]
    ends = ["", "Z", "+05:30", "-0800", " +09", " EST", " cest", " America/New_York", "+01:00[Europe/Berlin]", "[Asia/Tokyo]"]
    stamps, orders, where = [], [], []
    for _ in range(6000):
        v = dict(y=rnd.choice([1971, 2000, 2024, 2025, 2037, 2090, 1931]), m=rnd.randint(1, 13), d=rnd.randint(1, 31), n=rnd.choice(["Jan", "march", "SEP", "December", "Foo"]), h=rnd.randint(0, 25), i=rnd.randint(0, 61), s=rnd.randint(0, 60), f=rnd.randint(0, 10**9), k=rnd.randint(0, 13), p=rnd.choice(["AM", "pm"]))
        t = rnd.choice(times)
        date = rnd.choice(dates)
        if date.endswith("{m:02}{d:02}") and t:
            t = ""
        stamps.append((date + t).format(**v) + (rnd.choice(ends) if t else ""))
        orders.append(rnd.choice(["ymd", "mdy", "dmy"]))
        where.append(rnd.choice(zones))
    assert to_utc_us(stamps, orders, where) == [read(*x) for x in zip(stamps, orders, where)]


def test_tables(spark):
    roots = spark.createDataFrame([("/a/", "x", "Asia/Tokyo", "dmy")], "root_path string, source_name string, zone_name string, date_order string")
    e = [(1, "2024-12-17T01:19:17+00:00", "/a/f"), (2, "3/2/2025", "/a/f"), (2, "3/2/2025", "/a/f"), (3, "3/2/2025", None), (4, None, "/a/f"), (5, "2025/02/03", "/b")]
    m = [(1, "yesterday", "/a/f"), (2, "2024-12-17T01:19:17Z", None)]
    t = {
        "episodes": spark.createDataFrame(e, "id bigint, ts string, source_path string"),
        "memories": spark.createDataFrame(m, "id bigint, created_at string, source_path string"),
        "locks": spark.createDataFrame([(1, "2024-12-17"), (2, "20241217"), (3, "2024-12-17 09:00 PST")], "id bigint, locked_on string"),
        "source_roots": roots,
    }
    day = 86_400_000_000
    feb3 = 1738540800000000
    assert sorted(tuple(r) for r in restamp_tables(t).collect()) == [
        ("episodes", 2, feb3 - 9 * day // 24), ("episodes", 5, feb3), ("locks", 2, 1734393600000000), ("locks", 3, 1734454800000000), ("memories", 2, 1734398357000000),
    ]
    every = normalised_tables(t).collect()
    assert len(every) == 5 + 2 + 3 and sum(r.utc_us is None for r in every) == 3
    assert {(r.tbl, r.rec_id, r.utc_us) for r in every} >= {tuple(r) for r in restamp_tables(t).collect()}
    assert normalised_tables({k: v.limit(0) for k, v in t.items()}).collect() == []
    assert restamp_tables({k: v.limit(0) for k, v in t.items()}).collect() == []
    assert with_utc(t["episodes"], "ts", "source_path", roots).where("utc_us is null").count() == 2


def test_zone_tables():
    switch, offsets = transitions("America/New_York")
    assert set(offsets) == {-4 * 3600, -5 * 3600} and (switch[1:] > switch[:-1]).all()
    assert database_version()
