import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from sheaf.operators.stamps import ABBREVIATIONS, stamp_instants

MONTH = "jan feb mar apr may jun jul aug sep oct nov dec".split()
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def by_hand(s, zone, day_first):
    """One format after another, with datetime and zoneinfo."""
    if s is None:
        return None
    s = s.strip()
    if re.fullmatch(r"\d{10}|\d{13}|\d{16}", s):
        return int(s) * 10 ** (16 - len(s))
    own = None
    if m := re.search(r"\[([^\]]+)\]$", s):
        own, s = ZoneInfo(m[1]), s[: m.start()]
    elif m := re.search(r"(?<=\d)Z$", s):
        own, s = timezone.utc, s[: m.start()]
    elif m := re.search(r" ([A-Z]{3,4})$", s):
        own, s = timezone(timedelta(minutes=ABBREVIATIONS[m[1]])), s[: m.start()]
    elif m := re.search(r"(?:(?<=:\d\d)|(?<=\.\d{3})|(?<=\.\d{6})) ?([+-])(\d\d):?(\d\d)?$", s):
        own, s = timezone((-1 if m[1] == "-" else 1) * timedelta(hours=int(m[2]), minutes=int(m[3] or 0))), s[: m.start()]
    s = re.sub(r"^(mon|tue|wed|thu|fri|sat|sun)\w*, ", "", s, flags=re.I)
    half = re.search(r" ([ap])\.?m\.?$", s, re.I)
    s = s[: half.start()] if half else s
    s = re.sub(r"(?i)\b(" + "|".join(MONTH) + r")[a-z]*\b\.?", lambda m: f"{MONTH.index(m[1].lower()) + 1:02d}", s)
    for pat, order in ((r"(\d{4})(\d\d)(\d\d)T?(\d\d)(\d\d)(\d\d)", "ymd"), (r"(\d{4})(\d\d)(\d\d)", "ymd"), (r"(\d{4})[-/](\d\d?)[-/](\d\d?)", "ymd"), (r"(\d\d?)/(\d\d?)/(\d{4})", "dmy" if day_first else "mdy"), (r"(\d\d?)[.](\d\d?)[.](\d{4})", "dmy"), (r"(\d\d?)[- ](\d\d)[- ](\d{4})", "dmy"), (r"(\d\d) (\d\d?), (\d{4})", "mdy")):
        if m := re.fullmatch(pat + ("" if pat.endswith("(\\d\\d)(\\d\\d)(\\d\\d)") else r"(?:[T ,]+(\d\d?):(\d\d)(?::(\d\d)(?:\.(\d+))?)?)?"), s):
            g = m.groups()
            p = dict(zip(order, map(int, g[:3]), strict=True))
            h, mi, se, fr = [*(int(x or 0) for x in g[3:6]), 0, 0, 0][:3] + [int(((g[6] if len(g) > 6 else None) or "0").ljust(6, "0"))]
            if half:
                h = h % 12 + 12 * (half[1].lower() == "p")
            try:
                local = datetime(p["y"], p["m"], p["d"], h, mi, se, fr, tzinfo=own or (ZoneInfo(zone) if zone else timezone.utc))
            except ValueError:
                return None
            return (local.astimezone(timezone.utc) - EPOCH) // timedelta(microseconds=1)
    return None


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_every_stamp_of_the_feeds(spark, sf):
    raw, feeds = spark.read.parquet(f"{sf}/raw_stamps.parquet"), spark.read.parquet(f"{sf}/feeds.parquet")
    fields = ["seendate", "gkg_date", "report_date", "week_ending"]
    got = {(r.raw_id, r.field_name): r.utc_us for r in stamp_instants(raw, feeds, "raw_id", fields).collect()}
    facts = {r.feed_code: (r.zone_name, r.day_first) for r in feeds.collect()}
    want = {(r.raw_id, f): v for r in raw.collect() for f in fields if (v := by_hand(r[f], *facts[r.feed_code])) is not None}
    assert got == want


def test_edges(spark):
    cases = [
        ("2024-03-10 02:30", "America/New_York", "2024-03-10 07:30:00"),  # skipped: the offset before the change
        ("2024-11-03 01:30", "America/New_York", "2024-11-03 05:30:00"),  # twice: the first
        ("2024-02-29", None, "2024-02-29 00:00:00"), ("2023-02-29", None, None), ("1900-02-29", None, None), ("2000-02-29", None, "2000-02-29 00:00:00"),
        ("2024-01-01T00:00:00[No/Where]", "Europe/Paris", None), ("2024-01-01 10:00 XQZT", "Europe/Paris", None), ("2024-01-01 10:00", "No/Where", "2024-01-01 10:00:00"),
        ("12/31/2024 12:05 AM", None, "2024-12-31 00:05:00"), ("12/31/2024 13:05 PM", None, None), ("2024-01-01 24:00", None, None), ("2024-01-01 10:61", None, None),
        ("", None, None), ("x" * 100_000, None, None), (None, None, None), ("1" * 11, None, None),
        ("2024-08-24 17:09 IST", "Asia/Kolkata", "2024-08-24 11:39:00"), ("2024-03-31 04:40 BST", "Europe/Paris", "2024-03-31 03:40:00"),
        ("Sept. 5, 2024, 12:00 p.m.", None, "2024-09-05 12:00:00"), ("1969-12-31T23:59:59.5Z", None, "1969-12-31 23:59:59.5"),
    ]
    raw = spark.createDataFrame([(i, f"f{i}", s, 7) for i, (s, _, _) in enumerate(cases)], "raw_id long, feed_code string, stamp string, zone_name int")
    feeds = spark.createDataFrame([(f"f{i}", z, None, "x") for i, (_, z, _) in enumerate(cases)], "feed_code string, zone_name string, day_first boolean, raw_id string")
    got = {r.raw_id: r.utc_us for r in stamp_instants(raw, feeds, "raw_id", ["stamp"]).collect()}
    for i, (s, z, want) in enumerate(cases):
        us = None if want is None else (datetime.fromisoformat(want).replace(tzinfo=timezone.utc) - EPOCH) // timedelta(microseconds=1)
        assert got.get(i) == us, (s and s[:40], z)


def test_zone_names_that_only_one_side_knows(spark):
    raw = spark.createDataFrame([(1, "f", "2024-01-02 03:04:05[Factory]"), (2, "f", "2024-01-02 03:04:05[localtime]"), (3, "f", "2024-01-02 03:04:05[No/Where]"), (4, "f", "2024-01-02 03:04:05")], "k long, feed_code string, at string")
    feeds = spark.createDataFrame([("f", "Factory", None)], "feed_code string, zone_name string, day_first boolean")
    got = {r.k: r.utc_us for r in stamp_instants(raw, feeds, "k", ["at"]).collect()}
    assert got[4] == 1_704_164_645_000_000


def test_empty_and_repeated(spark):
    feeds = spark.createDataFrame([], "feed_code string, zone_name string, day_first boolean")
    raw = spark.createDataFrame([], "raw_id long, feed_code string, stamp string")
    assert stamp_instants(raw, feeds, "raw_id", ["stamp"]).count() == 0
    twice = spark.range(2).select(F.lit(1).alias("raw_id"), F.lit(None).cast("string").alias("feed_code"), F.lit("20240102").alias("stamp"))
    assert [r.utc_us for r in stamp_instants(twice, feeds, "raw_id", ["stamp"]).collect()] == [1704153600000000] * 2
