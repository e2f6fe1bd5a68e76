"""Timestamps of many formats and zones as one UTC instant.

All formats are compiled into one regular expression whose alternatives have named
groups. One regexp_replace per stamp rewrites it into its components; nothing is parsed
twice, and no Python runs. Calendar ranges are checked in integers and the instant is put
together from day numbers (the civil-calendar day formula); only the offset of a named
zone is looked up in the zone database.

Defined results: null, empty, placeholder or impossible values, unknown abbreviations and
unknown zone names give no row. A zone of the stamp counts before the feed's, the feed's
before UTC. A local time that occurs twice is its first occurrence; a skipped one is read
with the offset before the change. Very long texts just don't match.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.runtime import DAY_US

# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "PKT": 300, "SGT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "AST": -240, "ADT": -180, "NST": -210, "NDT": -150, "ART": -180, "BRT": -180,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_WEEKDAY = "(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\\.?,? )?"
_CLOCK = "(?<h#>\\d{1,2}):(?<i#>\\d{2})(?::(?<s#>\\d{2})(?:[.,](?<f#>\\d{1,9}))?)?(?: ?(?<a#>[ap]\\.?m\\.?))?"
_ZONE = "(?: ?(?<o#>[+-]\\d{2}(?::?\\d{2})?))?(?:\\[(?<z#>[A-Za-z0-9_+/-]+)\\]| ?(?<b#>[A-Za-z]{1,5}))?"
_TIME = f"(?:(?:t|,? ){_CLOCK}{_ZONE})?"
#: One entry a format; # becomes the entry's number, so that group names differ.
FORMATS = [
    "(?<e#>\\d{10}|\\d{13}|\\d{16})",
    "(?<y#>\\d{4})(?<m#>\\d{2})(?<d#>\\d{2})(?:t?(?<h#>\\d{2})(?<i#>\\d{2})(?<s#>\\d{2})" + _ZONE + ")?",
    "(?<y#>\\d{4})[-/](?<m#>\\d{1,2})[-/](?<d#>\\d{1,2})" + _TIME,
    "(?<p#>\\d{1,2})/(?<q#>\\d{1,2})/(?<y#>\\d{4})" + _TIME,
    "(?<d#>\\d{1,2})\\.(?<m#>\\d{1,2})\\.(?<y#>\\d{4})" + _TIME,
    _WEEKDAY + "(?<d#>\\d{1,2})[ -](?<n#>" + _MONTH + ")\\.?[ -](?<y#>\\d{4})" + _TIME,
    _WEEKDAY + "(?<n#>" + _MONTH + ")\\.? (?<d#>\\d{1,2}),? (?<y#>\\d{4})" + _TIME,
]
PARTS = "eympqdnhisfaozb"


def pattern() -> str:
    return "(?i)^\\s*(?:" + "|".join(f.replace("#", str(k)) for k, f in enumerate(FORMATS)) + ")\\s*$"


def _template() -> str:
    return "\u0001" + "\u0001".join("".join(f"${{{p}{k}}}" for k, f in enumerate(FORMATS) if f"<{p}#>" in f) for p in PARTS)


def day_number(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a civil date, in integers."""
    back = F.when(m <= 2, 1).otherwise(0)
    year = y - back
    era = F.floor(year / 400)
    of_era = year - era * 400
    of_year = F.floor((F.lit(153) * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return (era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468).cast("long")


def month_length(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)


def _named(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns, each computed once: a generator keeps the optimizer from copying them into every use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def instants(stamps: DataFrame, stamp: str, feed_zone: str, day_first: str, out: str = "utc_us") -> DataFrame:
    """stamps with the column out, microseconds since 1970 UTC or null; stamp, feed_zone and day_first are columns of it."""
    # names that both the driver and the JVM, which looks the offsets up, know
    names = ", ".join(f"'{x}'" for x in sorted(zoneinfo.available_timezones() & set(stamps.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds())))
    known = lambda column: F.expr(f"`{column}` IN ({names})")
    c = {p: F.col(f"__{p}") for p in PARTS}
    num = lambda p, none: F.coalesce(c[p].try_cast("int"), F.lit(none))
    cut = _named(stamps, __parts=F.split(F.regexp_replace(F.col(stamp), pattern(), _template()), "\u0001"))
    cut = _named(cut, **{f"__{p}": F.when(F.size("__parts") == len(PARTS) + 1, F.get("__parts", F.lit(k + 1))) for k, p in enumerate(PARTS)})
    first = F.coalesce(F.col(day_first), F.lit(False))
    month = F.when(c["n"] != "", F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(c["n"], 1, 3))).cast("int")).when(c["p"] != "", F.when(first, num("q", 0)).otherwise(num("p", 0))).otherwise(num("m", 0))
    day = F.when(c["p"] != "", F.when(first, num("p", 0)).otherwise(num("q", 0))).otherwise(num("d", 0))
    half = F.lower(F.substring(c["a"], 1, 1))
    hour = F.when(half == "", num("h", 0)).when(num("h", 0).between(1, 12), num("h", 0) % 12 + F.when(half == "p", 12).otherwise(0)).otherwise(99)
    digits = F.regexp_replace(c["o"], "[^0-9]", "")
    cut = _named(
        cut, __year=num("y", 0), __month=month, __day=day, __hour=hour, __min=num("i", 0), __sec=num("s", 0), __frac=F.coalesce(F.rpad(F.substring(c["f"], 1, 6), 6, "0").try_cast("int"), F.lit(0)),
        __oh=F.substring(digits, 1, 2).try_cast("int"), __om=F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)),
    )
    y, m, d, oh, om = F.col("__year"), F.col("__month"), F.col("__day"), F.col("__oh"), F.col("__om")
    valid = (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= month_length(y, m)) & F.col("__hour").between(0, 23) & F.col("__min").between(0, 59) & F.col("__sec").between(0, 59)
    local = day_number(y, m, d) * DAY_US + (F.col("__hour") * 3600 + F.col("__min") * 60 + F.col("__sec")).cast("long") * 1_000_000 + F.col("__frac")
    offset = F.when(om.between(0, 59) & (oh * 60 + om <= 18 * 60), F.when(c["o"].startswith("-"), -(oh * 60 + om)).otherwise(oh * 60 + om))
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    zone = F.when(c["z"] != "", F.when(known("__z"), c["z"])).when(known(feed_zone), F.col(feed_zone)).otherwise(F.lit("UTC"))
    cut = _named(cut, __local=F.when(valid, local), __minutes=F.when(c["o"] != "", offset).otherwise(F.try_element_at(table, F.upper(c["b"]))), __zone=zone)
    at = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.col("__local")), F.col("__zone")))
    whole = c["e"].try_cast("long")
    since = F.when(F.length(c["e"]) == 10, whole * 1_000_000).when(F.length(c["e"]) == 13, whole * 1000).otherwise(whole)
    fixed = F.col("__local") - F.col("__minutes").cast("long") * 60_000_000
    utc = F.when(c["e"] != "", since).when((c["o"] != "") | (c["b"] != ""), fixed).otherwise(at)
    return _named(cut, **{out: utc}).select(*stamps.columns, out)


def stamp_instants(raw: DataFrame, feeds: DataFrame, key: str, fields: list[str], feed: str = "feed_code", zone: str = "zone_name", day_first: str = "day_first") -> DataFrame:
    """(key, field_name, utc_us): one row for each non-null field of raw that denotes an instant."""
    facts = feeds.select(F.col(feed).alias("__feed"), F.col(zone).alias("__fz"), F.col(day_first).alias("__fd"))
    long = raw.select(F.col(key), F.col(feed).alias("__own"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("stamp")) for f in fields])).alias("x"))
    long = long.select(key, "__own", "x.field_name", F.col("x.stamp").alias("stamp")).filter("stamp is not null")
    met = long.join(facts, F.col("__own") == F.col("__feed"), "left").select(key, "field_name", "stamp", F.col("__fz").alias("feed_zone"), F.col("__fd").alias("feed_day_first"))
    return instants(met, "stamp", "feed_zone", "feed_day_first").filter("utc_us is not null").select(key, "field_name", "utc_us")
