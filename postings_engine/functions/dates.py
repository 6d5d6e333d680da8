"""Posting dates: many published shapes to one timestamp, ages and the freshness window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import once

# a naive timestamp is read as UTC; the session zone is UTC
_WITH_ZONE = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]XXX",
              "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]XX",
              "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mmXXX",
              "d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm:ss z")
_NAIVE = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]",
          "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm",
          "yyyy-MM-dd", "yyyyMMdd", "d/M/yyyy", "M/d/yyyy", "d MMMM yyyy", "MMMM d, yyyy",
          "d MMM yyyy", "MMM d, yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy HH:mm:ss")


_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH = (r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)")
_WEEKDAY = r"(?:mon(?:day)?|tue(?:s|sday)?|wed(?:nesday)?|thu(?:r|rs|rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)"
_CLOCK = r"(?<![\d:])(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s*([ap](?=\.?m))?(?:\.?m\.?)?(?![\d:])"
_HOUR = r"(?<![\d:])(\d{1,2})\s*([ap])\.?m\b\.?"
_ZONE = r"(?:(utc|gmt)\s*)?(?<=[\d\smtc])([+-])(\d{2}):?(\d{2})\s*$"


def local_day(ts: Column, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, tz))


def _number_to_ts(n: Column) -> Column:
    seconds = F.when(n > 1e12, n / 1000.0).otherwise(n)
    return F.when(seconds >= 1e9, F.timestamp_micros((seconds * 1e6).cast("long")))


def _by_fields(low: Column, run_ts: Column) -> Column:
    """A date of any order, from its fields: clock and zone are taken out first, then weekdays and
    filler; what is left must be a month's name and numbers. Days come before months where both are
    possible, a year of two digits is the one within fifty years of the run, and a missing year or
    day is the run's. An offset behind GMT or UTC counts backwards, as in POSIX."""
    clocked = low.rlike(_CLOCK)
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(low, _CLOCK, i), F.lit("")).cast("int"), F.lit(0))
    hour = F.when(clocked, part(1)).otherwise(F.coalesce(F.nullif(F.regexp_extract(low, _HOUR, 1), F.lit("")).cast("int"), F.lit(0)))
    half = F.when(clocked, F.regexp_extract(low, _CLOCK, 4)).otherwise(F.regexp_extract(low, _HOUR, 2))
    minute, second = F.when(clocked, part(2)).otherwise(F.lit(0)), F.when(clocked, part(3)).otherwise(F.lit(0))
    good = F.when(half == "", hour < 24).otherwise(hour.between(1, 12)) & (minute < 60) & (second < 60)
    hour = F.when((half == "p") & (hour < 12), hour + 12).when((half == "a") & (hour == 12), F.lit(0)).otherwise(hour)
    offset = F.regexp_extract(low, _ZONE, 3).try_cast("int") * 3600 + F.regexp_extract(low, _ZONE, 4).try_cast("int") * 60
    ahead = (F.regexp_extract(low, _ZONE, 2) == "+") != (F.regexp_extract(low, _ZONE, 1) != "")
    zoned = clocked & low.rlike(_ZONE)
    east = F.when(zoned, F.when(ahead, offset).otherwise(-offset)).otherwise(F.lit(0))

    bare = F.when(zoned, F.regexp_replace(low, _ZONE, " ")).otherwise(low)
    for pattern in (_CLOCK, _HOUR, rf"\b{_WEEKDAY}\b\.?", r"(?<=\d)(?:st|nd|rd|th)\b", r"\b(?:at|on|of|and|utc|gmt|z|t)\b", r"(?<=\d)t\s*$"):
        bare = F.regexp_replace(bare, pattern, " ")
    fields = F.regexp_extract_all(bare, F.lit(rf"(\d+|{_MONTH})"), F.lit(1))
    clean = ~F.regexp_replace(bare, rf"(?<![a-z]){_MONTH}(?![a-z])|\d+|[\s,.;/'-]+", "").rlike(".")

    def read(f):
        named = F.array_position(F.transform(f, lambda x: x.rlike("[a-z]")), True).cast("int")  # from 1; 0 without a name
        month = lambda x: F.array_position(F.lit(_MONTHS), F.substring(x, 1, 3)).cast("int")
        n, long = (lambda i: F.try_element_at(f, F.lit(i)).try_cast("int")), (lambda i: F.length(F.try_element_at(f, F.lit(i))) > 2)
        big = lambda i: (n(i) > 31) | long(i)
        none = F.lit(None).cast("int")
        ymd = lambda y, m, d, full=F.lit(False): F.struct(y.alias("y"), m.alias("m"), d.alias("d"), full.alias("full"))
        size, name = F.size(f), (lambda i: month(F.try_element_at(f, F.lit(i))))
        three = (F.when(named == 1, F.when(big(2), ymd(n(2), name(1), n(3), long(2))).otherwise(ymd(n(3), name(1), n(2), long(3))))
                 .when(named == 2, F.when(big(1), ymd(n(1), name(2), n(3), long(1))).otherwise(ymd(n(3), name(2), n(1), long(3))))
                 .when(named == 3, F.when(big(2), ymd(n(2), name(3), n(1), long(2))).otherwise(ymd(n(1), name(3), n(2), long(1))))
                 .when(big(1), F.when(n(3) <= 12, ymd(n(1), n(3), n(2), long(1))).otherwise(ymd(n(1), n(2), n(3), long(1))))
                 .when((n(1) > 12) | (n(2) <= 12), ymd(n(3), n(2), n(1), long(3))).otherwise(ymd(n(3), n(1), n(2), long(3))))
        beside = lambda i, j: F.when(big(j), ymd(n(j), name(i), none, long(j))).otherwise(ymd(none, name(i), n(j)))
        two = (F.when(named == 1, beside(1, 2)).when(named == 2, beside(2, 1))
               .when(big(1), ymd(n(1), n(2), none, long(1))).when(big(2), ymd(n(2), n(1), none, long(2)))
               .when(n(2) <= 12, ymd(none, n(2), n(1))).otherwise(ymd(none, n(1), n(2))))
        names = F.size(F.filter(f, lambda x: x.rlike("[a-z]")))
        return F.when(names <= 1, F.when(size == 3, three).when(size == 2, two))

    def dated(p):
        now = F.year(run_ts)
        near = p["y"] + (now - now % 100)
        year = F.when(p["y"].isNull(), now).when(p["full"] | (p["y"] > 99), p["y"]).when(near >= now + 50, near - 100).when(near < now - 50, near + 100).otherwise(near)
        first = F.when(p["m"].between(1, 12) & year.between(1, 9999), F.make_date(year, p["m"], F.lit(1)))
        longest = F.day(F.last_day(first))
        day = F.coalesce(p["d"], F.least(F.day(run_ts), longest))
        return F.when(day.between(1, longest), F.date_add(first, day - 1))

    day = once(once(fields, read), dated)
    return F.when(clean & good, F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + hour * 3600 + minute * 60 + second - east))


def posted_timestamp(c: Column, run_ts: Column) -> Column:
    text = F.trim(F.regexp_replace(F.trim(c.cast("string")), r"\s*\([^)]*\)\s*$", ""))
    low = F.lower(text)
    amount = F.regexp_extract(low, r"^(\d{1,9})\s*(?:minute|hour|day|week|month)s?\s*ago", 1).cast("int")
    unit = F.regexp_extract(low, r"^\d+\s*(minute|hour|day|week|month)s?\s*ago", 1)
    zero = F.lit(0)

    def back(days=zero, hours=zero, mins=zero):
        return run_ts - F.make_interval(zero, zero, zero, days, hours, mins)

    relative = (F.when(unit == "minute", back(mins=amount)).when(unit == "hour", back(hours=amount))
                .when(unit == "day", back(days=amount)).when(unit == "week", back(days=amount * 7))
                .when(unit == "month", back(days=amount * 30)))
    no_weekday = F.regexp_replace(text, r"^[A-Za-z]{3,9},\s*", "")
    no_weekday = F.regexp_replace(no_weekday, r"\s(?:GMT|UTC|Z)$", " +0000")
    parsed = F.coalesce(*[F.try_to_timestamp(no_weekday, F.lit(f)) for f in _WITH_ZONE + _NAIVE])
    return (F.when(text == "", F.lit(None).cast("timestamp"))
            .when(text.rlike(r"^\d{9,13}$"), _number_to_ts(text.cast("double")))
            .when(low.isin("today", "just posted", "new"), run_ts)
            .when(low == "yesterday", back(days=F.lit(1)))
            .when(unit != "", relative)
            .otherwise(F.coalesce(parsed, _by_fields(low, run_ts))))


def parse_posted(df: DataFrame, col: str, run_ts: Column, out: str = "posted_at") -> DataFrame:
    return df.withColumn(out, posted_timestamp(F.col(col), run_ts))


def window_start(run_ts: Column, days: int, tz: str) -> Column:
    """Midnight, in the profile's zone, of the first day of the window."""
    first = F.date_sub(local_day(run_ts, tz), days - 1)
    return F.to_utc_timestamp(first.cast("timestamp"), tz)


def freshness(df: DataFrame, run_ts: Column, days: int, tz: str, keep_undated: bool = True) -> DataFrame:
    """Adds `fresh` (boolean) and `fresh_concern`. Undated rows follow the policy switch;
    future dates are kept, with a note."""
    posted = F.col("posted_at")
    end_of_today = F.to_utc_timestamp(
        local_day(run_ts, tz).cast("timestamp") + F.expr("INTERVAL '23:59' HOUR TO MINUTE"), tz)
    fresh = F.when(posted.isNull(), F.lit(keep_undated)).otherwise(posted >= window_start(run_ts, days, tz))
    concern = (F.when(posted.isNull(), "Posting date not published — check the advert is current")
               .when(posted > end_of_today, "Posting date is in the future — treat with caution"))
    return df.select("*", fresh.alias("fresh"), concern.alias("fresh_concern"))


def age_days(posted: Column, run_ts: Column, tz: str) -> Column:
    days = F.datediff(local_day(run_ts, tz), local_day(posted, tz))
    return F.when(days.isNotNull(), F.greatest(days, F.lit(0)))


def age_label(days: Column) -> Column:
    return (F.when(days.isNull(), "Date not published").when(days <= 0, "Today")
            .when(days == 1, "Yesterday")
            .otherwise(F.concat(days.cast("string"), F.lit(" days ago"))))


def add_age(df: DataFrame, run_ts: Column, tz: str) -> DataFrame:
    df = df.withColumn("job_age_days", age_days(F.col("posted_at"), run_ts, tz))
    return df.select("*", local_day(F.col("posted_at"), tz).alias("posted_date"),
                     age_label(F.col("job_age_days")).alias("job_age_label"))
