"""Dates of any order, against the parser that people use on one machine."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from postings_engine.functions.dates import parse_posted

NOW = datetime(2026, 3, 30, 12, 0, 0)
SHAPES = ("%d/%m/%y", "%d.%m.%y", "%d %b %y", "%b %d %y", "%b %d, %y", "%d-%b-%Y", "%d-%b-%y", "%Y/%m/%d", "%Y.%m.%d", "%b %Y", "%B %Y", "%d %B", "%B %d", "%A %d %B %Y", "%a %b %d %Y %H:%M:%S GMT+0000",
          "%a %b %d %Y %H:%M:%S +0530", "%d %b %Y at %I:%M %p", "%d %b %Y %I%p", "%B %d, %Y %H:%M", "%d/%m/%Y %H:%M", "%d/%m/%y %I:%M%p", "%a, %d %b %y %H:%M:%S", "%m/%Y", "%d/%m")
FIXED = ("whenever", "soon", "12345", "5 apples 2026", "31 Feb 2026", "40/40/2026", "Aug", "", "3 Aug 2026 25:00", "August 5th, 2026", "1st of May 2025", "5 May June 2026", "2026", "29 Feb 2024", "Tue Jul 21 2026 22:30:40 GMT+0000 (Coordinated Universal Time)")


def by_hand(text):
    parser = pytest.importorskip("dateutil.parser")
    if "(" in text:
        text = text[:text.index("(")].strip()
    try:
        got = parser.parse(text, dayfirst=True, default=datetime(NOW.year, NOW.month, NOW.day))
    except (ValueError, OverflowError):
        return None
    return (got.astimezone(UTC).replace(tzinfo=None) if got.tzinfo else got)


def test_fields_in_any_order(spark):
    rng, texts = random.Random(3), []
    for _ in range(600):
        at = datetime(rng.choice((2024, 2025, 2026, 1999)), rng.randint(1, 12), rng.randint(1, 28), rng.randrange(24), rng.randrange(60), rng.randrange(60))
        text = at.strftime(rng.choice(SHAPES))
        texts.append(text if "GMT" in text else rng.choice((text, text.lower(), text.upper())))
    df = spark.createDataFrame([(t,) for t in [*texts, *FIXED]], "raw string")
    got = {r.raw: r.posted_at for r in parse_posted(df, "raw", F.lit(NOW).cast("timestamp")).collect()}
    lone = {"12345", "2026", "Aug", ""}  # a number or a month alone says no date here
    wrong = {t: (got[t], by_hand(t)) for t in got if t not in lone and got[t] != by_hand(t)}
    assert not wrong, "\n".join(map(str, list(wrong.items())[:12]))
    assert all(got[t] is None for t in lone)
