"""Single rules on our own literal cases."""

import pytest
from pyspark.sql import functions as F

from postings_engine import fixed_values as fv
from postings_engine.functions import dates, geo, pay, text
from postings_engine.operators import classify, enrich, gates, score
from postings_engine.sinks.reports import defused
from checks.projection import PROFILE


def values(spark, cases, make):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("c"))).collect()]


def check(spark, cases, make):
    got = values(spark, list(cases), make)
    assert dict(zip(cases, got)) == dict(cases)


def test_normalise(spark):
    check(spark, {"Café — Crème, C++/C#!": "cafe - creme, c++/c", "ﬁne ½ day™": "fine 1 2 daytm", "  A\n\tB ": "a b", "Straße №5": "straße no5", "": ""}, text.normalise)


def test_html_to_text(spark):
    check(spark, {"<p>One</p><ul><li>Two</ul>": "One\n \n- Two", "a &amp;lt; b &eacute;&#8364;&#x41;": "a &lt; b é€A", "x<script>y</script>z": "x z",
                  "Fish &ampchips &unknown;": "Fish &chips &unknown;", "a<br/>b": "a\nb"}, text.html_to_text)


def test_negation_window(spark):
    check(spark, {"hybrid working": True, "there is no hybrid working": False, "not now. " + "x" * 45 + " hybrid": True, "no hybrid, but hybrid later " + "y" * 20: False,
                  "no hybrid here " + "z" * 50 + " hybrid": True}, lambda c: text.unnegated(c, fv.HYBRID))


def test_slugs(spark):
    check(spark, {"The Acme Software Ltd | We build": "acme", "Ümlaut & Söhne GmbH": "umlautsohne", "|": "", "B2B Labs": "b2b"}, text.company_slug)
    check(spark, {"Senior Electrician (m/f/d) - Ref: 12345": "electrician", "Lead Dev #4455 Full-Time": "dev4455", "QA II": "qa"}, text.title_slug)
    check(spark, {"https://www.Site.com/Jobs/1/?a=b#c": "site.com/jobs/1", "http://u:p@x.org:8080/a;v=1": "x.org/a", "": ""}, text.url_key)


def test_dates(spark):
    run = F.expr("timestamp'2024-03-31 12:00:00'")
    shown = lambda c: F.date_format(dates.posted_timestamp(c, run), "yyyy-MM-dd HH:mm:ss")
    check(spark, {"1704067200": "2024-01-01 00:00:00", "1704067200000": "2024-01-01 00:00:00", "2024-01-05T10:00:00Z": "2024-01-05 10:00:00", "2 days ago": "2024-03-29 12:00:00",
                  "1 month ago": "2024-03-01 12:00:00", "Yesterday": "2024-03-30 12:00:00", "Tue, 02 Jan 2024 03:04:05 GMT": "2024-01-02 03:04:05", "03/02/2024": "2024-02-03 00:00:00",
                  "March 4, 2024": "2024-03-04 00:00:00", "2024-01-05 10:00:00 (local)": "2024-01-05 10:00:00", "whenever": None, "": None, "999999999": None}, shown)


def test_undated_has_no_age(spark):
    df = spark.createDataFrame([(None,)], "posted_at timestamp")
    row = dates.add_age(df, F.expr("timestamp'2024-03-31 12:00:00'"), "Europe/London").first()
    assert row.job_age_days is None and row.job_age_label == "Date not published"


def test_pay(spark):
    shown = lambda c: F.concat_ws("|", *[F.coalesce(pay.parsed_pay(c)[f].cast("string"), F.lit("-")) for f in ("salary_min", "salary_max", "day_rate_min", "day_rate_max", "currency")])
    check(spark, {"£45,000 - £55,000": "45000.0|55000.0|-|-|GBP", "60k-70k EUR": "60000.0|70000.0|-|-|EUR", "£350-400 per day": "-|-|350.0|400.0|GBP", "$25 per hour": "-|-|200.0|200.0|USD",
                  "in 2024": "-|-|-|-|", "€1.2m": "-|-|-|-|EUR", "": "-|-|-|-|"}, shown)
    check(spark, {"1,200": 1200.0, "£9.50": 9.5, "0": None, "-3": None, "n/a": None}, pay.amount)


def test_headcount(spark):
    check(spark, {"1,001-5,000 employees": 5000, "200+": 400, "11–50": 50, "": None}, gates.headcount_of)


def test_required_years(spark):
    check(spark, {"5+ years of commercial experience": 5, "experience: minimum 3 years": 3, "30 years of service": None, "2 years in plumbing and 8 years as a fitter": 8, "no years": None},
          classify.years_asked)


def test_company_size(spark):
    check(spark, {"a team of 12 people": "11-50", "11-50 employees": "11-50", "1000+ people": "1000+", "a startup": "Startup (small)", "an enterprise": "Large", "nothing": "Unknown"}, classify.size_label)


def test_places(spark):
    check(spark, {"berlin": "germany", "london": "", "greater mumbai metropolitan area": "india", "lagos, nigeria": "nigeria", "": "", "nowhere": ""}, lambda c: geo.country_of_location(c, PROFILE))
    check(spark, {"work from anywhere": True, "anywhere in the uk": False, "anywhere": True, "anywhere in canada": False}, geo.is_worldwide)
    check(spark, {"USA, UK and Deutschland": "United States|United Kingdom|Germany", "uk/gb": "United Kingdom", "Narnia & in": "Narnia|India"}, lambda c: F.array_join(geo.regions_of(c), "|"))


def test_home_phrases_match_their_plain_list(spark):
    """The folded alternation says the same as testing every phrase."""
    cases = list(PROFILE.confirmations) + ["ukbased", "the uk is", "remote from france", "including the england"]
    header = F.lit("")
    got = values(spark, cases, lambda c: geo.strongly_home(c, header, PROFILE))
    assert got == [any(p in c for p in PROFILE.confirmations) for c in cases]


def test_contacts(spark):
    check(spark, {"write x@a.com or jobs@a.com": "jobs@a.com", "noreply@a.com": "", "logo@2x.png a.b@c.org.": "a.b@c.org", "none": ""}, enrich.best_email)
    check(spark, {"call (0113) 496 0000": "(0113) 496 0000", "ref 2024 1234 5678": "", "x": ""}, enrich.best_phone)


def test_applicants(spark):
    check(spark, {"Be among the first 25 applicants": 10, "Over 200 applicants": 250, "1,024 applicants": 1024, "": None, "many": None}, lambda c: score.applicant_count(c))
    check(spark, {"first 25": 10}, lambda c: score.applicant_count(c, True))


def test_formula_text(spark):
    check(spark, {"=1+1": "'=1+1", "@x": "'@x", "- prose": "- prose", "-12.5": "-12.5", "+cmd": "'+cmd", "plain": "plain"}, defused)


@pytest.mark.parametrize("patterns", [fv.HYBRID, fv.ONSITE, fv.US_ONLY, fv.YEARS, fv.BEGINNER_PHRASES, fv.SENIOR_PHRASES])
def test_guards_never_hide_a_match(patterns):
    """Whatever a pattern matches contains one of the substrings it is said to need."""
    import re
    samples = ["hybrid", "part-remote", "3 days a week in the office", "on site", "in-office", "us based only", "must be based in the us", "security clearance", "5 years of experience",
               "experience of 3 years", "4 years in sales", "entry level", "graduate role", "senior", "tech lead", "leading the team", "ownership of the roadmap", "w2 only", "us only"]
    for pattern in patterns:
        for sample in samples:
            hit = re.search(pattern, sample)
            if hit and text.needed(pattern):
                assert any(n in hit.group(0) for n in text.needed(pattern)), (pattern, sample)
