"""Nothing is cut unless it is asked for; row numbers never repeat; every city is known."""

import pytest
from pyspark.sql import functions as F

from postings_engine import SearchProfile
from postings_engine import fixed_values as fv
from postings_engine.functions.geo import country_of_location
from postings_engine.functions.text import normalise
from postings_engine.functions.pay import pay_lines
from postings_engine.operators.dedupe import same_role_join
from postings_engine.operators.gates import clear_dead_links, closed_phrase
from postings_engine.operators.skew import running_total
from postings_engine.profile import home_of
from postings_engine.schema import place_of
from postings_engine.session import shared_folder
from postings_engine.sources.feeds import dedupe_by_id, screen_urls, union_feeds
from postings_engine.sources.pages import jsonld_postings


def test_pay_and_closing_phrases_far_into_the_text(spark):
    filler = "word " * 15_000
    row = spark.createDataFrame([(filler + "\n£45,000 - £55,000 per annum", filler + " this position has been filled ")], "a string, b string")
    got = row.select(pay_lines(F.col("a")).alias("a"), closed_phrase(F.lower(F.col("b"))).alias("b")).first()
    assert "45,000" in got.a and got.b


def test_every_city_is_placed(spark):
    prof = SearchProfile(core_terms=("electrician",), **home_of("uk"))
    cities = [(c, country) for c, country in prof.city_countries.items() if "," not in c]
    df = spark.createDataFrame(cities, "city string, country string").withColumn("n", normalise(F.col("city")))
    home = set(fv.COUNTRIES["United Kingdom"][1])
    rows = df.select("city", "country", country_of_location(F.col("n"), prof).alias("got")).collect()
    assert len(rows) >= 221
    wrong = [r for r in rows if r.city not in home and r.got != r.country]
    assert not wrong, wrong
    for place, country in (("Doha", "qatar"), ("Chennai, Tamil Nadu", "india"), ("Riga", "latvia"), ("London", "")):
        assert spark.range(1).select(country_of_location(normalise(F.lit(place)), prof)).first()[0] == country


def test_row_numbers_keep_order_and_identity(spark):
    ids = [0, 1, 2**24, 2**24 + 1, 2**37]
    df = spark.createDataFrame([(i, p) for i in ids for p in (0, 1, 4999)], "payload long, pos int")
    rows = df.select("payload", "pos", place_of(F.col("payload"), F.col("pos")).alias("row_no"))
    feeds = {n: rows.select("row_no", F.concat_ws("-", "payload", "pos").alias("source_id"), F.lit("t").alias("title")) for n in ("reed", "jobgether")}
    got = union_feeds(feeds).select("seq", "source", "source_id").collect()
    assert len({r.seq for r in got}) == len(got) == 30
    want = sorted(got, key=lambda r: (fv.FEED_ORDER.index(r.source), *map(int, r.source_id.split("-"))))
    assert sorted(got, key=lambda r: r.seq) == want
    assert dedupe_by_id(union_feeds(feeds)).count() == 30
    for bad in ((2**38, 0), (0, 2**20)):
        with pytest.raises(Exception, match="too large"):
            spark.createDataFrame([bad], "a long, b int").select(place_of(F.col("a"), F.col("b"))).collect()


def test_many_objects_of_a_page_are_told_apart(spark):
    post = '{"@type": "JobPosting", "title": "T%d", "url": "https://x.example/%d"}'
    block = "[" + ",".join(post % (i, i) for i in range(5000)) + "]"
    html = "".join(f'<script type="application/ld+json">{b}</script>' for b in [block] + ["[" + post % (i, i) + "]" for i in range(6000, 6300)])
    pages = spark.createDataFrame([(7, "https://x.example/", html, "p", "l", "c")], "page_id long, url string, html string, platform string, label string, country string")
    rows = jsonld_postings(pages, F.lit("2024-01-01").cast("timestamp")).select("seq", "title").collect()
    assert len({r.seq for r in rows}) == len(rows) == 5300
    assert [int(r.title[1:]) for r in sorted(rows)] == [*range(5000), *range(6000, 6300)]


def test_templates_are_kept_without_a_limit(spark):
    df = spark.range(100).select(F.col("id").alias("seq"), (F.col("id") % 2).alias("country"), F.lit("https://a.example/?q={query}").alias("url_template"))
    assert screen_urls(df).where("kept").count() == 100
    assert [r.seq for r in screen_urls(df, 3).where("kept").orderBy("seq").collect()] == [0, 1, 2, 3, 4, 5]


def test_same_role_counts_no_pairs(spark):
    left = spark.createDataFrame([(i, "t", "acmeelectric") for i in range(300)], "id int, title_slug string, company_slug string")
    right = spark.createDataFrame([("t", "acmee")] * 400 + [("t", "other")], "title_slug string, company_slug string")
    got = same_role_join(left, right)
    assert got.count() == 300 and {r.same_role for r in got.collect()} == {400}


def test_running_total_over_blocks(spark):
    df = spark.range(1000).select(F.col("id").alias("seq"), F.lit(1.0).alias("v"))
    got = running_total(df, F.col("v"), "seq", "before", chunk=4).collect()
    assert all(r.before == r.seq for r in got)


def test_blank_keys_match_nothing(spark):
    leads = spark.createDataFrame([(str(i), "" if i % 3 else f"https://x/{i}", True) for i in range(30)], "posting_id string, careers_page string, careers_page_guessed boolean")
    crawl = spark.createDataFrame([("https://x/0", 200, "b", 1), ("", 200, "b", 1)], "url string, status int, body string, fetched_at int")
    pages = {r.posting_id: r.careers_page for r in clear_dead_links(leads, crawl).collect()}
    assert len(pages) == 30 and [p for p in pages.values() if p] == ["https://x/0"]


def test_a_shared_folder_must_be_named():
    class Context:
        def getCheckpointDir(self):
            return None

    class Session:
        conf = {}
        sparkContext = Context()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_every_named_entity_and_a_page_full_of_them(spark):
    import html
    import html.entities
    import time
    from postings_engine.functions.text import unescape_entities
    names = [f"&{n} x" for n in html.entities.html5] + ["&unknown; &", "&#65;&#x1F600;&ampx &notit; &copy2 &amp;amp;"]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    got = {r.t: r.u for r in df.select("t", unescape_entities(F.col("t")).alias("u")).collect()}
    assert got == {n: html.unescape(n) for n in names}
    page = spark.range(1).select(unescape_entities(F.repeat(F.lit("&zwnj;&yacute; &Aacute "), 50_000)).alias("u"))
    began = time.time()
    assert page.first().u == html.unescape("&zwnj;&yacute; &Aacute ") * 50_000
    assert time.time() - began < 20
