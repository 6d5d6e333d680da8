"""Pages that share a URL, and exported cells read back."""

import tempfile
from types import SimpleNamespace

from pyspark.sql import functions as F

from postings_engine.operators import gates
from postings_engine.sinks import reports

CRAWL = "page_id long, url string, status int, body string, fetched_at int"


def test_pages_that_share_a_url_are_crawled_apart(spark):
    crawl = spark.createDataFrame([(1, "u", 404, "", 2), (2, "u", 200, "", 2), (1, "u", 200, "", 1)], CRAWL)
    leads = spark.createDataFrame([("a", 1, "u"), ("a", 2, "u")], "posting_id string, page_id long, url string")
    leads = leads.select("*", F.col("url").alias("application_url"), F.col("url").alias("original_job_url"), F.array().cast("array<string>").alias("concerns"))
    got = gates.drop_closed(leads, crawl, ("page_id",)).select("page_id", "closed").collect()
    assert sorted(map(tuple, got)) == [(1, True), (2, False)]


def test_dead_links_of_pages_that_share_a_url(spark):
    crawl = spark.createDataFrame([(1, "u", 404, "", 2), (2, "u", 200, "", 2)], CRAWL)
    leads = spark.createDataFrame([(1, "u", True), (2, "u", True), (3, "u", True)], "page_id long, careers_page string, careers_page_guessed boolean")
    got = gates.clear_dead_links(leads, crawl, ("page_id",)).select("page_id", "careers_page").collect()
    assert sorted(map(tuple, got)) == [(1, ""), (2, "u"), (3, "")]
    # crawls of one URL at one time: always the same one counts
    assert {r.careers_page for r in gates.clear_dead_links(leads, crawl).collect()} == {""}


def test_csv_cells_come_back_as_they_were(spark):
    cells = ["+1 (744) 555-2801", "=1+1", "@x", "'=x", "''@y", "-5", "'-5", "- plain", "'quoted'", "", "'", "-x\nline \"two\" "]
    leads = spark.createDataFrame([(str(i), c, 90) for i, c in enumerate(cells)], "posting_id string, description string, match_score int")
    path = f"{tempfile.mkdtemp(prefix='spark-')}/csv"
    reports.export_csv(SimpleNamespace(qualified=leads, prospects=leads.limit(0), long_shots=leads.limit(0)), path)
    got = {r.posting_id: r.description for r in reports.read_csv(spark, path).collect()}
    assert got == {str(i): c for i, c in enumerate(cells)}
    raw = {r.posting_id: r.description for r in spark.read.options(**reports.CSV_OPTIONS).csv(path).collect()}
    assert raw["0"] == "'+1 (744) 555-2801" and raw["5"] == "-5"
