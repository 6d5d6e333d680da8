"""Structured data of pages: references, nesting, odd scripts, and a plan of one pass."""

import json

from pyspark.sql import functions as F

from postings_engine.sources.pages import advert_bodies, itemlist_links, jsonld_postings, ld_nodes

SHAPE = "page_id long, url string, html string, platform string, label string, country string"


def pages_of(spark, *blocks):
    script = lambda b: f'<script type="application/ld+json">{b if isinstance(b, str) else json.dumps(b)}</script>'
    return spark.createDataFrame([(1, "https://x.example/", "".join(map(script, blocks)), "p", "l", "Ghana")], SHAPE)


def companies(spark, *blocks):
    got = jsonld_postings(pages_of(spark, *blocks), F.lit("2024-01-01").cast("timestamp"))
    return {r.title: r.company for r in got.select("title", "company").collect()}


def post(title, org):
    return {"@type": "JobPosting", "title": title, "hiringOrganization": org}


def test_references_stay_inside_their_document(spark):
    firm = {"@id": "#o", "name": "Firm"}
    assert companies(spark, [post("A", {"@id": "#o"}), firm], [post("B", {"@id": "#o"})], [post("C", [{"@id": "#o"}]), {"x": {"y": [firm]}}]) == {
        "A": "Firm", "B": "Undisclosed", "C": "Firm"}
    assert companies(spark, [post("A", {"@id": "#o", "name": "Own"}), post("B", "Firm"), post("C", []), post("D", {"@id": 5}), post("E", None), firm]) == {
        "A": "Own", "B": "Undisclosed", "C": "Undisclosed", "D": "Undisclosed", "E": "Undisclosed"}


def test_odd_scripts_give_nothing_and_stop_nothing(spark):
    deep = "[" * 100_000 + "]" * 100_000
    assert companies(spark, deep, "", "null", "{", "[1, \"a\"]", [post("A", {"name": "Firm"})]) == {"A": "Firm"}
    nested = post("Inner", {"name": "Firm"})
    for _ in range(50):
        nested = {"a": [nested]}
    assert companies(spark, nested) == {"Inner": "Firm"}
    assert ld_nodes(pages_of(spark).limit(0)).count() == 0


def test_lists_count_only_without_a_posting(spark):
    entry = {"@type": "ListItem", "item": {"url": "https://x.example/1", "name": "One"}}
    assert itemlist_links(pages_of(spark, [entry, post("A", {})])).count() == 0
    assert itemlist_links(pages_of(spark, [entry], [post("A", {})])).count() == 1


def test_a_posting_inside_another_object_is_no_advert_of_the_page(spark):
    inner = {"@type": "ListItem", "item": {**post("A", {}), "description": "inner"}}
    assert advert_bodies(pages_of(spark, inner)).first().body == ""
    assert advert_bodies(pages_of(spark, inner, {"@graph": [{**post("A", {}), "description": "own"}]})).first().body == "own"


def test_one_python_stage_and_no_join(spark):
    df = jsonld_postings(pages_of(spark, [post("A", {})]), F.lit("2024-01-01").cast("timestamp"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Join" not in plan and "Exchange" not in plan
