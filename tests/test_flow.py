"""Whole runs, plans and streams over the smallest tables."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from checks.projection import PROFILE, postings, run_ts
from checks.registered import ORACLE, QUERIES
from postings_engine import SearchProfile
from postings_engine.functions.text import add_match_text
from postings_engine.operators.relevance import relevance
from postings_engine.operators.state import SEEN_SCHEMA
from postings_engine.plans.run import run
from postings_engine.plans.screen import screen
from postings_engine.schema import to_postings
from postings_engine.sinks import reports
from postings_engine.streaming.incremental import stream_dedupe, stream_screen
from postings_engine.streaming.registry_store import RegistryStore

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def clock(spark):
    return F.lit(run_ts(spark, SF).first()[0])


def test_registered_queries_match_sql(spark):
    from checks.compare import compare
    picked = os.environ.get("ALL_QUERIES") and list(QUERIES) or [
        "txt_2_match_text", "txt_3_posting_keys", "txt_9_advert_brief", "agg_1_funnel", "dup_4_same_role_whole", "enr_5_site_contacts", "src_11_union_feeds", "src_18_screen_urls", "dat_1_parse_posted", "pay_2_resolve_pay", "flt_1_relevance", "flt_6_eligibility", "flt_11_screen",
        "cls_4_required_years", "enr_1_contacts", "dup_2_url_alias", "ver_3_fit_blend", "sta_1_upsert_seen", "src_2_json_feed", "src_4_jsonld_postings", "src_6_detail_links"]
    assert compare(spark, SF, picked, verbose=False) == []


def test_every_query_but_a_few_has_sql():
    assert set(QUERIES) - set(ORACLE) <= {"dup_3_merged_rows", "flow_1_ranked_leads"}


def test_screen_plan_stays_in_the_jvm_and_does_not_shuffle(spark, clock):
    plan = screen(_stored(spark), PROFILE, clock)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Exchange" not in text
    # a filter on the outcome stays above the cascade instead of repeating it
    filtered = plan.where("route = 'qualified'")._jdf.queryExecution().executedPlan().toString()
    assert len(filtered) < 1.2 * len(text)


def _stored(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "postings")
    postings(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


def test_full_run_with_every_side_table(spark, clock):
    posts = _stored(spark)
    seen = spark.createDataFrame([], SEEN_SCHEMA)
    crawl = posts.select("url").distinct().select("url", F.lit(200).alias("status"), F.lit("<p>open</p>").alias("body"), F.lit(1).alias("fetched_at"))
    result = run(posts, PROFILE, clock, seen=seen, crawl=crawl)
    counts = {r.stage: r.n for r in result.funnel.collect()}
    failing = sum(v for k, v in counts.items() if k not in ("screened", "undated_kept", "passed", "qualified", "duplicates_removed"))
    assert counts["screened"] == counts["passed"] + failing == posts.count()
    qualified = result.qualified.collect()
    assert len(qualified) == counts["qualified"] > 0
    assert len({r.fingerprint for r in qualified}) == len(qualified) and all(r.is_new for r in qualified)
    assert [r.match_score for r in qualified] == sorted((r.match_score for r in qualified), reverse=True)
    again = run(posts, PROFILE, clock, seen=result.registry)
    assert not any(r.is_new for r in again.qualified.collect())
    out = tempfile.mkdtemp(prefix="spark-")
    reports.write_reports(result, PROFILE, out)
    reports.export_csv(result, out + "/csv")
    reports.export_json(result, out + "/json")
    sheets = spark.read.parquet(out + "/sheets")
    assert sheets.where("sheet = 'All Qualified Jobs'").count() == len(qualified)
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out + "/csv").where("Sheet in ('Qualified', 'Hot Lead')").count() == len(qualified)


TRADES = {
    "plumbing": (("plumbing", "pipefitting"), ("plumber", "fitter"), "Domestic Plumber", "Plumber for plumbing and pipefitting. Plumbing tickets essential. Pipefitting a plus."),
    "nursing": (("nursing", "nurse"), ("nurse", "sister"), "Staff Nurse", "A nurse for our ward. Nursing degree required. Nursing experience. Registered nurse."),
    "driving": (("hgv", "driving"), ("driver",), "HGV Driver", "HGV driver for distribution. HGV licence and driving experience. Driving at night."),
}


def test_each_trade_keeps_its_own_adverts_and_no_others(spark):
    rows = [(name, spec[2], spec[3], "https://x.example/" + name) for name, spec in TRADES.items()]
    df = add_match_text(to_postings(spark.createDataFrame(rows, "posting_id string, title string, description string, url string")))
    for name, (core, tokens, _, _) in TRADES.items():
        prof = SearchProfile(core_terms=core, hands_on_title_tokens=tokens, min_body_core_mentions=2)
        kept = {r.posting_id for r in relevance(df, prof).where("relevance.passed").collect()}
        assert kept == {name}


def test_incremental_screen_is_idempotent(spark, clock):
    root = tempfile.mkdtemp(prefix="spark-")
    landed = root + "/landed"
    posts = _stored(spark)
    posts.where("seq % 2 = 0").coalesce(1).write.parquet(landed, mode="append")
    go = lambda ckpt: stream_screen(spark, landed, PROFILE, root + "/state", root + "/leads", root + ckpt, clock).awaitTermination()
    store = RegistryStore(spark, root + "/state")
    go("/ckpt")
    first = sorted(store.before(1).collect())
    go("/ckpt-lost")  # the same batch again, as after a crash before the commit
    assert sorted(store.before(1).collect()) == first and len(first) > 0
    posts.where("seq % 2 = 1").coalesce(1).write.parquet(landed, mode="append")
    go("/ckpt")
    assert store.before(2).count() >= len(first)
    assert sorted(os.path.basename(p) for p in glob.glob(root + "/leads/batch=*")) == ["batch=0", "batch=1"]
    assert not glob.glob(root + "/state/screened/batch=*")


def test_stream_dedupe(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    rows = [(i, f"Role {i % 3}", "Acme", f"2024-01-0{1 + i % 3} 00:00:00") for i in range(9)]
    df = to_postings(spark.createDataFrame(rows, "seq bigint, title string, company string, posted_at string"))
    df.write.parquet(root + "/in")
    stream = stream_dedupe(spark.readStream.schema(df.schema).parquet(root + "/in"), 30)
    stream.writeStream.format("parquet").option("path", root + "/out").option("checkpointLocation", root + "/c").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(root + "/out").count() == 3
