"""The screen cascade: every posting gets one category and the routes it takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.dates import add_age, freshness
from ..functions.geo import mentions_home
from ..functions.text import add_keys, add_match_text
from ..operators import gates
from ..operators.arrangement import arrangement, eligibility, reconcile_arrangement
from ..operators.classify import company_size
from ..operators.relevance import relevance
from ..operators.score import LEAD_COLUMNS, build_leads
from ..profile import SearchProfile

TEXT = ("n_title", "n_body", "n_tags", "n_location", "n_employment", "n_company", "n_url", "hay")
OUTCOME = ("category", "rejection_reason", "rejection_category", "is_prospect", "is_undated", "route",
           "job_status", "application_status")


def _blank_unless(df: DataFrame, keep: str) -> DataFrame:
    """Null the match text of rows already decided: later pattern work on them is free."""
    return df.select(*[F.when(F.col(keep), F.col(c)).alias(c) if c in TEXT else F.col(c) for c in df.columns])


def screen(postings: DataFrame, prof: SearchProfile, run_ts: Column, sizes: DataFrame | None = None) -> DataFrame:
    """One row per posting and route. `category` is '' for qualified rows, else the first
    failing stage; `route` is qualified, rejected, prospect or dropped (irrelevant: counted,
    never listed). Eligibility failures worth asking about take two routes.

    A single pass over the postings: no stage shuffles, and a row that fails a stage
    carries no text into the next one."""
    df = postings.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))
    df = relevance(add_match_text(df), prof)
    df = freshness(df, run_ts, prof.freshness_days, prof.timezone, prof.keep_undated)
    df = df.withColumn("_on", F.col("relevance.passed") & F.col("fresh"))
    df = _blank_unless(df, "_on")
    if prof.skip_low_rate_markets:
        df = gates.market_gate(df, prof)
    else:
        df = df.withColumn("market", gates.gate(F.lit(True), F.lit(""), ""))
    df = gates.size_gate(company_size(df), prof, sizes)
    df = df.withColumn("_on", F.col("_on") & F.col("market.passed") & F.col("size.passed"))
    df = _blank_unless(df, "_on")
    df = reconcile_arrangement(eligibility(arrangement(df), prof), prof).drop("eligibility_verdict", "arrangement")
    v = F.col("arrangement_verdict")
    df = df.withColumn("_on", F.col("_on") & (v["passed"] | v["prospect_worthy"]))
    df = build_leads(add_keys(_blank_unless(df, "_on")), prof, run_ts)
    df = gates.pay_gate(df, prof.salary_floor_usd, prof.require_salary, prof.pay_floor_stated)
    df = gates.score_gate(gates.engagement_gate(df, prof))

    stale = F.struct(F.col("fresh").alias("passed"), F.lit("Posted outside the window").alias("reason"),
                     F.lit("stale").alias("category"))
    stages = [F.col("relevance"), stale, F.col("market"), F.col("size"), v, F.col("pay_check"),
              F.col("engagement"), F.col("score_check")]
    first = F.coalesce(*[F.when(~s["passed"], F.struct(s["category"].alias("category"), s["reason"].alias("reason")))
                         for s in stages])
    df = df.withColumn("_fail", first)
    category = F.coalesce("_fail.category", F.lit(""))
    from_verdict = category.isin("not_remote", "wrong_arrangement", "region_unknown", "ineligible")
    prospect = F.when(from_verdict, v["prospect_worthy"]).otherwise(category == "pay_unstated")
    routes = (F.when(category == "", F.array(F.lit("qualified"))).when(category == "irrelevant", F.array(F.lit("dropped")))
              .when(category == "pay_unstated", F.array(F.lit("prospect")))
              .when(prospect, F.array(F.lit("rejected"), F.lit("prospect"))).otherwise(F.array(F.lit("rejected"))))
    undated = F.col("posted_at").isNull() & F.col("relevance.passed") & F.col("fresh")
    outcome = lambda route: F.struct(
        category.alias("category"), F.coalesce("_fail.reason", F.lit("")).alias("rejection_reason"),
        category.alias("rejection_category"), undated.alias("is_undated"), route.alias("route"))
    # the outcome leaves through a generator, so filters on it stay above the whole cascade
    return _finish(df.select("*", F.inline_outer(F.transform(routes, outcome))))


def _finish(df: DataFrame) -> DataFrame:
    """Route-specific labels. Stubs of early rejections keep only what identifies them."""
    lead = F.col("category").isin("", "pay_unstated", "low_pay", "wrong_engagement", "not_startup", "low_score")
    is_prospect = F.col("route") == "prospect"
    full = lead | is_prospect
    reason = F.array("rejection_reason")
    unpaid = F.col("category") == "pay_unstated"
    qualified = F.col("route") == "qualified"
    notes = F.concat("concerns", F.array_compact(F.array("pay_note")))
    stub_keeps = {"posting_id", "seq", "fingerprint", "company_slug", "title_slug", "url_key", "source", "sources",
                  "title", "company", "location", "posted_at", "posted_date", "job_age_days", "job_age_label",
                  "original_job_url", "application_url", "discovered_date"}
    changed = {
        "concerns": F.when(is_prospect & unpaid, F.concat(reason, "concerns")).when(is_prospect, F.concat(reason, "concerns"))
        .when(lead, notes),
        "match_reasons": F.when(lead & ~unpaid, F.concat("match_reasons", F.array_compact(F.array("pay_detail")))).otherwise(F.col("match_reasons")),
        "opportunity_type": F.when(is_prospect & unpaid, "Prospect (pay unstated)")
        .when(is_prospect, "Prospect (eligibility unconfirmed)").otherwise(F.col("opportunity_type")),
    }
    columns = []
    for name in LEAD_COLUMNS:
        value = changed.get(name, F.col(name))
        columns.append((value if name in stub_keeps else F.when(full, value)).alias(name))
    return df.select(
        *columns, "category", "rejection_reason", "rejection_category", is_prospect.alias("is_prospect"), "is_undated", "route",
        F.when(qualified, "NEW").when(is_prospect, "Needs verification").when(lead, "NEW").otherwise("Rejected").alias("job_status"),
        F.when(is_prospect & ~unpaid, "Ask before applying").otherwise("Not Applied").alias("application_status"))


def explain(postings: DataFrame, prof: SearchProfile) -> DataFrame:
    """Why each posting passes or fails the relevance and arrangement gates; nothing filtered."""
    df = relevance(add_match_text(postings), prof)
    df = reconcile_arrangement(eligibility(arrangement(df), prof), prof)
    return df.select(
        "posting_id", "title", "arrangement",
        F.col("relevance.passed").alias("relevant"), F.col("relevance.reason").alias("relevance_reason"),
        F.col("arrangement_verdict.passed").alias("workable"), F.col("arrangement_verdict.category").alias("category"),
        F.col("arrangement_verdict.reason").alias("arrangement_reason"),
        F.col("arrangement_verdict.remote_status").alias("remote_status"),
        F.col("arrangement_verdict.eligibility").alias("eligibility"))
