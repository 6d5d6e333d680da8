"""Model answers as a table: what still needs asking, and what the answers change.

`verdicts` has (fingerprint, kind, remote, eligible, reason, evidence, fit, chance, verdict,
strengths, gaps, fetched_at); kind is "eligibility" or "fit"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .skew import running_total


def _latest(verdicts: DataFrame, kind: str) -> DataFrame:
    fields = [c for c in verdicts.columns if c not in ("fingerprint", "kind")]
    return (verdicts.where(F.col("kind") == kind).groupBy("fingerprint")
            .agg(F.max_by(F.struct(*fields), "fetched_at").alias("answer")))


def fresh_answers(verdicts: DataFrame, kind: str, run_ts: Column, ttl_days: float) -> DataFrame:
    age = F.unix_timestamp(run_ts) - F.unix_timestamp("answer.fetched_at")
    return _latest(verdicts, kind).where(age <= ttl_days * 86400) if ttl_days > 0 else _latest(verdicts, kind).limit(0)


def verdict_worklist(leads: DataFrame, verdicts: DataFrame, kind: str, run_ts: Column, ttl_days: float, cap: int | None = None) -> DataFrame:
    """Best-first leads without a fresh answer; with a cap a top-k, not a full sort."""
    known = fresh_answers(verdicts, kind, run_ts, ttl_days).select("fingerprint")
    ordered = leads.join(known, "fingerprint", "left_anti").orderBy(F.desc("match_score"), "seq")
    return ordered if cap is None else ordered.limit(cap)


def verdict_hits(leads: DataFrame, verdicts: DataFrame, kind: str, run_ts: Column, ttl_days: float) -> DataFrame:
    return leads.join(fresh_answers(verdicts, kind, run_ts, ttl_days), "fingerprint")


def apply_eligibility(prospects: DataFrame, verdicts: DataFrame, home: str) -> DataFrame:
    """Adds model_eligibility, model_promoted; relabels promoted and refused prospects."""
    joined = prospects.join(_latest(verdicts, "eligibility"), "fingerprint", "left")
    a = F.col("answer")
    text = lambda name: F.trim(F.coalesce(a[name], F.lit("")))
    reason, evidence = text("reason"), text("evidence")
    note = F.concat_ws(" — ", F.when(reason != "", F.concat(F.lit("Assessed: "), reason)),
                       F.when(evidence != "", F.concat(F.when(reason != "", "advert says: \"").otherwise("Advert says: \""),
                                                       evidence, F.lit('"'))))
    verdict = F.lower(text("eligible"))
    df = joined.select("*", F.when(a.isNotNull(), verdict).otherwise("").alias("model_eligibility"),
                       F.when(a.isNotNull(), note).otherwise("").alias("model_note"))
    yes = (F.col("model_eligibility") == "yes") & (F.lower(text("remote")) == "yes")
    no = ~yes & (F.col("model_eligibility") == "no")
    noted = F.col("model_note") != ""
    note_first = lambda c: F.when(noted, F.concat(F.array("model_note"), c)).otherwise(c)
    keep = lambda name, value: F.when(yes, value).otherwise(F.col(name))
    updates = {
        "is_prospect": keep("is_prospect", F.lit(False)),
        "rejection_reason": F.when(yes, "").when(no & noted, F.col("model_note")).otherwise(F.col("rejection_reason")),
        "rejection_category": keep("rejection_category", F.lit("")),
        "eligibility": keep("eligibility", F.lit(f"{home} eligible (AI-confirmed)")),
        "remote_status": keep("remote_status", F.when(F.col("remote_status") != "", F.col("remote_status")).otherwise("Remote")),
        "opportunity_type": keep("opportunity_type", F.lit("Job")),
        "job_status": F.when(yes, "NEW").when(no, "Not eligible").otherwise(F.col("job_status")),
        "application_status": F.when(yes, "Not Applied").when(no, "Do not apply").otherwise(F.col("application_status")),
        "match_score": keep("match_score", F.least("match_score", F.lit(fv.PROMOTED_SCORE_CAP))),
        "match_reasons": F.when(yes, note_first(F.col("match_reasons"))).otherwise(F.col("match_reasons")),
        "concerns": F.when(yes, F.filter("concerns", lambda c: ~F.lower(c).contains("eligib")))
        .when(~no & a.isNotNull(), note_first(F.col("concerns"))).otherwise(F.col("concerns")),
    }
    return df.select(*[updates.get(c, F.col(c)).alias(c) for c in prospects.columns], "model_eligibility",
                     yes.alias("model_promoted"))


def _bounded(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(c.cast("int"), F.lit(0))))


def apply_fit(leads: DataFrame, verdicts: DataFrame, weight: float = fv.FIT_WEIGHT) -> DataFrame:
    """Adds model_fit, model_chance, model_verdict, has_fit_verdict; blends the score."""
    weight = max(0.0, min(1.0, weight))
    joined = leads.join(_latest(verdicts, "fit"), "fingerprint", "left")
    a, judged = F.col("answer"), F.col("answer").isNotNull()
    df = joined.select("*", judged.alias("has_fit_verdict"), _bounded(a["fit"]).alias("model_fit"),
                       _bounded(a["chance"]).alias("model_chance"), F.trim(F.coalesce(a["verdict"], F.lit(""))).alias("model_verdict"))
    named = lambda arr: F.filter(F.transform(F.coalesce(arr, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    said = lambda arr: F.transform(arr, lambda x: F.concat(F.lit("Assessed: "), x))
    strengths, gaps = named(a["strengths"]), named(a["gaps"])
    headline = F.array_compact(F.array(F.when(F.col("model_verdict") != "", F.format_string(
        "Verdict: %s — fit %d, reply chance %d", F.col("model_verdict"), F.col("model_fit"), F.col("model_chance")))))
    blended = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(
        F.col("match_score") * (1 - weight) + F.col("model_chance") * weight, 0))).cast("int")
    updates = {
        "match_reasons": F.concat(headline, "match_reasons", said(strengths)),
        "concerns": F.concat("concerns", said(gaps)),
        "potential_gaps": F.when(F.size(gaps) > 0, F.array_join(gaps, " · ")).otherwise(F.col("potential_gaps")),
        "match_score": blended,
    }
    cols = [F.when(F.col("has_fit_verdict"), updates[c]).otherwise(F.col(c)).alias(c) if c in updates else F.col(c) for c in leads.columns]
    return df.select(*cols, "has_fit_verdict", "model_fit", "model_chance", "model_verdict")


def long_shots(leads: DataFrame, floor: int = fv.MIN_CHANCE, min_kept: int = fv.MIN_KEPT, has_cv: bool = True) -> DataFrame:
    """Leads to set aside: below the chance floor, weakest first, but `min_kept` leads always
    stay. Stated the other way round so that nothing is ranked globally: of the weak leads the
    best few are rescued to top the list up, which is a bounded top-k."""
    if not has_cv or floor <= 0:
        return leads.limit(0)
    weak = F.col("has_fit_verdict") & (F.col("model_chance") < floor)
    below = leads.where(weak)
    if min_kept <= 0:
        return below
    above = leads.agg(F.count_if(~weak).alias("_above"))
    top = below.orderBy(F.desc("model_chance"), F.desc("seq")).limit(min_kept)
    place = Window.orderBy(F.desc("model_chance"), F.desc("seq"))  # over min_kept rows
    rescued = (top.select("posting_id", F.row_number().over(place).alias("_place"))
               .join(F.broadcast(above), F.col("_place") <= min_kept - F.col("_above"), "left_semi"))
    return below.join(F.broadcast(rescued.select("posting_id")), "posting_id", "left_anti")


#: Money to the last digit that a token can cost: rates have two decimals, prices six, by the million.
MONEY = "decimal(38,14)"


def spend(usage: DataFrame, limit: float | str, prices: DataFrame | None = None) -> DataFrame:
    """usage(seq, model, input, cache_written, cache_read, output) -> cost per call, spend
    before it, and whether it was admitted. Token counts are whole numbers and money is decimal, so
    a call at the limit is judged alike however the table is cut."""
    if prices is not None:
        usage = usage.join(prices.select("model", "price_in", "price_out"), "model", "left")
    else:
        usage = usage.select("*", F.lit(None).alias("price_in"), F.lit(None).alias("price_out"))
    count = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).cast("decimal(14,0)")
    rate = lambda r: F.lit(str(r)).cast("decimal(4,2)")
    price = lambda c, default: F.coalesce(F.col(c).cast("decimal(12,6)"), F.lit(str(default)).cast("decimal(12,6)"))
    tokens_in = (count("input") + count("cache_written") * rate(fv.CACHE_WRITE_RATE) + count("cache_read") * rate(fv.CACHE_READ_RATE)).cast("decimal(18,2)")
    by_million = (tokens_in * price("price_in", fv.MODEL_PRICE_IN) + count("output") * price("price_out", fv.MODEL_PRICE_OUT)).cast("decimal(32,8)")
    df = usage.withColumn("cost", (by_million * F.lit("0.000001").cast("decimal(6,6)")).cast(MONEY))
    df = running_total(df, F.col("cost"), "seq", "spent_before", kind=MONEY)
    return df.withColumn("admitted", F.col("spent_before") < F.lit(str(limit)).cast(MONEY)).drop("price_in", "price_out")
