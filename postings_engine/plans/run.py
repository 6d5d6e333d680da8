"""One end-to-end run over a postings table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import dedupe, gates
from ..operators.aggregate import company_directory, directory_order, funnel, observed_funnel
from ..operators.enrich import fill_contacts
from ..operators.state import label_prospects, upsert_seen
from ..operators.verdicts import apply_eligibility, apply_fit, long_shots
from ..operators.worklist import rank_leads
from ..profile import SearchProfile
from ..session import written
from .screen import screen


@dataclass
class RunResult:
    qualified: DataFrame
    prospects: DataFrame
    rejected: DataFrame
    long_shots: DataFrame
    companies: DataFrame
    funnel: DataFrame
    registry: DataFrame | None = None


def run(postings: DataFrame, prof: SearchProfile, run_ts: Column, seen: DataFrame | None = None, crawl: DataFrame | None = None,
        verdicts: DataFrame | None = None, contacts: DataFrame | None = None, sizes: DataFrame | None = None,
        materialise: bool = True) -> RunResult:
    """Screen, collapse duplicates, drop covered prospects and closed adverts, apply model
    verdicts and published contacts, label against the registry. The screened table feeds
    four outputs and the merged ones feed several more, so those are the two places where a
    result is written and its lineage cut."""
    keep = (lambda df, by=None: written(df, "run", by)) if materialise else (lambda df, by=None: df)
    screened, counted = screen(postings, prof, run_ts, sizes), None
    if materialise:
        screened, counted = observed_funnel(screened)
    screened = keep(screened, "route")  # each route reads its own part
    route = lambda name: screened.where(F.col("route") == name)
    merged_q = keep(dedupe.deduplicate(route("qualified"), run_ts, prof.timezone, materialise))
    merged_p = keep(dedupe.deduplicate(route("prospect"), run_ts, prof.timezone, materialise))
    copies = F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long").alias("n")
    removed = merged_q.agg(copies).union(merged_p.agg(copies)).agg(F.sum("n").alias("duplicates_removed"))
    # a merged row stands where the first of its copies stood
    place = lambda df: df.withColumn("seq", F.col("first_seq")).drop("copies", "first_seq")
    qualified = place(merged_q)
    prospects = dedupe.drop_covered(gates.keep_prospects(place(merged_p), prof), qualified)
    rejected = route("rejected")

    if crawl is not None:
        qualified, rejected = _split_closed(qualified, rejected, crawl)
        qualified = gates.clear_dead_links(qualified, crawl)
        prospects = gates.clear_dead_links(prospects, crawl)
    if verdicts is not None:
        prospects = apply_eligibility(prospects, verdicts, prof.home_label)
        promoted = prospects.where("model_promoted").drop("model_eligibility", "model_promoted")
        prospects = dedupe.set_aside(prospects, promoted)
        if crawl is not None:
            promoted, rejected = _split_closed(promoted, rejected, crawl)
        qualified = keep(apply_fit(dedupe.union_leads(qualified, promoted), verdicts))
        aside = long_shots(qualified, has_cv=prof.has_cv)
        qualified = dedupe.set_aside(qualified, aside)
        aside = aside.withColumn("job_status", F.lit("Long shot"))
    else:
        prospects = prospects.withColumn("model_eligibility", F.lit(""))
        aside = qualified.where(F.lit(False))
    if contacts is not None:
        qualified = fill_contacts(qualified, contacts)
    registry = None
    if seen is not None:
        run_day = F.to_date(F.from_utc_timestamp(run_ts, prof.timezone))
        registry, qualified = upsert_seen(seen, keep(qualified), run_day)
        registry, prospects = upsert_seen(registry, keep(prospects), run_day)
        prospects = label_prospects(prospects)
    directory = directory_order(company_directory(dedupe.union_leads(qualified, prospects)))
    counts = (counted() if counted else funnel(screened)).unionByName(removed.select(F.lit("duplicates_removed").alias("stage"), F.col("duplicates_removed").alias("n")))
    counts = counts.unionByName(qualified.agg(F.count(F.lit(1)).alias("n")).select(F.lit("qualified").alias("stage"), "n"))
    return RunResult(rank_leads(qualified), rank_leads(prospects), rejected, rank_leads(aside), directory, counts, registry)


def _split_closed(leads: DataFrame, rejected: DataFrame, crawl: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = gates.drop_closed(leads, crawl)
    gone = checked.where("closed").withColumns({
        "rejection_reason": F.col("closed_reason"), "rejection_category": F.lit("expired"), "category": F.lit("expired"),
        "job_status": F.lit("Closed"), "route": F.lit("rejected")})
    drop = lambda df: df.drop("closed", "closed_reason")
    return drop(checked.where(~F.col("closed"))), rejected.unionByName(drop(gone), allowMissingColumns=True)
