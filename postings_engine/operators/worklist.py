"""Ranking, budgeted worklists and the search plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import any_of, has_any, no
from ..profile import SearchProfile

def report_keys() -> list[Column]:
    return [F.desc("match_score"), F.desc(F.coalesce("posted_at", F.timestamp_seconds(F.lit(0)))), F.asc("seq")]


def rank_leads(df: DataFrame) -> DataFrame:
    """Report order. A range-partitioned sort, so it scales with the leads."""
    return df.orderBy(*report_keys())


def _newest() -> Column:
    return F.desc(F.coalesce("posted_at", F.timestamp_seconds(F.lit(0))))


def worklist(df: DataFrame, store: DataFrame, preset: str, prof: SearchProfile, cap: int | None = None,
             sources: tuple = ()) -> DataFrame:
    """What to fetch next: rows the store cannot serve (by `key`), in preset order; the first `cap` if given."""
    served = store.select("key").distinct()
    pending = df.join(served, "key", "left_anti")
    title, where = F.col("n_title"), F.col("n_location")
    flag = lambda cond: F.desc(F.coalesce(cond, no()).cast("int"))
    if preset == "bodies":
        pending = pending.where(F.col("truncated_description") & F.col("source").isin(*sources)
                                & (F.col("url") != "") & F.col("relevance.passed"))
        order = [flag(has_any(where, prof.home_terms + prof.home_city_terms)), flag(has_any(title, prof.core_terms)), _newest()]
    elif preset in ("details", "details_deep"):
        second = prof.core_terms[1] if len(prof.core_terms) > 1 else ""
        order = [flag(title.contains(prof.primary) if prof.primary else no()),
                 flag(title.contains(second) if second else no()), _newest()]
    elif preset == "listing":
        terms = prof.core_terms + prof.secondary_terms
        relevant = has_any(F.lower("path"), terms) if terms else F.lit(True)
        pending = pending.groupBy("path", "key").agg(F.min("seq").alias("seq"))
        order = [flag(relevant)]
    else:
        raise ValueError(f"unknown preset {preset!r}")
    ordered = pending.orderBy(*order, "seq")
    return ordered if cap is None else ordered.limit(cap)


def search_plan(spark, prof: SearchProfile, deep: bool = True, max_queries: int | None = None) -> DataFrame:
    """Every (keywords, region, job type) search, in order. Sized by the profile alone. A shallow plan
    keeps the later sweeps to the first regions; `max_queries` bounds the keywords of each sweep."""
    geos = spark.createDataFrame([(i, n, g) for i, (n, g) in enumerate(fv.SEARCH_GEOS)], "pos int, region string, geo_id string")
    wanted = {r.lower() for r in prof.target_regions} | ({prof.home_country.lower()} if prof.home_country else set())
    if wanted:
        keep = F.lower("region").isin(*wanted) | (F.col("region") == "Worldwide")
        if wanted & set(fv.EUROPE_MEMBERS):
            keep = keep | (F.col("region") == "Europe")
        chosen = geos.where(keep)
        # a choice of nothing but "Worldwide" falls back to every region
        n = chosen.agg(F.count(F.lit(1)).alias("n"))
        geos = geos.join(F.broadcast(n)).where((F.col("n") <= 1) | keep).drop("n")
    from pyspark.sql import Window
    geos = geos.withColumn("rank", F.row_number().over(Window.orderBy("pos")))  # at most 22 rows
    queries = tuple(q for q in (prof.search_queries or (prof.query,)) if q)
    broader = tuple(t for t in prof.secondary_terms if " " in t)[:max_queries] or queries[:max_queries]
    sweeps = [(1, i, q, "", "") for i, q in enumerate(queries[:max_queries])] + [(2, i, q, "", "") for i, q in enumerate(broader)]
    sweeps += [(3, j * len(queries) + i, q, code, label) for j, (code, label) in enumerate(fv.JOB_TYPE_SWEEPS) for i, q in enumerate(queries[:max_queries])]
    table = spark.createDataFrame(sweeps, "sweep int, n int, keywords string, job_type string, label string")
    cap = F.when(F.col("sweep") == 2, fv.SECONDARY_GEOS).when(F.col("sweep") == 3, fv.JOB_TYPE_GEOS)
    within = F.lit(True) if deep else F.coalesce(F.col("rank") <= cap, F.lit(True))
    return (table.join(F.broadcast(geos), within).orderBy("sweep", "n", "rank")
            .select("sweep", "keywords", "region", "geo_id", "job_type", "label"))
