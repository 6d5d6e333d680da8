"""State kept across runs: the seen registry and the payload store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import salted_lookup

SEEN_COLUMNS = ("fingerprint", "title", "company", "url", "first_seen", "last_seen", "times_seen",
                "best_match_score", "application_status", "notes")
SEEN_SCHEMA = ("fingerprint string, title string, company string, url string, first_seen date, last_seen date, "
               "times_seen bigint, best_match_score int, application_status string, notes string")


def upsert_seen(seen: DataFrame, leads: DataFrame, run_date: Column) -> tuple[DataFrame, DataFrame]:
    """(new registry, labelled leads). Leads are first reduced to one row per fingerprint on
    the map side; a repeated fingerprint counts as seen again, in seq order."""
    batch = leads.groupBy("fingerprint").agg(
        F.max_by(F.struct("title", "company", F.col("original_job_url").alias("url")), "seq").alias("last"),
        F.count(F.lit(1)).alias("hits"), F.max("match_score").alias("top"), F.min("seq").alias("first_row"))
    both = seen.select("fingerprint", F.struct(*[c for c in SEEN_COLUMNS if c != "fingerprint"]).alias("old")).join(
        batch, "fingerprint", "full_outer")
    old, last, hit = F.col("old"), F.col("last"), F.col("last").isNotNull()
    pick = lambda name: F.when(hit, last[name]).otherwise(old[name]).alias(name)
    registry = both.select(
        "fingerprint", pick("title"), pick("company"), pick("url"),
        F.coalesce(old["first_seen"], run_date).alias("first_seen"),
        F.when(hit, run_date).otherwise(old["last_seen"]).alias("last_seen"),
        (F.coalesce(old["times_seen"], F.lit(0)) + F.coalesce("hits", F.lit(0))).cast("bigint").alias("times_seen"),
        F.greatest(old["best_match_score"], "top").cast("int").alias("best_match_score"),
        F.coalesce(old["application_status"], F.lit("Not Applied")).alias("application_status"),
        F.coalesce(old["notes"], F.lit("")).alias("notes"))
    known = both.where(hit).select(
        "fingerprint", F.col("old").isNotNull().alias("_known"), old["first_seen"].alias("_first_seen"),
        F.coalesce(F.nullif(old["application_status"], F.lit("")), F.lit("Not Applied")).alias("_status"), "first_row")
    labelled = salted_lookup(leads, known, ["fingerprint"])
    new = ~F.col("_known") & (F.col("seq") == F.col("first_row"))
    made = {
        "is_new": new, "job_status": F.when(new, "NEW").otherwise("Seen previously"),
        "discovered_date": F.coalesce("_first_seen", run_date),
        "application_status": F.when(new, F.col("application_status")).otherwise(F.col("_status"))
        if "application_status" in leads.columns else F.col("_status"),
    }
    kept = [c for c in leads.columns if c not in made]
    return registry, labelled.select(*kept, *[v.alias(k) for k, v in made.items()])


def set_status(seen: DataFrame, updates: DataFrame) -> DataFrame:
    """updates(fingerprint, application_status), one row per fingerprint."""
    new = updates.select("fingerprint", F.col("application_status").alias("_status"))
    joined = seen.join(new, "fingerprint", "left")
    return joined.withColumn("application_status", F.coalesce("_status", "application_status")).drop("_status")


def seen_stats(seen: DataFrame) -> DataFrame:
    return seen.agg(F.count(F.lit(1)).alias("total_tracked"),
                    F.count_if(F.col("application_status") != "Not Applied").alias("applied"))


def save_version(df: DataFrame, root: str, version: int | str) -> str:
    """Write a full version beside the earlier ones; readers name the version they want, so
    a lost executor or a re-run never leaves a half-written state behind."""
    path = f"{root}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


# ------------------------------------------------------------------- payload store


def store_put(store: DataFrame, rows: DataFrame) -> DataFrame:
    """Latest payload per key wins."""
    both = store.select("key", "payload", "fetched_at").unionByName(rows.select("key", "payload", "fetched_at"))
    return both.groupBy("key").agg(F.max_by("payload", F.struct("fetched_at", "payload")).alias("payload"),
                                   F.max("fetched_at").alias("fetched_at"))


def age_in_days(fetched: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(fetched)) / (86400 * 1e6)


def store_get(store: DataFrame, keys: DataFrame, ttl_days: float, now: Column) -> DataFrame:
    """Requested keys with a payload no older than the lifetime; a lifetime <= 0 never hits."""
    if ttl_days <= 0:
        return store.limit(0)
    fresh = store.where(age_in_days(F.col("fetched_at"), now) <= ttl_days)
    return fresh.join(keys.select("key").distinct(), "key", "left_semi")


def store_prune(store: DataFrame, ttl_days: float, now: Column) -> DataFrame:
    return store.where(age_in_days(F.col("fetched_at"), now) <= ttl_days)


def store_stats(store: DataFrame, now: Column) -> DataFrame:
    return store.agg(F.count(F.lit(1)).alias("entries"),
                     F.coalesce(age_in_days(F.min("fetched_at"), now), F.lit(0.0)).alias("oldest_days"))


def store_get_split(store: DataFrame, body: str, volatile: str, ttl_body: float, ttl_volatile: float, now: Column) -> DataFrame:
    """One payload, two lifetimes: stale rows drop out, a volatile field blanks earlier."""
    age = age_in_days(F.col("fetched_at"), now)
    return (store.where(age <= ttl_body)
            .withColumn(volatile, F.when(age <= ttl_volatile, F.col(volatile)).otherwise(F.lit("")))
            .where(F.coalesce(F.col(body), F.lit("")) != ""))


def label_prospects(df: DataFrame) -> DataFrame:
    """Labels that say what still needs checking. Needs is_new and model_eligibility."""
    refused = F.coalesce(F.col("model_eligibility"), F.lit("")) == "no"
    status = F.when(refused, "Not eligible (AI-checked)").when(F.col("is_new"), "NEW — needs verification").otherwise("Needs verification")
    todo = (F.when(refused, "Do not apply").when(F.col("rejection_category") == "pay_unstated", "Ask about pay before applying")
            .otherwise("Ask before applying"))
    return df.withColumn("job_status", status).withColumn("application_status", todo)
