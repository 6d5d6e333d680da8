"""Registered queries, second part: duplicates, verdicts, state, roll-ups, ranking, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from postings_engine import fixed_values as fv
from postings_engine.functions import text
from postings_engine.operators import aggregate, dedupe, enrich, relevance, state, verdicts, worklist
from postings_engine.plans import screen as screening
from postings_engine.session import written
from postings_engine.sinks import reports
from postings_engine.sources import feeds, json_feeds, pages as page_src, rss

from . import sql as S
from .catalogue import (_ALL_SQL, ORACLE, PROFILE, QUERIES, RUN, all_leads, base, listed, matched, query, screened, stamp,
                        stamp_sql)
from .projection import postings, read, with_run_ts


# ===================================================================== duplicates

def keyed(spark, sf):
    return text.add_keys(base(spark, sf))


_VARIANT = """va AS (SELECT kf.*, coalesce((SELECT arg_min(b.company_slug, length(b.company_slug)) FROM (SELECT DISTINCT title_slug, company_slug FROM kf) b
  WHERE kf.title_slug <> '' AND b.title_slug = kf.title_slug AND length(b.company_slug) >= 5 AND starts_with(kf.company_slug, b.company_slug)), company_slug) AS stem FROM kf),
vk AS (SELECT * EXCLUDE (fingerprint), substr(sha1(stem || '|' || title_slug), 1, 16) AS fingerprint FROM va)"""
_ALIAS = """ua AS (SELECT *, CASE WHEN url_key <> '' THEN first_value(fingerprint) OVER (PARTITION BY url_key ORDER BY seq) ELSE fingerprint END AS merge_key FROM vk)"""


@query("dup_1_variant_key", S.select("SELECT posting_id, fingerprint FROM vk", S.P, S.K, _VARIANT))
def _(spark, sf):
    return dedupe.variant_key(keyed(spark, sf)).select("posting_id", "fingerprint")


@query("dup_2_url_alias", S.select("SELECT posting_id, merge_key FROM ua", S.P, S.K, _VARIANT, _ALIAS))
def _(spark, sf):
    return dedupe.url_alias(dedupe.variant_key(keyed(spark, sf))).select("posting_id", "merge_key")


def slim_leads(spark, sf):
    """Postings with the lead columns the merge reads, straight from the tables."""
    df = enrich.enrich(keyed(spark, sf))
    return df.select("posting_id", "seq", "source", F.array("source").alias("sources"), "fingerprint", "company_slug", "title_slug", "url_key", "title",
                     "company", "posted_at", "salary_min", "salary_max", "salary_currency", F.lit(None).cast("double").alias("day_rate_min"),
                     (F.length("description") % 50 + 40).alias("match_score"), "description", "application_url", "original_job_url", *dedupe.FILLED)


_PREPARED = [S.P, S.K, _VARIANT, _ALIAS]


@query("dup_3_merge_duplicates", S.select("""SELECT merge_key AS fingerprint, CAST(count(*) AS BIGINT) AS copies, CAST(min(seq) AS BIGINT) AS first_seq,
  array_to_string(list_sort(list(DISTINCT source)), ' | ') AS sources FROM ua GROUP BY merge_key""", *_PREPARED))
def _(spark, sf):
    """Group sizes and sources."""
    df = dedupe.deduplicate(slim_leads(spark, sf), materialise=False)
    return df.select("fingerprint", "copies", "first_seq", listed("sources").alias("sources"))


_ENRICHED = f"""eu AS (SELECT ua.merge_key, ua.seq, en.* EXCLUDE (seq), length(en.description) % 50 + 40 AS match_score, CAST(NULL AS DOUBLE) AS day_rate_min FROM ua JOIN en USING (posting_id))"""


@query("dup_3_merged_rows", "WITH RECURSIVE " + ", ".join([*_PREPARED, S.enrich_ctes("p"), _ENRICHED, S.merged_ctes("eu")]) + f""" SELECT merge_key AS fingerprint, posting_id, {', '.join(S.FILLED)},
  salary_min, salary_max, salary_currency, CAST(copies AS BIGINT) AS copies, CAST({S.AGE} AS INTEGER) AS job_age_days FROM mg""")
def _(spark, sf):
    """Which copy survives, and every field that it ends up with."""
    df = dedupe.deduplicate(slim_leads(spark, sf), RUN_OF(spark, sf), PROFILE.timezone)
    return df.select("fingerprint", "posting_id", *dedupe.FILLED, "salary_min", "salary_max", "salary_currency", "copies", "job_age_days")


def RUN_OF(spark, sf):
    return F.lit(read(spark, sf, "events").agg(F.max("ts").cast("timestamp")).first()[0])


_pairs = """(a.title_slug = b.title_slug AND a.title_slug <> '' AND least(length(a.company_slug), length(b.company_slug)) >= 5
  AND (starts_with(a.company_slug, b.company_slug) OR starts_with(b.company_slug, a.company_slug)))"""


@query("dup_4_same_role_join", S.select(f"""SELECT a.posting_id, CAST(count(*) AS BIGINT) AS n FROM kf a JOIN kf b ON {_pairs} WHERE a.seq % 2 = 0 AND b.seq % 2 = 1 GROUP BY a.posting_id""", S.P, S.K))
def _(spark, sf):
    """Matches per even posting among the odd ones."""
    df = keyed(spark, sf)
    return dedupe.same_role_join(df.where("seq % 2 = 0"), df.where("seq % 2 = 1")).where("same_role > 0").select("posting_id", F.col("same_role").alias("n"))


@query("dup_4_same_role_whole", S.select(f"""SELECT a.posting_id, CAST(count(b.seq) AS BIGINT) AS n FROM kf a LEFT JOIN kf b ON {_pairs} GROUP BY a.posting_id""", S.P, S.K))
def _(spark, sf):
    """Every posting against the whole table."""
    df = keyed(spark, sf)
    return dedupe.same_role_join(df, df.select("title_slug", "company_slug")).select("posting_id", F.col("same_role").alias("n"))


@query("dup_5_drop_covered", S.select(f"""SELECT a.posting_id FROM kf a WHERE a.seq % 3 = 0 AND NOT EXISTS (SELECT 1 FROM kf b WHERE b.seq % 7 = 1 AND (a.fingerprint = b.fingerprint OR {_pairs}))""", S.P, S.K))
def _(spark, sf):
    df = keyed(spark, sf)
    return dedupe.drop_covered(df.where("seq % 3 = 0"), df.where("seq % 7 = 1")).select("posting_id")


@query("dup_6_sheet_dedupe", S.select("SELECT posting_id FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN seq % 2 = 0 THEN fingerprint ELSE lower(company || '|' || title) END ORDER BY seq) AS rn FROM kf) WHERE rn = 1", S.P, S.K))
def _(spark, sf):
    df = keyed(spark, sf).withColumn("fingerprint", F.when(F.col("seq") % 2 == 0, F.col("fingerprint")).otherwise(""))
    return dedupe.sheet_dedupe(df).select("posting_id")


# ======================================================================= verdicts

def leads_of(spark, sf):
    """One lead per document: keys and a score, straight from the tables."""
    d = read(spark, sf, "documents")
    return with_run_ts(spark, sf, d.select(
        F.col("doc_id").cast("string").alias("posting_id"), F.col("doc_id").alias("seq"), F.md5(F.col("doc_id").cast("string")).alias("fingerprint"),
        (F.col("n_chars") % 101).cast("int").alias("match_score"), F.array(F.lit("base")).alias("match_reasons"),
        F.array(F.lit("Eligibility unclear"), F.lit("No pay")).alias("concerns"), F.lit("").alias("potential_gaps"), F.lit(True).alias("is_prospect"),
        F.lit("not confirmed").alias("rejection_reason"), F.lit("ineligible").alias("rejection_category"), F.lit("Unconfirmed").alias("eligibility"),
        F.lit("").alias("remote_status"), F.lit("Prospect").alias("opportunity_type"), F.lit("x").alias("job_status"), F.lit("y").alias("application_status")))


def verdicts_of(spark, sf):
    """Labelled documents as answers: both kinds, two answers each, the later one counts."""
    lab = read(spark, sf, "labels")
    old = lab.select("*", F.lit(False).alias("late")).unionByName(lab.select("*", F.lit(True).alias("late")))
    day = F.expr("timestamp'2024-01-01 00:00:00'") + F.make_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("doc_id") % 28).cast("int"))
    common = old.select(
        "doc_id", "late", F.md5(F.col("doc_id").cast("string")).alias("fingerprint"), F.lit("yes").alias("remote"),
        F.expr("CASE WHEN NOT late THEN 'unclear' WHEN quality = 1 THEN 'yes' WHEN toxic = 1 THEN 'no' ELSE 'unclear' END").alias("eligible"),
        F.lit("because").alias("reason"), F.lit("").alias("evidence"), F.expr("CASE WHEN late THEN 100 + quality ELSE 0 END").alias("fit"),
        F.expr("CASE WHEN late THEN doc_id % 70 ELSE 99 END").cast("int").alias("chance"), F.lit("worth applying").alias("verdict"),
        F.array(F.lit("a"), F.lit(" "), F.lit("b"), F.lit("c"), F.lit("d")).alias("strengths"), F.array(F.lit("gap")).alias("gaps"),
        F.when(F.col("late"), day).otherwise(F.expr("timestamp'2023-01-01 00:00:00'")).alias("fetched_at"))
    return common.withColumn("kind", F.explode(F.array(F.lit("eligibility"), F.lit("fit"))))


_AGE_DAYS = f"(epoch({S.RUN}) - epoch(TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 28 AS INTEGER)))) / 86400"


@query("ver_1_worklist", f"""SELECT CAST(doc_id AS VARCHAR) AS posting_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND {_AGE_DAYS.replace('doc_id', 'l.doc_id')} <= 21)
  ORDER BY n_chars % 101 DESC, doc_id LIMIT 120""")
def _(spark, sf):
    return verdicts.verdict_worklist(leads_of(spark, sf), verdicts_of(spark, sf), "fit", RUN_OF(spark, sf), 21, 120).select("posting_id")


@query("ver_2_eligibility", """SELECT CAST(d.doc_id AS VARCHAR) AS posting_id, coalesce(CASE WHEN quality = 1 THEN 'yes' WHEN toxic = 1 THEN 'no' ELSE 'unclear' END, '') AS model_eligibility,
  CASE WHEN quality = 1 THEN least(n_chars % 101, 84) ELSE n_chars % 101 END::INT AS match_score, CASE WHEN quality = 1 THEN 'Not Applied' WHEN toxic = 1 AND quality IS NOT NULL AND quality <> 1 THEN 'Do not apply' ELSE 'y' END AS application_status,
  CASE WHEN quality = 1 THEN 1 WHEN quality IS NULL OR toxic = 1 THEN 2 ELSE 3 END AS n_concerns FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""".replace("coalesce(CASE WHEN quality = 1", "CASE WHEN quality IS NULL THEN '' ELSE coalesce(CASE WHEN quality = 1").replace("END, '') AS model", "END, '') END AS model"))
def _(spark, sf):
    df = verdicts.apply_eligibility(leads_of(spark, sf), verdicts_of(spark, sf), PROFILE.home_label)
    return df.select("posting_id", "model_eligibility", "match_score", "application_status", F.size("concerns").alias("n_concerns"))


@query("ver_3_fit_blend", """SELECT CAST(d.doc_id AS VARCHAR) AS posting_id, CASE WHEN l.doc_id IS NULL THEN CAST(n_chars % 101 AS INTEGER) ELSE
  CAST(least(greatest(round_even((n_chars % 101) * (1 - 0.4::DOUBLE) + (l.doc_id % 70) * 0.4::DOUBLE, 0), 0), 100) AS INTEGER) END AS match_score,
  CASE WHEN l.doc_id IS NULL THEN 1 ELSE 6 END AS n_reasons FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _(spark, sf):
    df = verdicts.apply_fit(leads_of(spark, sf), verdicts_of(spark, sf))
    return df.select("posting_id", "match_score", F.size("match_reasons").alias("n_reasons"))


@query("ver_4_long_shots", """SELECT CAST(d.doc_id AS VARCHAR) AS posting_id FROM documents d JOIN labels l USING (doc_id) WHERE doc_id % 70 < 30""")
def _(spark, sf):
    return verdicts.long_shots(verdicts.apply_fit(leads_of(spark, sf), verdicts_of(spark, sf))).select("posting_id")


_COST_UNITS = """((user_id * 10 * 100 + user_id * 125 + CAST(floor(value) AS BIGINT) * 10)::HUGEINT * CASE event_id % 3 WHEN 0 THEN 3000000 WHEN 1 THEN 150000 ELSE 5000000 END
  + (event_id % 500) * 100 * CASE event_id % 3 WHEN 0 THEN 15000000 WHEN 1 THEN 600000 ELSE 25000000 END::HUGEINT)"""


@query("ver_4_long_shots_kept", """WITH a AS (SELECT count(*) AS kept FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 70 < 69)),
  w AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id % 70 DESC, doc_id DESC) AS place FROM documents JOIN labels USING (doc_id) WHERE doc_id % 70 < 69)
  SELECT CAST(doc_id AS VARCHAR) AS posting_id FROM w, a WHERE place > (SELECT count(*) FROM labels) // 10""")
def _(spark, sf):
    """Nearly all are weak; as many as a tenth of the verdicts are kept beside those without one."""
    leads, found = leads_of(spark, sf), verdicts_of(spark, sf)
    judged = verdicts.apply_fit(leads, found)
    above = judged.where(~(F.col("has_fit_verdict") & (F.col("model_chance") < 69))).count()
    more = read(spark, sf, "labels").count() // 10
    return verdicts.long_shots(judged, floor=69, min_kept=above + more).select("posting_id")


@query("ver_5_spend", f"""WITH c AS (SELECT event_id, {_COST_UNITS} AS cost FROM events), s AS (SELECT event_id, cost, sum(cost) OVER (ORDER BY event_id) - cost AS spent FROM c),
  half AS (SELECT spent FROM s WHERE event_id = (SELECT max(event_id) // 2 FROM s))
  SELECT event_id, CAST(cost AS VARCHAR) AS cost, CAST(s.spent AS VARCHAR) AS spent_before, s.spent < half.spent AS admitted FROM s, half""")
def _(spark, sf):
    """Priced by a table that lacks one of three models; the limit is what a call in the middle finds spent, to the last digit."""
    events = read(spark, sf, "events")
    usage = events.select("event_id", F.col("event_id").alias("seq"), F.concat(F.lit("m"), F.col("event_id") % 3).alias("model"), (F.col("user_id") * 10).alias("input"),
                          F.col("user_id").alias("cache_written"), F.floor("value").alias("cache_read"), (F.col("event_id") % 500).alias("output"))
    prices = spark.createDataFrame([("m0", 3.0, 15.0), ("m1", 0.15, 0.6)], "model string, price_in double, price_out double")
    middle = events.agg(F.floor(F.max("event_id") / 2)).first()[0]
    limit = verdicts.spend(usage, 0, prices).where(F.col("event_id") == middle).first()["spent_before"]
    units = lambda c: (F.col(c) * F.lit("100000000000000").cast("decimal(15,0)")).cast("decimal(38,0)").cast("string")
    return verdicts.spend(usage, limit, prices).select("event_id", units("cost").alias("cost"), units("spent_before").alias("spent_before"), "admitted")


# ========================================================================== state

def seen_of(spark, sf):
    d = read(spark, sf, "documents").where("doc_id % 3 <> 0")
    return d.select(F.md5((F.col("doc_id") % 400).cast("string")).alias("fingerprint")).distinct().select(
        "fingerprint", F.lit("t").alias("title"), F.lit("c").alias("company"), F.lit("u").alias("url"), F.lit("2024-01-01").cast("date").alias("first_seen"),
        F.lit("2024-01-02").cast("date").alias("last_seen"), F.lit(4).cast("bigint").alias("times_seen"), F.lit(55).alias("best_match_score"),
        F.lit("Applied").alias("application_status"), F.lit("").alias("notes"))


def batch_of(spark, sf):
    df = leads_of(spark, sf).where("seq % 2 = 0").withColumn("fingerprint", F.md5((F.col("seq") % 500).cast("string")))
    return df.select("posting_id", "seq", "fingerprint", "match_score", F.concat(F.lit("t"), "posting_id").alias("title"), F.lit("c").alias("company"), F.lit("u").alias("original_job_url"))


_SEEN = """s AS (SELECT DISTINCT md5((doc_id % 400)::VARCHAR) AS fingerprint FROM documents WHERE doc_id % 3 <> 0),
b AS (SELECT doc_id, md5((doc_id % 500)::VARCHAR) AS fingerprint, n_chars % 101 AS score FROM documents WHERE doc_id % 2 = 0),
g AS (SELECT fingerprint, count(*) AS hits, max(score) AS top, min(doc_id) AS first_row FROM b GROUP BY fingerprint)"""


@query("sta_1_upsert_seen", f"""WITH {_SEEN} SELECT coalesce(s.fingerprint, g.fingerprint) AS fingerprint, CAST(CASE WHEN s.fingerprint IS NULL THEN 0 ELSE 4 END + coalesce(hits, 0) AS BIGINT) AS times_seen,
  CAST(greatest(CASE WHEN s.fingerprint IS NOT NULL THEN 55 END, top) AS INTEGER) AS best_match_score, CASE WHEN s.fingerprint IS NULL THEN 'Not Applied' ELSE 'Applied' END AS application_status,
  CASE WHEN s.fingerprint IS NULL THEN '2024-02-01' ELSE '2024-01-01' END AS first_seen, CASE WHEN g.fingerprint IS NULL THEN '2024-01-02' ELSE '2024-02-01' END AS last_seen
  FROM s FULL OUTER JOIN g ON s.fingerprint = g.fingerprint""")
def _(spark, sf):
    registry, _ = state.upsert_seen(seen_of(spark, sf), batch_of(spark, sf), F.lit("2024-02-01").cast("date"))
    return registry.select("fingerprint", "times_seen", "best_match_score", "application_status", F.col("first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"))


@query("sta_1_labelled_leads", f"""WITH {_SEEN} SELECT CAST(b.doc_id AS VARCHAR) AS posting_id, s.fingerprint IS NULL AND b.doc_id = g.first_row AS is_new, CASE WHEN s.fingerprint IS NULL THEN 'Not Applied' ELSE 'Applied' END AS application_status
  FROM b JOIN g USING (fingerprint) LEFT JOIN s USING (fingerprint)""")
def _(spark, sf):
    _, leads = state.upsert_seen(seen_of(spark, sf), batch_of(spark, sf), F.lit("2024-02-01").cast("date"))
    return leads.select("posting_id", "is_new", "application_status")


_STORE = "st AS (SELECT user_id::VARCHAR AS key, props AS payload, ts AS fetched_at FROM events)"
_DAYS = f"(epoch_us({S.RUN}) - epoch_us(fetched_at)) / 86400000000.0"


def store_of(spark, sf):
    e = read(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("fetched_at"))


def latest_store(spark, sf):
    s = store_of(spark, sf)
    return state.store_put(s.limit(0), s)


_LATEST = f"{_STORE}, lt AS (SELECT key, arg_max(payload, (fetched_at, payload)) AS payload, max(fetched_at) AS fetched_at FROM st GROUP BY key)"


@query("sta_2_set_status", f"WITH {_SEEN} SELECT fingerprint, CASE WHEN fingerprint IN (SELECT md5(doc_id::VARCHAR) FROM labels) THEN 'Interview' ELSE 'Applied' END AS application_status FROM s")
def _(spark, sf):
    updates = read(spark, sf, "labels").select(F.md5(F.col("doc_id").cast("string")).alias("fingerprint"), F.lit("Interview").alias("application_status")).distinct()
    return state.set_status(seen_of(spark, sf), updates).select("fingerprint", "application_status")


@query("sta_3_seen_stats", f"WITH {_SEEN} SELECT CAST(count(*) AS BIGINT) AS total_tracked, CAST(count(*) AS BIGINT) AS applied FROM s")
def _(spark, sf):
    return state.seen_stats(seen_of(spark, sf))


@query("sta_4_store_put", f"WITH {_LATEST} SELECT key, payload, {stamp_sql('fetched_at')} AS fetched FROM lt")
def _(spark, sf):
    return latest_store(spark, sf).select("key", "payload", stamp("fetched_at").alias("fetched"))


@query("sta_4_store_get", f"WITH {_LATEST} SELECT key, payload FROM lt WHERE {_DAYS} <= 0.5 AND key IN (SELECT DISTINCT c_custkey::VARCHAR FROM customer)")
def _(spark, sf):
    keys = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return state.store_get(latest_store(spark, sf), keys, 0.5, RUN_OF(spark, sf)).select("key", "payload")


@query("sta_4_store_stats", f"WITH {_STORE} SELECT CAST(count(*) AS BIGINT) AS entries, round(max({_DAYS}), 6) AS oldest_days FROM st WHERE {_DAYS} <= 20")
def _(spark, sf):
    now = RUN_OF(spark, sf)
    return state.store_stats(state.store_prune(store_of(spark, sf), 20, now), now).select("entries", F.round("oldest_days", 6).alias("oldest_days"))


@query("sta_5_split_ttl", f"SELECT event_id, event_type AS body, CASE WHEN {_DAYS.replace('fetched_at', 'ts')} <= 2 THEN props ELSE '' END AS applicants FROM events WHERE {_DAYS.replace('fetched_at', 'ts')} <= 21")
def _(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.col("event_type").alias("body"), F.col("props").alias("applicants"), F.col("ts").cast("timestamp").alias("fetched_at"))
    return state.store_get_split(e, "body", "applicants", 21, 2, RUN_OF(spark, sf)).select("event_id", "body", "applicants")


@query("sta_6_label_prospects", """SELECT CAST(doc_id AS VARCHAR) AS posting_id, CASE WHEN doc_id % 4 = 0 THEN 'Not eligible (AI-checked)' WHEN doc_id % 2 = 1 THEN 'NEW — needs verification' ELSE 'Needs verification' END AS job_status,
  CASE WHEN doc_id % 4 = 0 THEN 'Do not apply' WHEN doc_id % 3 = 0 THEN 'Ask about pay before applying' ELSE 'Ask before applying' END AS application_status FROM documents""")
def _(spark, sf):
    df = leads_of(spark, sf).withColumns({"model_eligibility": F.when(F.col("seq") % 4 == 0, "no").otherwise(""), "is_new": F.col("seq") % 2 == 1,
                                          "rejection_category": F.when(F.col("seq") % 3 == 0, "pay_unstated").otherwise("ineligible")})
    return state.label_prospects(df).select("posting_id", "job_status", "application_status")


# ================================================================ roll-ups, ranking

@query("agg_1_funnel", _ALL_SQL + f""" SELECT 'screened' AS stage, count(*) AS n FROM o UNION ALL SELECT 'passed', count(*) FROM o WHERE category = ''
  UNION ALL SELECT 'undated_kept', count(*) FROM rr WHERE gate = 0 AND posted_at IS NULL
  UNION ALL SELECT v.c, count(o.posting_id) FROM (VALUES {', '.join(f"('{c}')" for c in aggregate.FUNNEL_STAGES)}) v(c) LEFT JOIN o ON o.category = v.c GROUP BY v.c""")
def _(spark, sf):
    return aggregate.funnel(screened(spark, sf))


@query("agg_1_funnel_observed", ORACLE["agg_1_funnel"])
def _(spark, sf):
    """Counted while the screened table is written."""
    rows, counted = aggregate.observed_funnel(screened(spark, sf))
    written(rows.select("route", "category", "match_score"), "observed")
    return counted()


_LEADS = [S.P, S.N, S.elig_ctes("n"), f"v AS (SELECT * EXCLUDE (remote_status), CASE WHEN el_category = 'not_remote' THEN {S.ARR_LABEL} ELSE remote_status END AS remote_status FROM el)", S.lead_ctes("v")]


@query("agg_2_buckets", S.select("""SELECT b AS bucket, CAST(sum(h) AS BIGINT) AS n FROM (SELECT unnest(['qualified', 'hot_leads', 'full_time', 'part_time', 'contract', 'freelance', 'startups', 'partnerships']) AS b,
  unnest([1, (match_score >= 85)::INT, (employment_type = 'Full Time')::INT, (employment_type = 'Part Time')::INT, (employment_type = 'Contract')::INT, (employment_type = 'Freelance')::INT, is_startup::INT, is_partnership::INT]) AS h FROM sc) GROUP BY b""", *_LEADS))
def _(spark, sf):
    return aggregate.buckets(all_leads(spark, sf))


@query("agg_3_level_counts", S.select("""SELECT CAST(count(*) FILTER (experience_level = 'Beginner') AS BIGINT) AS level_beginner, CAST(count(*) FILTER (experience_level = 'Medium') AS BIGINT) AS level_medium,
  CAST(count(*) FILTER (experience_level = 'Senior') AS BIGINT) AS level_senior, CAST(count(*) FILTER (experience_level = 'Not specified') AS BIGINT) AS level_unspecified FROM sc""", *_LEADS))
def _(spark, sf):
    return aggregate.level_counts(all_leads(spark, sf))


@query("agg_4_company_directory", S.select(f"""SELECT lower({S.NAME}) AS company_key, arg_min({S.NAME}, seq) AS company, CAST(count(*) AS BIGINT) AS opportunities, max(match_score) AS best_match_score, max(networking_score) AS networking_score,
  coalesce(arg_max(industry, seq) FILTER (industry <> '{fv.DEFAULT_INDUSTRY}'), arg_min(industry, seq)) AS industry, coalesce(arg_min(public_email, seq) FILTER (public_email <> ''), '') AS public_email,
  coalesce(arg_min(careers_page, seq) FILTER (careers_page <> ''), '') AS careers_page FROM sc GROUP BY 1""", *_LEADS))
def _(spark, sf):
    df = aggregate.company_directory(all_leads(spark, sf))
    return df.select("company_key", "company", "opportunities", "best_match_score", "networking_score", "industry", "public_email", "careers_page")


@query("agg_4_company_roles", S.select(f"""SELECT lower({S.NAME}) AS company_key, trim(title) AS title, CAST(min(seq) AS BIGINT) AS first_seq FROM sc WHERE {S.NAME} <> '' GROUP BY 1, 2""", *_LEADS))
def _(spark, sf):
    return aggregate.company_roles(all_leads(spark, sf)).select("company_key", "title", "first_seq")


@query("agg_4_directory_of_orders", """SELECT lower(trim(c_mktsegment)) AS company_key, CAST(count(*) AS BIGINT) AS opportunities, strftime(max(o_orderdate), '%Y-%m-%d') AS latest,
  array_to_string(list_transform(list_sort(list(DISTINCT o_orderpriority)), lambda x: x), '; ') AS roles FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def _(spark, sf):
    df = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    blank = {c: F.lit("") for c in aggregate._CONTACTS}
    leads = df.withColumns({"company": F.col("c_mktsegment"), "title": F.col("o_orderpriority"), "seq": F.col("o_orderkey"), "match_score": F.lit(1), "networking_score": F.lit(1),
                            "posted_date": F.to_date("o_orderdate"), "industry": F.lit(""), "startup_stage": F.lit("N/A"), "company_size": F.lit(""), **blank})
    out = aggregate.company_directory(leads, joined_roles=True)
    return out.select("company_key", "opportunities", F.col("latest_posted").cast("string").alias("latest"), F.array_join(F.array_sort(F.split("roles", "; ")), "; ").alias("roles"))


@query("top_1_rank_leads", "SELECT CAST(doc_id AS VARCHAR) AS posting_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars % 101 DESC, coalesce(ts, TIMESTAMP '1970-01-01') DESC, doc_id) AS place FROM documents LEFT JOIN events ON event_id = doc_id AND doc_id % 3 > 0) WHERE place <= 50")
def _(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("posted_at")).where("seq % 3 > 0")
    df = leads_of(spark, sf).join(e, "seq", "left")
    return worklist.rank_leads(df).limit(50).select("posting_id")


_WL = """wl AS (SELECT posting_id, seq FROM n WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE CAST(l.doc_id AS VARCHAR) = posting_id AND l.doc_id % 2 = 0) {0} ORDER BY {1}, coalesce(posted_at, TIMESTAMP '1970-01-01') DESC, seq LIMIT {2})"""


def _candidates(spark, sf):
    df = relevance.relevance(matched(spark, sf), PROFILE).withColumn("key", F.col("posting_id"))
    served = read(spark, sf, "labels").where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("key"))
    return df, served


@query("top_2_worklist_details", S.select("SELECT posting_id FROM wl", S.P, S.N, _WL.format("", "contains(n_title, 'electrician') DESC, contains(n_title, 'electrical') DESC", 60)))
def _(spark, sf):
    df, served = _candidates(spark, sf)
    return worklist.worklist(df, served, "details", PROFILE, 60).select("posting_id")


_home_case = S.any_in("n_location", PROFILE.home_terms + PROFILE.home_city_terms)


@query("top_2_worklist_bodies", S.select("SELECT posting_id FROM wl", S.P, S.N, S.REL, _WL.replace("FROM n WHERE", "FROM rel WHERE").format(
    "AND truncated_description AND source IN ('src1', 'src2', 'src10') AND gate = 0 AND url <> ''", f"{_home_case} DESC, {S.any_in('n_title', PROFILE.core_terms)} DESC", 30)))
def _(spark, sf):
    df, served = _candidates(spark, sf)
    return worklist.worklist(df, served, "bodies", PROFILE, 30, ("src1", "src2", "src10")).select("posting_id")


@query("top_3_search_plan", """WITH g AS (SELECT * FROM (VALUES ('United Kingdom', 1), ('Worldwide', 2), ('Europe', 3)) t(region, rank)), s AS (SELECT * FROM (VALUES (1, 'electrician', ''), (1, 'industrial electrician', ''),
  (2, 'maintenance technician', ''), (2, 'controls engineer', ''), (3, 'electrician', 'C'), (3, 'industrial electrician', 'C'), (3, 'electrician', 'P'), (3, 'industrial electrician', 'P'), (3, 'electrician', 'T'), (3, 'industrial electrician', 'T')) t(sweep, keywords, job_type))
  SELECT sweep, keywords, job_type, region, (SELECT CAST(count(*) AS BIGINT) FROM documents) AS n_documents FROM s, g""")
def _(spark, sf):
    """The plan, with how many postings it will be matched against."""
    n = read(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n_documents"))
    return worklist.search_plan(spark, PROFILE, deep=False).select("sweep", "keywords", "job_type", "region").join(F.broadcast(n))


@query("set_1_union_leads", "SELECT CAST(doc_id AS VARCHAR) AS posting_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 3 = 0")
def _(spark, sf):
    df = leads_of(spark, sf)
    return dedupe.union_leads(df.where("seq % 2 = 0"), df.where("seq % 3 = 0")).select("posting_id")


@query("set_2_set_aside", "SELECT CAST(doc_id AS VARCHAR) AS posting_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    moved = read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("posting_id"))
    return dedupe.set_aside(leads_of(spark, sf), moved).select("posting_id")


_FLOW = ["q AS (SELECT * FROM scr WHERE category = '')", S.K.replace("FROM p)", "FROM q)"), _VARIANT, _ALIAS, S.merged_ctes("ua")]


@query("flow_1_ranked_leads", f"""WITH RECURSIVE {', '.join([S.screen_ctes(), *_FLOW])} SELECT mg.merge_key AS fingerprint, posting_id, scr.title, {S.NAME} AS company, mg.match_score, cv_fit_score, remote_status,
  eligibility, CAST(copies AS BIGINT) AS copies FROM mg JOIN scr USING (posting_id)""")
def _(spark, sf):
    """The flagship: screen, collapse duplicates, rank."""
    qualified = screened(spark, sf).where("route = 'qualified'")
    merged = dedupe.deduplicate(qualified)
    return worklist.rank_leads(merged).select("fingerprint", "posting_id", "title", "company", "match_score", "cv_fit_score", "remote_status", "eligibility", "copies")
