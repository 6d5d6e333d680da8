"""Postings derived from the given tables.

The tables hold no adverts, so each document becomes one: its own text, plus phrases picked by
remainders of its id, a URL from `pages`, a date from `events` and pay from `orders`. The SQL is
plain enough to run unchanged on Spark and on the checking engine, and it covers every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postings_engine import SearchProfile
from postings_engine.profile import home_of
from postings_engine.schema import to_postings

TITLES = ("Senior Electrician", "Electrical Engineer (Controls)", "Lead Electrical Technician - Ref: 48213", "Junior Electrician",
          "Recruiter - Electrical Trades", "Domestic Plumber", "Maintenance Technician", "Staff Controls Engineer",
          "Electrician, Full-Time", "Data Engineer", "Warehouse Operative", "Électricien Remote", "Sales Manager #1234")
COMPANIES = ("Brightspark Ltd", "Brightspark Energy Services", "Voltworks", "Voltworks Group Holdings", "Northwind Power | Local experts",
             "Acme", "Acme Electrical", "Siemens", "HireWell Recruitment", "", "Indeed", "Oakfield Care", "Café Lumière SARL",
             "Tiny Labs", "Meridian Freight GmbH", "The Digital Company", "Brightspark", "Kestrel & Sons", "Solway Rail PLC")
PLACES = ("London, UK", "Remote", "Leeds", "Worldwide", "Berlin, Germany", "Paris", "Greater Mumbai Metropolitan Area", "Lagos, Nigeria",
          "New York, United States", "Anywhere in Canada", "Anywhere", "Manchester", "Europe", "", "Karachi", "Dubai", "Remote - EMEA",
          "United Kingdom", "Toronto", "Warsaw, Poland", "Tokyo", "Bristol, England", "India")
ARRANGEMENTS = ("This is a fully remote role.", "Hybrid working, 3 days a week in the office.", "On-site at our depot every day.",
                "There is no hybrid requirement, work from home is fine.", "", "You will never be asked to commute; remote-first team.",
                "Office attendance is optional and the team is remote.")
GROUNDS = ("Open to candidates anywhere in the world.", "Must be located in Germany.", "UK residents welcome to apply.",
           "US citizens only.", "", "We hire globally through an employer of record.", "Candidates must be located in France, no exceptions.",
           "EU only.", "Our London office is lovely.", "Applicants from India only.", "You must have the right to work in the UK.")
YEARS = ("5+ years of experience required.", "", "Experience: at least 2 years.", "10 years of professional electrical work.", "Trading for 30 years of service.")
CONTACTS = ("Contact our Hiring Manager Jane Doe at careers@brightspark.example.", "", "Call (0113) 496 0000 today.", "Speak to Peter Parkes for details.",
            "No sponsorship available.", "Early applicants welcome.", "We are a recruitment agency and our client is growing.",
            "Series A startup, team of 12.", "51-200 employees in the fintech sector.", "Enterprise employer with 10000 people.",
            "Salary plus benefits, full time and permanent.", "Contract outside IR35, day rate.", "Part-time, 20 hours per week.",
            "Freelance gig for a software house, white label.", "Statement of work with a dedicated team.", "Occasional travel, overlap with pacific hours.",
            "Ann Marie Cole, Head of Operations")
TRADES = ("Electrician needed for electrical testing; electrical fault finding essential.", "Wiring, inspection and electrical safety, 18th edition. Electrician wanted.",
          "", "Electrical work is a bonus.", "Plumbing and gas fitting with some electrical maintenance.", "An electrician with PLC and solar skills; strong electrician background.")
PAY = ("£45,000 - £55,000 per annum", "60k-70k EUR", "£350 per day", "$30 per hour", "", "Competitive", "2024 rates: USD 500 day rate", "PLN 15 000", "€1.2m budget")
APPLY = ("", "https://jobs.lever.co/acme/123", "https://www.brightspark.example/careers/role-7", "https://boards.greenhouse.io/voltworks/jobs/9",
         "https://oakfield.example/vacancies", "https://Apply.Workable.com/Meridian/j/5", "https://www.kestrel.example/about", "https://remoteok.com/remote-jobs/77")
EMPLOYMENT = ("", "Full-time", "Contract", "Part time", "Freelance", "Internship", "")
CURRENCIES = ("GBP", "EUR", "USD", "XYZ")
APPLICANTS = ("", "Be among the first 25 applicants", "Over 200 applicants", "87 applicants", "1,024 applicants", "first 25")
TAGS = ("electrician,hands-on", "", "plumbing", "controls,plc,Élan")
SITES = ("", "https://www.voltworks.example/", "", "")


def pick(values, n: int, key: str = "doc_id") -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    arms = " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(values))
    return f"CASE {key} % {n} {arms} ELSE '' END"


def projection_sql() -> str:
    """SELECT over documents, events, orders and pages; one row per document."""
    phrases = " || ' ' || ".join(pick(v, n) for v, n in (
        (TRADES, 6), (ARRANGEMENTS, 7), (GROUNDS, 11), (YEARS, 5), (CONTACTS, 17)))
    return f"""
SELECT CAST(d.doc_id AS VARCHAR(20)) AS posting_id, d.doc_id AS seq, d.source AS source, 'doc-' || CAST(d.doc_id AS VARCHAR(20)) AS source_id,
  {pick(TITLES, 13)} AS title, {pick(COMPANIES, 19)} AS company, coalesce(p.url, '') AS url,
  d.text || ' ' || {phrases} AS description,
  {pick(PLACES, 23)} AS location_raw, {pick(APPLY, 8)} AS apply_url,
  CASE WHEN doc_id % 29 = 0 THEN NULL ELSE e.ts END AS posted_at,
  {pick(EMPLOYMENT, 7)} AS employment_type_raw, {pick(PAY, 9)} AS salary_raw,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE o.o_totalprice END AS salary_min,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE o.o_totalprice * 1.2 END AS salary_max,
  {pick(CURRENCIES, 4)} AS salary_currency, {pick(SITES, 4)} AS company_website, {pick(TAGS, 4)} AS tag_text,
  doc_id % 9 = 0 AS is_remote, doc_id % 10 = 0 AS truncated_description, {pick(APPLICANTS, 6)} AS applicants,
  doc_id % 12 = 0 AS direct_employer, '' AS company_linkedin
FROM (SELECT doc_id, text, source, doc_id % (SELECT count(*) FROM events) AS ek, doc_id % (SELECT count(*) FROM orders) AS ok,
        doc_id % (SELECT count(*) FROM pages) AS pk FROM documents) d
LEFT JOIN events e ON e.event_id = d.ek LEFT JOIN orders o ON o.o_orderkey = d.ok LEFT JOIN pages p ON p.page_id = d.pk"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    if documents.rdd.getNumPartitions() < cores:
        # one small file: spread the text work over the cores; a large table has its splits
        documents = documents.repartition(cores * 4)
    documents.createOrReplaceTempView("documents")
    for name in ("events", "orders", "pages"):
        read(spark, sf_dir, name).createOrReplaceTempView(name)
    df = spark.sql(projection_sql())
    tags = F.filter(F.split("tag_text", ","), lambda t: t != "")
    return to_postings(df.withColumn("tags", tags))


def run_ts(spark: SparkSession, sf_dir: str):
    """The run's clock: the last event. A single aggregate row, attached to the postings."""
    return read(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp").alias("run_ts"))


def with_run_ts(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(run_ts(spark, sf_dir)))  # one row, one column


PROFILE = SearchProfile(
    label="Electrical", query="electrician", core_terms=("electrician", "electrical"),
    secondary_terms=("maintenance technician", "controls engineer"),
    hands_on_title_tokens=("electrician", "engineer", "technician", "fitter"),
    hard_title_exclusions=("recruiter", "sales"), other_discipline_terms=("plumber", "data engineer"),
    competing_stacks={"plumbing": 5.0, "gas fitting": 4.0}, min_body_core_mentions=2,
    skills={"electrical": 9.0, "plc": 6.0, "solar": 5.5, "wiring": 4.0, "inspection": 3.0, "18th edition": 8.0, "fault finding": 2.5},
    domain_keywords={"fintech": 5.0, "depot": 2.0, "safety": 2.5}, seniority="Senior", years_experience=7, has_cv=True,
    region_terms=("europe", "emea", "european"), region_excluding_home_terms=("eu only", "eu-only", "eea only"),
    search_queries=("electrician", "industrial electrician"), salary_floor_usd=20000.0, timezone="Europe/London",
    work_arrangement="any", **home_of("uk"))
REMOTE_PROFILE = PROFILE.__class__(**{**PROFILE.__dict__, "work_arrangement": "remote"})
