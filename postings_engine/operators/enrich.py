"""Contacts, employer site and careers page; details filled in from crawled pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.dates import posted_timestamp
from ..functions.text import (ascii_bounds, bare_host, html_to_text, mentions, no, records, strip_space, truncated,
                              unescape_entities, url_host, url_path, url_scheme)
from .skew import spread_blank

_BLANK = F.lit


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def best_email(c: Column) -> Column:
    # bounds of ASCII words: a letter that no address can hold ends one, it does not cut its host short
    trimmed = F.transform(F.regexp_extract_all(c, F.lit(f"({ascii_bounds(fv.EMAIL)})"), F.lit(1)),
                          lambda e: F.regexp_replace(e, r"^[.,;:]+|[.,;:]+$", ""))
    low = F.lower
    usable = F.filter(trimmed, lambda e: ~low(e).rlike(r"\.(?:" + "|".join(s[1:] for s in fv.ASSET_SUFFIXES) + ")$")
                      & ~mentions(low(e), fv.UNUSABLE_EMAIL_PARTS))
    preferred = F.filter(usable, lambda e: mentions(low(e), fv.PREFERRED_EMAIL_PARTS))
    return F.when(c.contains("@"), F.coalesce(F.get(preferred, F.lit(0)), F.get(usable, F.lit(0)), F.lit(""))).otherwise("")


def best_phone(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(f"({fv.PHONE})"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, r"\D", "")
    usable = F.filter(found, lambda p: F.length(digits(p)).between(9, 15) & ~digits(p).startswith("20"))
    return F.coalesce(F.trim(F.get(usable, F.lit(0))), F.lit(""))


def extract_contacts(df: DataFrame, col: str = "description") -> DataFrame:
    return df.select("*", best_email(F.col(col)).alias("public_email"), best_phone(F.col(col)).alias("public_phone"))


_CONTACTS = (
    (rf"(?:our|the)\s+({fv.ROLE_WORDS})[,:]?\s+({fv.PERSON_NAME})", 2, 1),
    (rf"({fv.PERSON_NAME}),\s*({fv.ROLE_WORDS})", 1, 2),
    (rf"(?:contact|speak to|reach out to|attention|attn\.?|ask for|please contact)\s+(?:our\s+)?({fv.PERSON_NAME})", 1, 0),
)


def extract_person(df: DataFrame, col: str = "description") -> DataFrame:
    """Named contact and role from the whole text; default role "Hiring contact"."""
    text = F.col(col)
    found = []
    for pattern, name_at, role_at in _CONTACTS:
        name = F.trim(F.regexp_extract(text, pattern, name_at))
        role = F.trim(F.regexp_extract(text, pattern, role_at)) if role_at else F.lit("")
        good = (name != "") & ~name.rlike(fv.NOT_A_PERSON)
        found.append(F.when(good, F.struct(name.alias("name"), role.alias("role"))))
    df = df.withColumn("_person", F.coalesce(*found))
    name, role = F.col("_person.name"), F.col("_person.role")
    return df.select("*", F.coalesce(name, F.lit("")).alias("best_contact_name"),
                     F.when(role != "", role).when(name.isNotNull(), "Hiring contact").otherwise("")
                     .alias("contact_role")).drop("_person")


def is_aggregator(url: Column) -> Column:
    host = bare_host(url)
    return (host == "") | mentions(host, fv.AGGREGATOR_HOSTS)


def _own_url(c: Column) -> Column:
    """The URL when it is the employer's own, else null."""
    return F.when((F.coalesce(c, F.lit("")) != "") & ~is_aggregator(c), c)


def employer_site(df: DataFrame, out: str = "company_website") -> DataFrame:
    """Given site, else the origin of an own URL, else an employer's e-mail domain.
    Needs public_email."""
    origin = lambda u: F.when(url_scheme(u) != "", F.concat(url_scheme(u), F.lit("://"), url_host(u)))
    domain = F.lower(F.regexp_extract("public_email", "@([^@]*)$", 1))
    own_domain = domain.contains(".") & ~mentions(domain, fv.AGGREGATOR_HOSTS) & ~domain.isin(*fv.FREE_MAILBOXES)
    return df.withColumn(out, F.coalesce(
        blank_to_null(F.col("company_website")), origin(_own_url(F.col("apply_url"))), origin(_own_url(F.col("url"))),
        F.when(own_domain, F.concat(F.lit("https://"), domain)), F.lit("")))


def careers_page(df: DataFrame) -> DataFrame:
    """Adds careers_page, careers_page_guessed and the company search link."""
    def stated(u):
        u = _own_url(u)
        path = F.regexp_extract(url_path(u), fv.CAREERS_PATH, 1)
        return F.when(u.rlike(fv.CAREERS_URL) & (path != ""),
                      F.concat(url_scheme(u), F.lit("://"), url_host(u), path))
    df = df.withColumn("_stated", F.coalesce(stated(F.col("apply_url")), stated(F.col("url"))))
    site = F.col("company_website")
    guess = F.when(site != "", F.concat(F.regexp_replace(site, "/+$", ""), F.lit("/careers")))
    coded = F.replace(F.replace(F.url_encode("company"), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    search = F.concat(F.lit("https://www.linkedin.com/search/results/companies/?keywords="), coded)
    return df.select(
        "*", F.coalesce("_stated", guess, F.lit("")).alias("careers_page"),
        (F.col("_stated").isNull() & (site != "")).alias("careers_page_guessed"),
        F.when(F.coalesce("company", F.lit("")) != "", search).otherwise("").alias("linkedin")).drop("_stated")


def enrich(df: DataFrame) -> DataFrame:
    df = careers_page(employer_site(extract_person(extract_contacts(df))))
    apply_url, url = blank_to_null(F.col("apply_url")), blank_to_null(F.col("url"))
    direct = F.coalesce(F.col("direct_employer"), no()) & (F.col("contact_role") == "")
    return df.select("*", F.coalesce(apply_url, url, F.lit("")).alias("application_url"),
                     F.coalesce(url, apply_url, F.lit("")).alias("original_job_url")) \
        .withColumn("contact_role", F.when(direct, "Direct employer — no agency in between").otherwise(F.col("contact_role")))


def email_rank(address: Column) -> Column:
    local = F.split(address, "@")[0]
    chain = None
    for rank, pattern in fv.SITE_EMAIL_RANK:
        chain = F.when(local.rlike(pattern), rank) if chain is None else chain.when(local.rlike(pattern), rank)
    return chain.otherwise(2)


def page_emails(html: Column) -> Column:
    found = F.array_distinct(F.transform(
        F.regexp_extract_all(html, F.lit(f"({fv.SITE_EMAIL})"), F.lit(1)),
        lambda e: F.lower(F.regexp_replace(F.trim(e), r"^\.+|\.+$", ""))))
    return F.filter(found, lambda e: (e != "") & ~e.rlike(fv.SITE_EMAIL_UNWANTED)
                    & e.rlike(fv.SITE_EMAIL_TLD))


def page_people(html: Column) -> Column:
    """"Name — Role" entries of a page, sorted."""
    text = F.regexp_replace(unescape_entities(F.regexp_replace(html, "<[^>]+>", " ")), r"(?U)\s+", " ")
    first = rf"({fv.SITE_NAME})\s*(?:,|–|—|\||\s-\s)\s*({fv.SITE_ROLE})\b"
    second = rf"({fv.SITE_ROLE})\s*[:\-–—]\s*({fv.SITE_NAME})"
    pair = lambda p, n, r: F.zip_with(F.regexp_extract_all(text, F.lit(p), F.lit(n)),
                                      F.regexp_extract_all(text, F.lit(p), F.lit(r)),
                                      lambda a, b: F.concat(a, F.lit(" — "), b))
    return F.array_sort(F.array_distinct(F.concat(pair(first, 1, 2), pair(second, 2, 1))))


def site_contacts(pages: DataFrame, careers: DataFrame | None = None, max_pages: int | None = None,
                  max_entries: int | None = None) -> DataFrame:
    """Per site: ranked e-mails and "Name — Role" entries from its contact-style pages, of each
    the first `max_entries`, from the first `max_pages` pages; no limit unless one is given. `pages` is (url, html); `careers` optionally names each site's
    own careers page as (site, careers_page), read second.

    Only the listed paths are ever read, so a site contributes at most a dozen distinct
    URLs however many pages were crawled; repeats of one URL are reduced first."""
    url = F.regexp_replace(F.col("url"), r"/+$", "")
    listed = records([{"path": p, "rank": float(i)} for i, p in enumerate(fv.SITE_PAGES)], "path:string,rank:double")
    pages = (pages.where(F.col("url").startswith("https://"))
             .select(F.regexp_extract(url, r"^(https://[^/?#]+)", 1).alias("site"), url.alias("page"), "html"))
    known = pages.select("*", F.filter(listed, lambda p: F.concat(F.col("site"), p["path"]) == F.col("page"))[0]["rank"]
                         .alias("rank"))
    if careers is not None:
        extra = careers.where(url_host(F.col("site")) == url_host(F.col("careers_page"))).select(
            "site", F.regexp_replace("careers_page", r"/+$", "").alias("page"), F.lit(0.5).alias("_r")).distinct()
        known = known.join(extra, ["site", "page"], "left").withColumn("rank", F.coalesce("rank", "_r")).drop("_r")
    one = known.where(F.col("rank").isNotNull()).groupBy("site", "page").agg(
        F.min("rank").alias("rank"), F.min("html").alias("html"))
    first = Window.partitionBy("site").orderBy("rank")
    numbered = one.withColumn("n", F.row_number().over(first))
    if max_pages is not None:
        numbered = numbered.where(F.col("n") <= max_pages)
    read = (numbered
            .select("site", "n", page_emails(F.col("html")).alias("e"), page_people(F.col("html")).alias("p")))
    by_rank = F.transform(F.array_sort(F.transform(
        F.array_distinct(F.flatten(F.collect_list("e"))), lambda a: F.struct(email_rank(a).alias("r"), a.alias("a")))),
        lambda s: s["a"])
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("n", "p"))), lambda s: s["p"])
    cut = lambda entries: entries if max_entries is None else F.slice(entries, 1, max_entries)
    return read.groupBy("site").agg(cut(by_rank).alias("emails"), cut(F.array_distinct(F.flatten(in_order))).alias("people"))


def fill_contacts(leads: DataFrame, contacts: DataFrame) -> DataFrame:
    """Fill blanks from the employer's own site; never overwrite."""
    site = F.regexp_replace("company_website", r"/+$", "")
    table = contacts.select(F.col("site").alias("_site"), F.get("emails", F.lit(0)).alias("_e"),
                            F.get("people", F.lit(0)).alias("_p"))
    both = (F.col("public_email") != "") & (F.col("best_contact_name") != "")
    joined = leads.withColumn("_site", spread_blank(F.when(~both, site), "seq")).join(table, "_site", "left")
    person = F.split("_p", " — ", 2)
    named = (F.col("best_contact_name") == "") & F.col("_p").isNotNull()
    return (joined.withColumn("contact_role", F.when(named, F.trim(person[1])).otherwise(F.col("contact_role")))
            .withColumn("best_contact_name", F.when(named, F.trim(person[0])).otherwise(F.col("best_contact_name")))
            .withColumn("public_email", F.coalesce(blank_to_null(F.col("public_email")), "_e", F.lit("")))
            .drop("_site", "_e", "_p"))


def fill_bodies(postings: DataFrame, adverts: DataFrame, sources, run_ts: Column) -> DataFrame:
    """Replace snippets by fetched bodies. `adverts` is (source, source_id, body,
    advert_posted, advert_employment, advert_applicants); postings carry `relevance`. A body
    is used only when it is useful in itself and longer than what is there."""
    table = adverts.select("source", "source_id", strip_space(F.col("body")).alias("_body"),
                           F.col("advert_posted").alias("_posted"), F.col("advert_employment").alias("_emp"),
                           F.col("advert_applicants").alias("_app"))
    joined = postings.join(table, ["source", "source_id"], "left")
    use = (F.coalesce(F.col("truncated_description"), no()) & F.col("source").isin(*sources)
           & (F.coalesce("url", F.lit("")) != "") & F.col("relevance.passed")
           & (F.length("_body") >= fv.MIN_USEFUL_BODY)
           & (F.length("_body") > F.length(F.coalesce("description", F.lit("")))))
    use = F.coalesce(use, no())
    df = joined.withColumn("body_filled", use)
    use = F.col("body_filled")
    return (df.withColumn("description", F.when(use, F.col("_body")).otherwise(F.col("description")))
            .withColumn("truncated_description", F.col("truncated_description") & ~use)
            .withColumn("posted_at", F.when(use & F.col("posted_at").isNull(), posted_timestamp(F.col("_posted"), run_ts))
                        .otherwise(F.col("posted_at")))
            .withColumn("employment_type_raw", F.when(use & (F.trim("employment_type_raw") == "") & (F.col("_emp") != ""),
                                                      F.col("_emp")).otherwise(F.col("employment_type_raw")))
            .withColumn("applicants", F.when(use & (F.col("_app") != ""), F.col("_app")).otherwise(F.col("applicants")))
            .drop("_body", "_posted", "_emp", "_app"))
