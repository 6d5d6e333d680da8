"""The other gates: market, employer size, pay floor, engagement, score, prospects, liveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.geo import country_of_location, is_worldwide
from ..functions.text import (has_any, has_any_word, mentions, no, normalise, quoted, terms, unnegated_text,
                              words_in)
from ..profile import SearchProfile
from .skew import spread_blank


def gate(passed: Column, reason: Column, category) -> Column:
    passed = F.coalesce(passed, F.lit(True))
    category = category if isinstance(category, Column) else F.lit(category)
    return F.struct(passed.alias("passed"), F.when(passed, "").otherwise(reason).alias("reason"),
                    F.when(passed, "").otherwise(category).alias("category"))


def market_gate(df: DataFrame, prof: SearchProfile, out: str = "market") -> DataFrame:
    """Scoped to a market whose pay sits far below target? The search's own countries are
    never excluded."""
    markets = prof.excluded_markets
    if not markets:
        return df.withColumn(out, gate(F.lit(True), F.lit(""), "low_rate_market"))
    loc, body = F.col("n_location"), F.col("n_body")
    names = "|".join(quoted(m) for m in markets)
    named = F.get(words_in(loc, markets), F.lit(0))
    df = df.select("*", country_of_location(loc, prof).alias("_based"), F.concat(loc, F.lit(" "), body).alias("_both"))
    by_city = F.when(F.col("_based").isin(*markets), F.col("_based"))
    in_location = F.when((loc != "") & ~is_worldwide(loc), F.coalesce(named, by_city))
    # the scope phrases all name a market, so a plain search for a name comes first
    scope = F.when(has_any(body, markets) & ~is_worldwide(F.col("_both")),
                   unnegated_text(body, [p.format(markets=names) for p in fv.MARKET_SCOPE]))
    hit = F.coalesce(in_location, scope)
    return df.withColumn(out, gate(hit.isNull(), F.concat(
        F.lit("Scoped to a low-rate market ("), hit, F.lit(")")), "low_rate_market")).drop("_based", "_both")


def headcount_of(c: Column) -> Column:
    """"1,001-5,000" -> 5000; "200+" -> 400."""
    text = F.regexp_replace(F.regexp_replace(c, ",", ""), "–", "-")
    numbers = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    last = F.try_element_at(numbers, F.lit(-1)).cast("long")
    return F.when(text.contains("+") & (F.size(numbers) == 1), last * 2).otherwise(last)


def headcount(df: DataFrame, col: str, out: str = "headcount") -> DataFrame:
    return df.withColumn(out, headcount_of(F.col(col)))


def profile_slug(c: Column) -> Column:
    """The employer part of a professional-network company URL."""
    slug = F.lower(F.regexp_extract(c, r"(?i)linkedin\.com/company/([A-Za-z0-9\-_%.]+)", 1))
    return F.nullif(slug, F.lit(""))


def add_headcount(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """Left join to a table of head-counts (company_key, headcount) by profile slug."""
    keyed = df.withColumn("_key", spread_blank(profile_slug(F.col("company_linkedin")), "posting_id"))
    table = sizes.select(F.col("company_key").alias("_key"), "headcount")
    return keyed.join(table, "_key", "left").drop("_key")


def known_large(company: Column) -> Column:
    return company.rlike("(?i)" + "|".join(fv.LARGE_EMPLOYERS))


def size_gate(df: DataFrame, prof: SearchProfile, sizes: DataFrame | None = None, out: str = "size") -> DataFrame:
    """Only bites when small employers were asked for. Needs `company_size`."""
    if not prof.small_employers_only:
        return df.withColumn(out, gate(F.lit(True), F.lit(""), "large_employer"))
    if sizes is not None:
        df = add_headcount(df, sizes)
    elif "headcount" not in df.columns:
        df = df.withColumn("headcount", F.lit(None).cast("long"))
    large = (known_large(F.coalesce(F.col("company"), F.lit(""))) | F.col("company_size").isin(*fv.LARGE_SIZE_LABELS)
             | (F.coalesce(F.col("headcount"), F.lit(0)) > fv.LARGE_HEADCOUNT))
    return df.withColumn(out, gate(~large, F.lit("Large employer, and this search asked for small ones"),
                                   "large_employer")).drop("headcount")


def pay_gate(df: DataFrame, floor: float, require: bool = False, stated: bool = False, out: str = "pay_check") -> DataFrame:
    """Needs annual_usd. Adds the gate struct and `pay_note` (concern or detail)."""
    value, unpaid = F.col("annual_usd"), F.col("annual_usd").isNull()
    silent_ok = not require and not (stated and floor > 0)
    passed = F.when(unpaid, F.lit(silent_ok)).otherwise(value >= floor)
    category = F.when(unpaid, "low_pay" if require else "pay_unstated").otherwise("low_pay")
    shown = F.format_number(value, 0)
    reason = F.when(unpaid, "No published pay, so the minimum cannot be checked").otherwise(
        F.concat(F.lit("Pay tops out near $"), shown, F.lit(f"/yr, below the ${floor:,.0f} floor")))
    note = F.when(unpaid & F.lit(silent_ok), "Pay not published — confirm the band early")
    detail = F.when(value >= floor, F.concat(F.lit("Pay ≈ $"), shown, F.lit("/yr equivalent")))
    return df.select("*", gate(passed, reason, category).alias(out), note.alias("pay_note"), detail.alias("pay_detail"))


def engagement_gate(df: DataFrame, prof: SearchProfile, out: str = "engagement") -> DataFrame:
    kind = F.col("employment_type")
    wrong = (~kind.isin(*prof.employment_types, "Unknown")) if prof.employment_types else no()
    not_startup = ~F.col("is_startup") if prof.startups_only else no()
    return df.withColumn(out, gate(~(wrong | not_startup), F.when(
        wrong, F.concat(kind, F.lit(" role is not the kind asked for"))).otherwise("Not a startup"),
        F.when(wrong, "wrong_engagement").otherwise("not_startup")))


def score_gate(df: DataFrame, out: str = "score_check") -> DataFrame:
    low = F.col("match_score") < fv.MIN_QUALIFY_SCORE
    return df.withColumn(out, gate(~low, F.concat(
        F.lit("Match score "), F.col("match_score").cast("string"),
        F.lit(f" below threshold {fv.MIN_QUALIFY_SCORE}")), "low_score"))


def is_kept_prospect(prof: SearchProfile, title: Column) -> Column:
    reason, score = F.lower(F.coalesce(F.col("rejection_reason"), F.lit(""))), F.col("match_score")
    return (F.when(F.col("rejection_category") == "pay_unstated", score >= fv.MIN_QUALIFY_SCORE)
            .when(~mentions(reason, fv.UNDETERMINED_MARKERS), score >= fv.PROSPECT_MIN_SCORE)
            .when(has_any_word(title, prof.core_terms), True)
            .otherwise(score >= fv.PROSPECT_UNVERIFIED_MIN_SCORE))


def keep_prospects(df: DataFrame, prof: SearchProfile) -> DataFrame:
    return df.where(is_kept_prospect(prof, normalise(F.col("title"))))


def latest_crawl(crawl: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per URL (and `also`), the latest, of equally late ones the largest status and body;
    the maximum combines on the map side, so a URL crawled very often is reduced before it is shuffled."""
    return crawl.groupBy("url", *also).agg(
        F.max(F.struct("fetched_at", "status", "body")).alias("page")
    ).select("url", *also, "page.status", "page.body")


def closed_phrase(body: Column) -> Column:
    """First marker in list order. The page is normalised once and searched in one pass for
    any marker; which one comes first in the list only matters for pages that have one."""
    text = F.array(normalise(body))
    found = F.transform(text, lambda t: F.when(mentions(t, fv.CLOSED_MARKERS), F.get(
        F.filter(terms(fv.CLOSED_MARKERS), lambda m: t.contains(m)), F.lit(0))))
    return F.get(found, F.lit(0))


def drop_closed(leads: DataFrame, crawl: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Adds `closed` and `closed_reason`, and a concern where the advert could not be
    re-read. The closed-phrase scan runs once per crawled page, before the join, so a page
    many leads point at is not scanned again for each and its body is not shuffled. Pages
    that share a URL are told apart by the columns `also`, which both tables have."""
    pages = latest_crawl(crawl, also).select(
        F.col("url").alias("_url"), *also, "status", closed_phrase(F.col("body")).alias("_phrase"))
    link = F.when(F.coalesce(F.col("application_url"), F.lit("")) != "", F.col("application_url")) \
        .otherwise(F.col("original_job_url"))
    joined = leads.withColumn("_link", link).withColumn("_url", spread_blank(F.col("_link"), "_link" if "posting_id" not in leads.columns else "posting_id")).join(pages, ["_url", *also], "left")
    gone = F.col("status").isin(404, 410)
    unread = (F.col("_link") != "") & (F.col("status").isNull() | ~F.col("status").isin(200, 404, 410))
    phrase = F.when(F.col("status") == 200, F.col("_phrase"))
    note = F.array(F.lit("Could not re-check the advert — verify it is still open"))
    out = joined.withColumn("closed", F.coalesce(gone, no()) | phrase.isNotNull())
    out = out.withColumn("closed_reason", F.when(gone, F.concat(F.lit("Advert returns HTTP "), F.col("status")))
                         .when(phrase.isNotNull(), F.concat(F.lit('Advert says "'), phrase, F.lit('"'))).otherwise(""))
    return (out.withColumn("concerns", F.when(unread, F.concat("concerns", note)).otherwise(F.col("concerns")))
            .drop("_url", "_link", "status", "_phrase"))


def clear_dead_links(leads: DataFrame, crawl: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Blank guessed careers pages whose crawl did not answer 200; each URL is one row, or each page where
    the columns `also` tell pages of one URL apart."""
    alive = latest_crawl(crawl, also).where("status = 200").select(F.col("url").alias("_page"), *also, F.lit(True).alias("_ok"))
    by = next((c for c in ("posting_id", "seq") if c in leads.columns), leads.columns[0])
    joined = leads.withColumn("_page", spread_blank(F.col("careers_page"), by)).join(alive, ["_page", *also], "left")
    dead = F.col("careers_page_guessed") & (F.col("careers_page") != "") & F.col("_ok").isNull()
    return joined.withColumn("careers_page", F.when(dead, "").otherwise(F.col("careers_page"))).drop("_ok", "_page")
