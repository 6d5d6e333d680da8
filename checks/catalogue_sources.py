"""Registered queries, third part: feeds, pages, sinks, streams and extension points. Feed
payloads and pages are built by Spark from the tables' rows, so the work grows with them."""

from __future__ import annotations

import uuid
from types import SimpleNamespace

from pyspark.sql import functions as F

from postings_engine import fixed_values as fv
from postings_engine.functions import text
from postings_engine.operators import dedupe, enrich, relevance, score
from postings_engine.registry import register_rule, remove_rule
from postings_engine.session import shared_folder, written
from postings_engine.sinks import reports
from postings_engine.sources import feeds, json_feeds, pages as page_src, rss

from . import sql as S
from .catalogue import PROFILE, RUN, all_leads, base, listed, matched, query, stamp, stamp_sql
from .catalogue_more import RUN_OF, leads_of
from .projection import postings, read

PER_PAYLOAD = 5


def payloads(df, item, wrap):
    """Five postings per payload: to_json of the item structs inside the feed's envelope."""
    rows = df.groupBy(F.floor(F.col("seq") / PER_PAYLOAD).alias("payload_id")).agg(F.array_sort(F.collect_list(F.struct("seq", item.alias("i")))).alias("a"))
    items = F.transform("a", lambda x: x["i"])
    return rows.select("payload_id", F.to_json(wrap(items)).alias("payload"))


def tidy(df):
    return df.select("source_id", "title", "company", "url", "location_raw", F.size("tags").alias("n_tags"), stamp("posted_at").alias("posted"))


def src_sql(prefix, company="company", location="location_raw", n_tags=None, where="true", url="url"):
    n_tags = n_tags or f"len({S.KEPT_TAGS})"
    return S.select(f"""SELECT '{prefix}' || seq AS source_id, title, {company} AS company, {url} AS url, {location} AS location_raw, CAST({n_tags} AS INTEGER) AS n_tags, {stamp_sql('posted_at')} AS posted FROM p WHERE {where}""", S.P)




def ISO():
    return F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")



@query("src_1_corpus", S.select(f"SELECT posting_id, CASE WHEN apply_url <> '' THEN apply_url ELSE url END AS apply_url, {stamp_sql(f'{S.RUN} - to_days(CAST(seq % 40 AS INTEGER)) - INTERVAL 3 HOUR')} AS posted FROM p", S.P))
def _(spark, sf):
    df = base(spark, sf)
    raw = df.select(F.col("posting_id").alias("id"), "source", "title", "company", F.col("location_raw").alias("location"), "url", "description", (F.col("seq") % 40).cast("int").alias("days_ago"),
                    F.lit(None).cast("int").alias("hours_ago"), F.col("employment_type_raw").alias("employment_type"), "salary_min", "salary_max", "salary_currency", "salary_raw", "apply_url", "company_website", "tags",
                    F.struct("is_remote", "truncated_description", "applicants", "direct_employer", "company_linkedin").alias("extra"))
    return feeds.corpus_postings(raw, RUN_OF(spark, sf)).select("posting_id", "apply_url", stamp("posted_at").alias("posted"))


@query("src_2_json_feed", src_sql("remotive-", location="CASE WHEN location_raw = '' THEN 'Remote' ELSE location_raw END"))
def _(spark, sf):
    item = F.struct(F.col("seq").alias("id"), "title", F.col("company").alias("company_name"), "url", "description", F.col("location_raw").alias("candidate_required_location"), ISO().alias("publication_date"), "tags")
    rows = payloads(base(spark, sf), item, lambda a: F.struct(a.alias("jobs")))
    return tidy(json_feeds.map_json_feed(rows, "remotive", RUN_OF(spark, sf)))


@query("src_2_json_feed_nested", src_sql("adzuna-", location="CASE WHEN location_raw = '' THEN 'GB' ELSE location_raw END", n_tags="1"))
def _(spark, sf):
    item = F.struct(F.col("seq").alias("id"), "title", F.struct(F.col("company").alias("display_name")).alias("company"), F.col("url").alias("redirect_url"), "description",
                    F.struct(F.col("location_raw").alias("display_name")).alias("location"), ISO().alias("created"), F.struct(F.lit("Trades").alias("label")).alias("category"))
    rows = payloads(base(spark, sf), item, lambda a: F.struct(a.alias("results"))).withColumn("market", F.lit("gb"))
    return tidy(json_feeds.map_json_feed(rows, "adzuna", RUN_OF(spark, sf)))


@query("src_2_json_feed_root_array", src_sql("remoteok-", location="CASE WHEN location_raw = '' THEN 'Remote' ELSE location_raw END", where="seq % 7 <> 0"))
def _(spark, sf):
    item = F.struct(F.col("seq").alias("id"), F.when(F.col("seq") % 7 != 0, F.col("title")).alias("position"), "company", "url", "description", F.col("location_raw").alias("location"),
                    F.unix_timestamp("posted_at").alias("epoch"), F.array_join("tags", ", ").alias("tags"))
    return tidy(json_feeds.map_json_feed(payloads(base(spark, sf), item, lambda a: a), "remoteok", RUN_OF(spark, sf)))


@query("src_3_rss_feed", S.select(f"""SELECT 'wwr-g' || seq AS source_id, title, trim(company) AS company, url, CASE WHEN location_raw = '' THEN 'Remote' ELSE location_raw END AS location_raw, CAST(0 AS INTEGER) AS n_tags, {stamp_sql('posted_at')} AS posted FROM p""", S.P))
def _(spark, sf):
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("é"), F.lit("&eacute;"))
    node = lambda tag, v: F.concat(F.lit(f"<{tag}>"), F.coalesce(v, F.lit("")), F.lit(f"</{tag}>"))
    date = F.date_format("posted_at", "EEE, dd MMM yyyy HH:mm:ss '+0000'")
    item = F.concat(F.lit("<item>"), node("title", F.concat(safe("company"), F.lit(": "), safe("title"))), node("link", safe("url")), node("guid", F.concat(F.lit("g"), "seq")),
                    node("region", safe("location_raw")), node("pubDate", date), node("description", F.concat(F.lit("<![CDATA["), "title", F.lit("]]>"))), F.lit("</item>"))
    rows = base(spark, sf).groupBy(F.floor(F.col("seq") / PER_PAYLOAD).alias("payload_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", item.alias("i")))), lambda x: x["i"]), "").alias("x"))
    return tidy(rss.map_rss_feed(rows.select("payload_id", F.concat(F.lit("<rss><channel>"), "x", F.lit("</channel></rss>")).alias("payload")), "weworkremotely", RUN_OF(spark, sf)))


def ld_pages(spark, sf, body):
    script = F.concat(F.lit('<html><script type="application/ld+json">'), F.to_json(body), F.lit("</script></html>"))
    return base(spark, sf).select(F.col("seq").alias("page_id"), "url", script.alias("html"), F.lit("board").alias("platform"), F.lit("Board").alias("label"), F.lit("Ghana").alias("country"))


_HIDDEN = "CASE WHEN trim(company) = '' THEN 'Undisclosed' ELSE trim(company) END"


@query("src_4_jsonld_postings", S.select(f"SELECT title, {_HIDDEN} AS company, CASE WHEN location_raw = '' THEN 'Ghana' ELSE location_raw || ', GB' END AS location_raw, url, {stamp_sql('posted_at')} AS posted FROM p", S.P))
def _(spark, sf):
    place = F.when(F.col("location_raw") != "", F.struct(F.struct(F.col("location_raw").alias("addressLocality"), F.lit("GB").alias("addressCountry")).alias("address")))
    ref = F.concat(F.lit("#org"), "seq")
    body = F.struct(F.array(F.to_json(F.struct(F.lit("JobPosting").alias("@type"), "title", ISO().alias("datePosted"), place.alias("jobLocation"), F.struct(ref.alias("@id")).alias("hiringOrganization"))),
                            F.to_json(F.struct(F.lit("Organization").alias("@type"), ref.alias("@id"), F.col("company").alias("name")))).alias("@graph"))
    pages = ld_pages(spark, sf, body)
    # the two nodes were written as text; open the quotes so the graph holds objects
    html = F.replace(F.replace(F.replace(F.col("html"), F.lit('\\"'), F.lit('"')), F.lit('"{'), F.lit("{")), F.lit('}"'), F.lit("}"))
    df = page_src.jsonld_postings(pages.withColumn("html", html), RUN_OF(spark, sf))
    return df.select("title", "company", "location_raw", "url", stamp("posted_at").alias("posted"))


# by remainder of the row: named before the posting, nested far below another object, in a list, nowhere, twice
_REFERRED = "CASE seq % 5 WHEN 3 THEN 'Undisclosed' WHEN 4 THEN 'Last ' || seq ELSE 'Firm ' || seq END"


@query("src_4_references", S.select(f"SELECT CAST(seq AS BIGINT) AS page, title, {_REFERRED} AS company FROM p", S.P))
def _(spark, sf):
    quoted = lambda c: F.to_json(F.struct(c.alias("v")))  # {"v":"..."}
    post = F.concat(F.lit('{"@type":"JobPosting","title":'), F.regexp_extract(quoted(F.col("title")), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit(',"hiringOrganization":'),
                    F.when(F.col("seq") % 5 == 2, '[{"@id":"#o"},{"name":"Other"}]').otherwise('{"@id":"#o"}'), F.lit("}"))
    firm = lambda word: F.concat(F.lit(f'{{"@id":"#o","name":"{word} '), "seq", F.lit('"}'))
    graph = (F.when(F.col("seq") % 5 == 1, F.concat(F.lit('{"a":[{"b":{"publisher":{"worksFor":'), firm("Firm"), F.lit("}}}]},"), post))
             .when(F.col("seq") % 5 == 3, F.concat(post, F.lit(',{"@id":"#o"},{"@id":"#other","name":"Other"}')))
             .when(F.col("seq") % 5 == 4, F.concat(firm("First"), F.lit(","), post, F.lit(","), firm("Last"))).otherwise(F.concat(firm("Firm"), F.lit(","), post)))
    html = F.concat(F.lit('<script id="x" type="application/LD+JSON">{"@graph":['), graph, F.lit(']}</script><script type="application/ld+json">[not json</script>'))
    pages = base(spark, sf).select(F.col("seq").alias("page_id"), "url", html.alias("html"), F.lit("board").alias("platform"), F.lit("Board").alias("label"), F.lit("Ghana").alias("country"))
    df = page_src.jsonld_postings(pages, RUN_OF(spark, sf))
    return df.select((F.shiftright("seq", 20)).alias("page"), "title", "company")


def advert_pages(spark, sf):
    """A page for each posting: a posting of its own, one in a graph with two types, a list entry that only
    nests a posting, or a bare container."""
    markup = F.concat(F.lit("<p>"), "title", F.lit("</p><p>"), "company", F.lit("</p>"))
    post = lambda kind: F.struct(kind.alias("@type"), markup.alias("description"), ISO().alias("datePosted"), F.array(F.lit("FULL_TIME"), F.lit("CONTRACTOR")).alias("employmentType"))
    one = F.to_json(post(F.lit("JobPosting")))
    two = F.to_json(F.struct(F.array(F.struct(F.lit("Person").alias("@type")).cast("struct<`@type`:string>")).alias("@graph")))
    two = F.replace(two, F.lit('{"@type":"Person"}'), F.to_json(post(F.array(F.lit("JobPosting"), F.lit("Thing")))))
    nested = F.concat(F.lit('{"@type":"ListItem","item":{"offer":'), one, F.lit("}}"))
    script = F.when(F.col("seq") % 4 == 1, one).when(F.col("seq") % 4 == 2, two).when(F.col("seq") % 4 == 3, nested)
    html = F.concat(F.coalesce(F.concat(F.lit('<script type="application/ld+json">'), script, F.lit("</script>")), F.lit("")),
                    F.lit('<section class="x adp-body"><p>Kept: '), "title", F.lit("</p></section>"))
    return base(spark, sf).select(F.col("seq").alias("page_id"), "url", html.alias("html"))


_MARKED = "'<p>' || title || '</p><p>' || company || '</p>'"


@query("src_4_advert_bodies", S.select(f"""SELECT seq AS page_id, CASE WHEN seq % 4 IN (1, 2) THEN {S.html_text(_MARKED)} ELSE {S.html_text("'<p>Kept: ' || title || '</p>'")} END AS body,
  CASE WHEN seq % 4 IN (1, 2) THEN coalesce(strftime(posted_at, '%Y-%m-%dT%H:%M:%SZ'), '') ELSE '' END AS advert_posted,
  CASE WHEN seq % 4 IN (1, 2) THEN 'Full Time, Contractor' ELSE '' END AS advert_employment, '' AS advert_applicants FROM p""", S.P))
def _(spark, sf):
    return page_src.advert_bodies(advert_pages(spark, sf))


@query("src_4_offer_pages", S.select(f"""SELECT 'jobgether-' || seq AS source_id, title, CASE WHEN company = '' THEN 'Undisclosed' ELSE company END AS company,
  CASE seq % 4 WHEN 0 THEN 'Oslo, or nearby' WHEN 1 THEN 'Ghana, Norway' WHEN 2 THEN 'Peru' ELSE 'Remote' END AS location_raw, 'Part Time' AS employment_type_raw,
  'https://firm.example/' || seq AS company_website, {stamp_sql('posted_at')} AS posted FROM p""", S.P))
def _(spark, sf):
    where = lambda name, land: F.struct(name.alias("name"), F.struct(land.alias("addressCountry")).alias("address"))
    none = F.lit(None).cast("string")
    stated = F.when(F.col("seq") % 4 == 0, "<br>The offer is available from: Oslo, or nearby.").otherwise("")
    places = F.when(F.col("seq") % 4 == 1, F.array(where(F.lit("Ghana"), F.lit("Norway")), where(none, F.lit("Ghana"))))
    asked = F.when(F.col("seq") % 4 == 2, where(F.lit("Peru"), none))
    body = F.struct(F.lit("JobPosting").alias("@type"), "title", F.concat("title", stated).alias("description"), F.lit("PART_TIME").alias("employmentType"), ISO().alias("datePosted"),
                    F.struct(F.col("company").alias("name"), F.concat(F.lit("https://firm.example/"), "seq").alias("sameAs")).alias("hiringOrganization"),
                    places.alias("jobLocation"), asked.alias("applicantLocationRequirements"))
    html = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(body), F.lit("</script>"))
    pages = base(spark, sf).select(F.col("seq").alias("page_id"), F.concat(F.lit("https://offers.example/o/"), "seq").alias("url"), html.alias("html"))
    return page_src.offer_pages(pages, RUN_OF(spark, sf)).select("source_id", "title", "company", "location_raw", "employment_type_raw", "company_website", stamp("posted_at").alias("posted"))


@query("src_5_itemlist_links", S.select("SELECT 'board-https://x.example/' || seq AS source_id, title FROM p WHERE seq % 4 <> 0", S.P))
def _(spark, sf):
    link = F.concat(F.when(F.col("seq") % 4 == 0, "http").otherwise("https"), F.lit("://x.example/"), "seq")
    body = F.struct(F.lit("ItemList").alias("@type"), F.array(F.struct(F.lit("ListItem").alias("@type"), F.struct(link.alias("url"), F.col("title").alias("name")).alias("item"))).alias("itemListElement"))
    return page_src.itemlist_links(ld_pages(spark, sf, body)).select("source_id", "title")


@query("src_6_detail_links", f"SELECT page_id, 0 AS n, 'https://' || {S.host('url')} || '/jobs/' || page_id AS link FROM pages WHERE starts_with(url, 'https://') UNION ALL SELECT page_id, 1, 'https://' || {S.host('url')} || '/career/b' FROM pages WHERE starts_with(url, 'https://')")
def _(spark, sf):
    df = read(spark, sf, "pages").withColumn("html", F.concat("html", F.lit('<a href="/jobs/'), "page_id", F.lit('?a=1&amp;b=2"><a href="/jobs/'), "page_id", F.lit('"><a href="/jobs/"><a href="https://else.example/jobs/1"><a href="/career/a/../b">')))
    return page_src.detail_links(df)


@query("src_7_html_cards", S.select("SELECT 'linkedin-' || (1000000 + seq) AS source_id, title, CASE WHEN trim(company) = '' THEN 'Undisclosed' ELSE trim(company) END AS company, location_raw FROM p", S.P))
def _(spark, sf):
    esc = lambda c: F.replace(F.col(c), F.lit("&"), F.lit("&amp;"))
    card = F.concat(F.lit('<li><div data-entity-urn="urn:li:jobPosting:'), (F.col("seq") + 1000000).cast("string"), F.lit('"><h3 class="base-search-card__title"> '), esc("title"), F.lit('</h3><h4 class="base-search-card__subtitle"><a>'), esc("company"),
                    F.lit('</a></h4><span class="job-search-card__location">'), esc("location_raw"), F.lit('</span><time datetime="2024-01-05"></time></li><li>empty</li>'))
    return page_src.html_cards(base(spark, sf).select(F.col("seq").alias("page_id"), card.alias("html")), RUN_OF(spark, sf)).select("source_id", "title", "company", "location_raw")


_body = S.html_text("description")


@query("src_8_html_detail", S.select(f"SELECT CAST(posting_id AS BIGINT) AS page_id, CASE WHEN length({_body}) > 200 THEN length({_body}) ELSE 0 END AS n_body, title AS employment_type, trim(applicants) AS applicants FROM p", S.P))
def _(spark, sf):
    html = F.concat(F.lit('<div class="show-more-less-html__markup x">'), "description", F.lit('</div><h3 class="job-criteria-subheader">Employment type</h3> <span class="job-criteria-text">'), "title",
                    F.lit('</span><figcaption class="num-applicants__caption"> '), "applicants", F.lit(" </figcaption>"))
    df = page_src.html_detail(base(spark, sf).select(F.col("seq").alias("page_id"), html.alias("html")))
    return df.select("page_id", F.length("body").cast("bigint").alias("n_body"), "employment_type", "applicants")


_c = S.html_text("text")


@query("src_9_thread_postings", f"""SELECT 'hn-' || (conv_id * 1000 + turn) AS source_id, trim(string_split({_c}, chr(10))[1]) AS title, length({_c}) AS n FROM conversations WHERE turn > 0 AND turn % 3 <> 2 AND length({_c}) >= 120""")
def _(spark, sf):
    c = read(spark, sf, "conversations").where("turn > 0")
    oid = F.col("conv_id") * 1000 + F.col("turn")
    df = c.select(oid.alias("object_id"), F.when(F.col("turn") % 3 == 2, oid - 1).otherwise(F.col("conv_id")).alias("parent_id"), F.col("conv_id").alias("story_id"), F.col("text").alias("comment_text"), F.lit("2024-01-01").alias("created_at"), oid.alias("row_no"))
    return page_src.thread_postings(df, RUN_OF(spark, sf)).select("source_id", "title", F.length("description").cast("bigint").alias("n"))


@query("src_10_as_tags", "SELECT event_id, event_type || ' | ' || user_id AS tags FROM events")
def _(spark, sf):
    df = read(spark, sf, "events").withColumn("raw", F.concat("event_type", F.lit(" , ,"), "user_id"))
    return feeds.as_tags(df, "raw").select("event_id", listed("tags").alias("tags"))


@query("src_11_union_feeds", S.select(f"SELECT CASE WHEN seq % 2 = 0 THEN 'reed' ELSE 'jobgether' END AS source, CAST(seq + CASE WHEN seq % 2 = 0 THEN {fv.FEED_ORDER.index('reed')} ELSE {fv.FEED_ORDER.index('jobgether')} END * {1 << 58} AS BIGINT) AS seq, CASE WHEN seq % 3 = 0 THEN false WHEN seq % 2 = 1 THEN true END AS is_remote FROM p", S.P))
def _(spark, sf):
    df = base(spark, sf).withColumn("row_no", F.col("seq")).withColumn("is_remote", F.when(F.col("seq") % 3 == 0, False))
    return feeds.union_feeds({"reed": df.where("seq % 2 = 0"), "jobgether": df.where("seq % 2 = 1")}).select("source", "seq", "is_remote")


@query("src_12_dedupe_by_id", S.select("SELECT posting_id FROM (SELECT *, row_number() OVER (PARTITION BY source, CASE WHEN seq % 5 = 0 THEN url ELSE 'k' || seq % 50 END ORDER BY seq) AS rn FROM p) WHERE rn = 1", S.P))
def _(spark, sf):
    df = base(spark, sf).withColumn("source_id", F.when(F.col("seq") % 5 == 0, "").otherwise(F.concat(F.lit("k"), F.col("seq") % 50)))
    return feeds.dedupe_by_id(df).select("posting_id")


@query("src_13_source_stats", "SELECT source AS name, CAST(CASE WHEN source = 'src3' THEN 0 ELSE count(*) END AS BIGINT) AS raw_count, source <> 'src3' AS ok, CASE WHEN source = 'src3' THEN repeat('x', 300) ELSE '' END AS error FROM documents GROUP BY source")
def _(spark, sf):
    docs = read(spark, sf, "documents")
    failed = F.col("source") == "src3"
    manifest = docs.select("source").distinct().select(F.col("source").alias("name"), (~failed).alias("ok"), F.when(failed, F.repeat(F.lit("x"), F.lit(300))).alias("error"), F.lit(1.23).alias("elapsed"))
    return feeds.source_stats(manifest, docs).select("name", "raw_count", "ok", "error")


@query("src_14_route_feeds", "SELECT CAST(c_custkey AS BIGINT) AS id, c_nationkey % 3 <> 2 AS serves FROM customer")
def _(spark, sf):
    df = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.expr("CASE c_nationkey % 3 WHEN 0 THEN array() WHEN 1 THEN array('uk', 'united kingdom') ELSE array('germany') END").alias("markets"))
    return feeds.route_feeds(df, PROFILE.wanted_countries).select("id", "serves")


@query("src_15_seed_boards", "SELECT CAST(c_custkey AS BIGINT) AS id FROM customer WHERE c_nationkey % 4 <> 3")
def _(spark, sf):
    df = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.expr("CASE c_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'United Kingdom' WHEN 2 THEN 'Kingdom' ELSE 'Germany' END").alias("region"))
    return feeds.seed_boards(df, PROFILE.wanted_countries).select("id")


_tokens = " UNION ALL ".join(f"SELECT {i} AS place, '{k}' AS kind, lower(unnest(regexp_extract_all(u, {S.q('(?i)' + p)}, 1))) AS token FROM us" for i, (k, p) in enumerate(fv.BOARD_TOKENS))


@query("src_16_board_tokens", S.select(f"SELECT DISTINCT kind, token FROM ({_tokens})", S.P, "us AS (SELECT url AS u FROM p UNION ALL SELECT apply_url FROM p UNION ALL SELECT company_website FROM p)"))
def _(spark, sf):
    return feeds.board_tokens(postings(spark, sf))


@query("src_17_market_code", "SELECT CAST(c_custkey AS BIGINT) AS id, CASE c_nationkey % 4 WHEN 0 THEN 'gb' WHEN 1 THEN 'de' WHEN 2 THEN 'pl' ELSE '' END AS market_code, CASE c_nationkey % 4 WHEN 0 THEN 'GBP' WHEN 1 THEN 'EUR' WHEN 2 THEN 'PLN' ELSE '' END AS market_currency FROM customer")
def _(spark, sf):
    df = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.expr("CASE c_nationkey % 4 WHEN 0 THEN ' Scotland' WHEN 1 THEN 'germany' WHEN 2 THEN 'POLAND' ELSE 'Narnia' END").alias("market"))
    return feeds.with_market_code(df).select("id", "market_code", "market_currency")


_t = "CASE page_id % 6 WHEN 0 THEN 'https://a.example/s?q={query}' WHEN 1 THEN 'http://a.example/s?q={query}' WHEN 2 THEN 'https://u:p@a.example/{query}' WHEN 3 THEN 'https://a.example:8443/{query}' WHEN 4 THEN 'https://localhost/{query}' ELSE url END"


@query("src_18_screen_urls", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'scheme is not allowed' WHEN 2 THEN 'credentials in the URL' WHEN 3 THEN 'port is not allowed' WHEN 4 THEN 'no public hostname' ELSE 'no {query} placeholder' END AS reason,
  page_id % 6 = 0 AND row_number() OVER (PARTITION BY page_id % 6 = 0, page_id % 4 ORDER BY page_id) <= 12 AS kept, page_id % 6 = 0 AS kept_all FROM pages""")
def _(spark, sf):
    df = read(spark, sf, "pages").select("page_id", F.col("page_id").alias("seq"), F.expr(_t).alias("url_template"), (F.col("page_id") % 4).alias("country"))
    every = feeds.screen_urls(df).select("page_id", F.col("kept").alias("kept_all"))
    return feeds.screen_urls(df, 12).select("page_id", "reason", "kept").join(every, "page_id")


# --------------------------------------------------------------- enrichment from pages

_site_mail = f"list_filter(list_distinct(list_transform(regexp_extract_all(html, {S.q(fv.SITE_EMAIL)}), lambda e: lower(regexp_replace(trim(e), '^\\.+|\\.+$', '', 'g')))), lambda e: e <> '' AND NOT regexp_matches(e, {S.q(fv.SITE_EMAIL_UNWANTED)}) AND regexp_matches(e, {S.q(fv.SITE_EMAIL_TLD)}))"


@query("enr_5_site_contacts", f"""WITH h AS (SELECT 'https://s' || doc_id // 8 || '.com' AS site, doc_id % 8 AS n, text || coalesce(html, '') || '<p>Ann Lee, CTO</p> noreply@x.com ' || CASE WHEN doc_id % 8 = 1 THEN 'careers' ELSE 'sales' || doc_id % 8 END || '@s' || doc_id // 8 || '.com ' AS html
    FROM documents d LEFT JOIN (SELECT page_id, any_value(html) AS html FROM pages GROUP BY page_id) p ON p.page_id = d.doc_id),
  e AS (SELECT DISTINCT site, unnest({_site_mail}) AS mail FROM h)
  SELECT site, CAST(count(*) AS INTEGER) AS n_emails, coalesce(bool_or(mail = 'careers@' || substr(site, 9)), false) AS has_careers, arg_min(mail, (CASE WHEN starts_with(mail, 'careers@') THEN 0 ELSE 1 END, mail)) FILTER (mail = 'careers@' || substr(site, 9)) AS best FROM e GROUP BY site""")
def _(spark, sf):
    """Eight pages per site on the contact-style paths, each a whole document text and, where there
    is one of the same number, a whole page."""
    paths = F.array(*map(F.lit, fv.SITE_PAGES[:8]))
    site = F.concat(F.lit("s"), F.floor(F.col("doc_id") / 8).cast("string"), F.lit(".com"))
    box = F.when(F.col("doc_id") % 8 == 1, "careers").otherwise(F.concat(F.lit("sales"), (F.col("doc_id") % 8).cast("string")))
    pages = read(spark, sf, "pages").groupBy(F.col("page_id").alias("doc_id")).agg(F.any_value("html").alias("page"))
    html = F.concat("text", F.coalesce("page", F.lit("")), F.lit("<p>Ann Lee, CTO</p> noreply@x.com "), box, F.lit("@"), site, F.lit(" "))
    df = read(spark, sf, "documents").join(pages, "doc_id", "left").select(F.concat(F.lit("https://"), site, F.element_at(paths, (F.col("doc_id") % 8 + 1).cast("int"))).alias("url"), html.alias("html"))
    own = F.concat(F.lit("careers@"), F.substring("site", 9, 99))
    found = enrich.site_contacts(df).where(F.size("emails") > 0).select("site", F.size("emails").alias("n_emails"), F.array_contains("emails", own).alias("has_careers"), own.alias("own"))
    return found.select("site", "n_emails", "has_careers", F.when(F.col("has_careers"), F.col("own")).alias("best"))


@query("enr_6_fill_contacts", """SELECT CAST(doc_id AS VARCHAR) AS posting_id, CASE WHEN doc_id % 2 = 0 THEN 'own@x.com' WHEN doc_id % 4 = 1 THEN 'hr@s1.com' ELSE '' END AS public_email, CASE WHEN doc_id % 4 = 1 THEN 'Ann Lee' ELSE '' END AS best_contact_name FROM documents""")
def _(spark, sf):
    df = leads_of(spark, sf).withColumns({"public_email": F.when(F.col("seq") % 2 == 0, "own@x.com").otherwise(""), "best_contact_name": F.lit(""), "contact_role": F.lit(""),
                                          "company_website": F.concat(F.lit("https://s"), (F.col("seq") % 4).cast("string"), F.lit(".com/"))})
    site = read(spark, sf, "documents").where("doc_id % 4 = 1").select(F.concat(F.lit("https://s"), (F.col("doc_id") % 4).cast("string"), F.lit(".com")).alias("site")).distinct()
    contacts = site.select("site", F.array(F.lit("hr@s1.com")).alias("emails"), F.array(F.lit("Ann Lee — CTO")).alias("people"))
    return enrich.fill_contacts(df, contacts).select("posting_id", "public_email", "best_contact_name")


@query("enr_7_fill_bodies", S.select("SELECT posting_id, truncated_description AND gate = 0 AND url <> '' AND seq % 20 = 0 AND source IN ('src1', 'src4', 'src8', 'src0') AS body_filled FROM rel", S.P, S.N, S.REL))
def _(spark, sf):
    df = relevance.relevance(matched(spark, sf), PROFILE)
    adverts = base(spark, sf).where("seq % 20 = 0").select("source", "source_id", F.concat("description", F.repeat(F.lit(" more"), F.lit(100))).alias("body"), F.lit("2024-01-01").alias("advert_posted"),
                                                         F.lit("Contract").alias("advert_employment"), F.lit("").alias("advert_applicants"))
    return enrich.fill_bodies(df, adverts, ("src1", "src4", "src8", "src0"), RUN()).select("posting_id", "body_filled")


# --------------------------------------------------------------- sinks, extension points

@query("snk_2_export_rows", S.select("SELECT posting_id, CASE WHEN seq % 4 = 0 THEN '''=' || title WHEN seq % 4 = 1 THEN '- ' || title WHEN seq % 4 = 2 THEN '-12.5' ELSE '''+' || title END AS title FROM p", S.P))
def _(spark, sf):
    lead = F.expr("CASE seq % 4 WHEN 0 THEN concat('=', title) WHEN 1 THEN concat('- ', title) WHEN 2 THEN '-12.5' ELSE concat('+', title) END")
    return base(spark, sf).select("posting_id", reports.defused(lead).alias("title"))


_SUNK = [S.P, S.N, S.elig_ctes("n"), f"v AS (SELECT * EXCLUDE (remote_status), CASE WHEN el_category = 'not_remote' THEN {S.ARR_LABEL} ELSE remote_status END AS remote_status FROM el)", S.lead_ctes("v"), S.K,
         "sk AS (SELECT sc.*, kf.fingerprint FROM sc JOIN kf USING (posting_id))"]
_SHEETS = """sheets AS (SELECT *, unnest(list_filter(['All Qualified Jobs', CASE WHEN match_score >= 85 THEN 'Hot Leads' END, 'Quick Apply', CASE WHEN employment_type = 'Full Time' THEN 'Full Time' END, CASE WHEN employment_type = 'Part Time' THEN 'Part Time' END,
  CASE WHEN employment_type = 'Contract' THEN 'Contract' END, CASE WHEN employment_type = 'Freelance' THEN 'Freelance' END, CASE WHEN is_startup THEN 'Startups' END, CASE WHEN is_partnership THEN 'Partnerships' END], lambda s: s IS NOT NULL)) AS sheet FROM sk WHERE seq % 4 <> 0
  UNION ALL SELECT *, CASE WHEN seq % 8 = 0 THEN 'Prospects' ELSE 'Long Shots' END FROM sk WHERE seq % 4 = 0),
kept AS (SELECT * FROM sheets QUALIFY row_number() OVER (PARTITION BY sheet, fingerprint ORDER BY match_score DESC, coalesce(epoch_us(posted_at), 0) DESC, seq) = 1)"""


def sunk(spark, sf):
    """All postings as leads: a quarter of them prospects and long shots, the rest qualified."""
    leads = written(all_leads(spark, sf).withColumns({"is_prospect": F.col("seq") % 8 == 0, "rejection_reason": F.lit("not confirmed")}), "sunk")
    return SimpleNamespace(qualified=leads.where("seq % 4 <> 0"), prospects=leads.where("seq % 8 = 0"), long_shots=leads.where("seq % 8 = 4"),
                           companies=leads.limit(0), funnel=leads.limit(0), rejected=leads.where("seq % 8 = 0").withColumn("rejection_category", F.lit("ineligible")))


@query("snk_1_sheets_in_order", S.select("""SELECT sheet, CAST(row_number() OVER (PARTITION BY sheet ORDER BY match_score DESC, coalesce(posted_at, make_timestamp(0)) DESC, seq) - 1 AS BIGINT) AS place, seq, match_score, trim(title) AS title FROM kept""", *_SUNK, _SHEETS))
def _(spark, sf):
    """Every sheet as its files have it, read back."""
    path = f"{shared_folder(spark)}/snk-1-{uuid.uuid4().hex}"
    leads = sunk(spark, sf)
    reports.write_sheets(reports.sheet_rows(leads.qualified, leads.prospects, leads.long_shots, PROFILE), path)
    return reports.read_sheets(spark, path).select("sheet", "place", "seq", "match_score", "title")


@query("snk_2_csv_read_back", S.select("""SELECT posting_id, trim(title) AS title, CAST(match_score AS VARCHAR) AS match_score, CASE WHEN seq % 8 = 0 THEN 'Prospect' WHEN seq % 8 = 4 THEN 'Long Shot' WHEN match_score >= 85 THEN 'Hot Lead' ELSE 'Qualified' END AS "Sheet",
  md5(description) AS body FROM sk""", *_SUNK))
def _(spark, sf):
    path = f"{shared_folder(spark)}/snk-2-{uuid.uuid4().hex}"
    reports.export_csv(sunk(spark, sf), path)
    back = reports.read_csv(spark, path)
    return back.select("posting_id", "title", "match_score", "Sheet", F.md5("description").alias("body"))


@query("snk_3_json_read_back", S.select("""SELECT b AS bucket, posting_id, match_score, trim(title) AS title, md5(description) AS body FROM (SELECT *, unnest(CASE WHEN seq % 8 = 0 THEN ['prospects'] WHEN seq % 8 = 4 THEN ['long_shots'] WHEN match_score >= 85 THEN ['qualified_jobs', 'hot_leads'] ELSE ['qualified_jobs'] END) AS b FROM sk)""", *_SUNK))
def _(spark, sf):
    path = f"{shared_folder(spark)}/snk-3-{uuid.uuid4().hex}"
    reports.export_json(sunk(spark, sf), path)
    schema = "posting_id string, match_score int, title string, description string"
    back = [spark.read.schema(schema).json(f"{path}/{name}").withColumn("bucket", F.lit(name)) for name in ("qualified_jobs", "hot_leads", "prospects", "long_shots")]
    return dedupe.union_leads(*back).select("bucket", "posting_id", "match_score", "title", F.md5("description").alias("body"))


@query("ext_1_rule_registry", S.select("SELECT posting_id, gate = 0 AND NOT contains(hay, 'depot') AS passed FROM rel", S.P, S.N, S.REL))
def _(spark, sf):
    register_rule("relevance_gate", 65, lambda c, prof: F.when(c("hay").contains("depot"), "Depot work"), "no_depots")
    try:
        return relevance.relevance(matched(spark, sf), PROFILE).select("posting_id", "relevance.passed")
    finally:
        remove_rule("relevance_gate", "no_depots")


@query("ext_2_feed_registry", src_sql("own-"))
def _(spark, sf):
    json_feeds.register_feed("own_board", json_feeds.FieldMap(("$.rows",), "own-", "n", "name", "firm", "href", (), "body", "place", "", "day", tags=("tags",)))
    item = F.struct(F.col("seq").alias("n"), F.col("title").alias("name"), F.col("company").alias("firm"), F.col("url").alias("href"), F.col("description").alias("body"), F.col("location_raw").alias("place"), ISO().alias("day"), "tags")
    return tidy(json_feeds.map_json_feed(payloads(base(spark, sf), item, lambda a: F.struct(a.alias("rows"))), "own_board", RUN_OF(spark, sf)))
