"""Crawled HTML pages -> postings: structured data, item lists, links, listing cards, details."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.dates import posted_timestamp
from ..functions.text import (has_any, html_to_text, strip_space, unescape_entities, url_host, url_path, url_scheme)
from ..schema import place_of, to_postings

# ----------------------------------------------------------- structured data (JSON-LD)

CARRIED = ("url", "platform", "label", "country")


def ld_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, the carried columns, blocks): the ld+json scripts of every page, found JVM-side so
    that only they cross to Python."""
    blocks = F.regexp_extract_all("html", F.lit(fv.LD_JSON_BLOCK), F.lit(1))
    carried = [F.col(c).alias("page_url" if c == "url" else c) for c in CARRIED if c in pages.columns]
    return pages.where(F.col("html").rlike(r"(?i)ld\+json")).select("page_id", *carried, blocks.alias("blocks"))


def _objects(document, backwards: bool = False) -> Iterator[dict]:
    """Every object of a document, outer ones first, siblings in document order or from the last."""
    stack = [document]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            yield node
            node = list(node.values())
        if isinstance(node, list):
            inner = [x for x in node if isinstance(x, (dict, list))]
            stack.extend(inner if backwards else reversed(inner))


def _outer(document) -> set[int]:
    """Identities of a document's own objects: its top ones and those of their graphs."""
    top = [x for x in (document if isinstance(document, list) else [document]) if isinstance(x, dict)]
    graphs = [g for g in (x.get("@graph") for x in top) if isinstance(g, list)]
    return {id(x) for x in top} | {id(x) for g in graphs for x in g if isinstance(x, dict)}


def _employer(node: dict, named: dict[str, dict]) -> dict:
    org = node.get("hiringOrganization")
    if isinstance(org, list):
        org = org[0] if org else None
    if not isinstance(org, dict):
        return {}
    return named.get(org["@id"], {}) if set(org) == {"@id"} and isinstance(org["@id"], str) else org


def _read_block(document, first: int) -> tuple[list[tuple], int]:
    """(pos, kind, outer, employer, body) of a document's postings, or of its list entries if it holds
    no posting, and the number of the next object."""
    objects = list(_objects(document))
    kinds = [str(node.get("@type") or "") for node in objects]
    outer, listing = _outer(document), "JobPosting" not in kinds
    named: dict[str, dict] = {}
    for node in _objects(document, backwards=True):  # of objects with one id the last sibling counts
        if isinstance(node.get("@id"), str) and len(node) > 1:
            named.setdefault(node["@id"], node)
    out = []
    for pos, (node, kind) in enumerate(zip(objects, kinds), first):
        own = id(node) in outer
        if kind == "JobPosting" or (own and "JobPosting" in kind):
            out.append((pos, kind, own, json.dumps(_employer(node, named)), json.dumps(node)))
        elif listing and kind == "ListItem":
            out.append((pos, kind, own, None, json.dumps(node)))
    return out, first + len(objects)


def ld_nodes(pages: DataFrame) -> DataFrame:
    """(page_id, the carried columns, block, pos, kind, is_outer, employer, node): postings and list
    entries. The recursive walk is the one Python stage and runs once a page: a document's nesting has no
    bound that a column expression could unroll. It also follows an employer given as a bare @id, and
    takes the page's own columns along, so nothing is joined or shuffled. A script that is not JSON, or
    nested deeper than Python's stack, gives no node."""
    found = ld_blocks(pages)
    carried = found.columns[1:-1]
    names = ["page_id", *carried, "block", "pos", "kind", "is_outer", "employer", "body"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for *page, blocks in batch.itertuples(index=False, name=None):
                at = 0  # objects are numbered through the page
                for block, data in enumerate(blocks):
                    try:
                        rows, at = _read_block(json.loads(data.strip()), at)
                    except (ValueError, RecursionError):
                        continue
                    out.extend((*page, block, *row) for row in rows)
            yield pd.DataFrame(out, columns=names)
    shape = ", ".join(["page_id bigint", *[f"{c} string" for c in carried], "block int", "pos int", "kind string", "is_outer boolean", "employer string", "body string"])
    nodes = found.mapInPandas(walk, shape)
    return nodes.withColumn("node", F.try_parse_json("body")).withColumn("employer", F.try_parse_json("employer"))


def _first_posting(pages: DataFrame, test: Column) -> DataFrame:
    """(page_id, body): the first object of its own that passes, for each page that has one."""
    nodes = ld_nodes(pages.select("page_id", "html")).where(F.col("is_outer") & test)
    return nodes.groupBy("page_id").agg(F.min(F.struct("block", "pos", "body")).alias("f")).select("page_id", "f.body")


def _text(path: str, v="node") -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def jsonld_postings(pages: DataFrame, run_ts: Column) -> DataFrame:
    """pages(page_id, url, html, platform, label, country). An employer given as a bare @id
    reference is the object of the same document that declares the id."""
    joined = ld_nodes(pages).where("kind = 'JobPosting'")
    name = strip_space(_text("$.name", "employer"))
    company = F.when((name == "") | name.rlike(fv.HIDDEN_EMPLOYER), "Undisclosed").otherwise(name)
    place = F.coalesce(F.try_variant_get("node", "$.jobLocation[0].address", "variant"), F.try_variant_get("node", "$.jobLocation.address", "variant"))
    part = lambda p: F.nullif(F.try_variant_get(place, f"$.{p}", "string"), F.lit(""))
    where = F.concat_ws(", ", *[F.when(~part(p).startswith("{") & ~part(p).startswith("["), part(p))
                                for p in ("addressLocality", "addressRegion", "addressCountry")])
    title = strip_space(_text("$.title"))
    url = F.coalesce(F.nullif(_text("$.url"), F.lit("")), "page_url")
    out = joined.where(title != "").select(
        _page_seq().alias("seq"),
        F.concat("platform", F.lit("-"), F.coalesce(F.nullif(_text("$.identifier"), F.lit("")), url), F.lit("-"), title).alias("source_id"),
        title.alias("title"), company.alias("company"), url.alias("url"), url.alias("apply_url"), html_to_text(_text("$.description")).alias("description"),
        F.when(where != "", where).otherwise(F.col("country")).alias("location_raw"), posted_timestamp(_text("$.datePosted"), run_ts).alias("posted_at"),
        _text("$.employmentType").alias("employment_type_raw"), F.col("platform").alias("discovered_platform"), F.lit(True).alias("truncated_description"))
    return _stamped(out, "discovered_platforms")


def _page_seq() -> Column:
    return place_of(F.col("page_id"), F.col("pos"))


def _stamped(out: DataFrame, source: str) -> DataFrame:
    return to_postings(out).withColumn("source", F.lit(source)).withColumn("posting_id", F.col("source_id"))


def itemlist_links(pages: DataFrame) -> DataFrame:
    """List entries of blocks that hold no posting: https link and name, marked truncated."""
    items = ld_nodes(pages).where("kind = 'ListItem'")
    url, title = strip_space(_text("$.item.url")), strip_space(_text("$.item.name"))
    out = items.where(url.startswith("https://") & (title != "")).select(
        _page_seq().alias("seq"), F.concat("platform", F.lit("-"), url).alias("source_id"), title.alias("title"), F.col("label").alias("company"),
        url.alias("url"), url.alias("apply_url"), F.col("country").alias("location_raw"), F.col("platform").alias("discovered_platform"),
        F.lit(True).alias("truncated_description"))
    return _stamped(out, "discovered_platforms")


def advert_bodies(pages: DataFrame) -> DataFrame:
    """(page_id, body, advert_posted, advert_employment, advert_applicants) of fetched advert
    pages: the first posting block, else a known body container."""
    first = _first_posting(pages, F.col("kind").contains("JobPosting"))
    n = F.try_parse_json("body")
    kinds = F.try_variant_get(n, "$.employmentType", "array<string>")
    employment = F.coalesce(F.array_join(kinds, ", "), F.try_variant_get(n, "$.employmentType", "string"), F.lit(""))
    read = first.select("page_id", html_to_text(F.try_variant_get(n, "$.description", "string")).alias("_b"),
                        F.coalesce(F.try_variant_get(n, "$.datePosted", "string"), F.lit("")).alias("advert_posted"),
                        F.initcap(F.replace(employment, F.lit("_"), F.lit(" "))).alias("advert_employment"))
    container = html_to_text(F.regexp_extract("html", fv.BODY_CONTAINER, 1))
    return pages.select("page_id", container.alias("_c")).join(read, "page_id", "left").select(
        "page_id", F.coalesce("_b", "_c").alias("body"), F.coalesce("advert_posted", F.lit("")).alias("advert_posted"),
        F.coalesce("advert_employment", F.lit("")).alias("advert_employment"), F.lit("").alias("advert_applicants"))


# --------------------------------------------------------------------- result pages


def _resolved(base: Column, href: Column) -> Column:
    """Absolute form of a link: absolute, scheme-relative, rooted, or relative to the folder."""
    origin = F.concat(url_scheme(base), F.lit("://"), F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    folder = F.regexp_replace(url_path(base), r"[^/]*$", "")
    rooted = F.when(href.startswith("/"), href).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), href))
    # one "dir/.." pair at a time covers the nesting that occurs in links
    for _ in range(4):
        rooted = F.regexp_replace(F.regexp_replace(rooted, r"/\./", "/"), r"/(?!\.\./)[^/]+/\.\./", "/")
    return (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href).when(href.startswith("//"), F.concat(url_scheme(base), F.lit(":"), href))
            .when(href.startswith("?"), F.concat(origin, url_path(base), href)).otherwise(F.concat(origin, rooted)))


def detail_links(pages: DataFrame, max_per_page: int | None = None, hints: tuple[str, ...] = fv.DETAIL_HINTS) -> DataFrame:
    """(page_id, n, link): same-host https advert links in document order. All of it happens
    inside the page's own row, so nothing is shuffled."""
    base = F.col("url")
    hrefs = F.regexp_extract_all("html", F.lit(r'href="([^"#]+)"'), F.lit(1))
    # the link table of one page, filtered and cut, before it is ever exploded
    links = F.transform(hrefs, lambda h: _resolved(base, unescape_entities(h)))
    path = lambda u: F.lower(url_path(u))
    good = F.filter(links, lambda u: (url_scheme(u) == "https") & (url_host(u) == url_host(base)) & has_any(path(u), hints)
                    & (F.length(F.regexp_replace(F.regexp_replace(path(u), "/+$", ""), "[^/]", "")) >= 2))
    kept = F.array_distinct(F.transform(good, lambda u: F.split(u, r"\?", 2)[0]))
    if max_per_page is not None:
        kept = F.slice(kept, 1, max_per_page)
    return pages.select("page_id", F.posexplode(kept).alias("n", "link"))


def _inner(c: Column, pattern: str) -> Column:
    raw = F.regexp_extract(c, "(?s)" + pattern, 1)
    return strip_space(unescape_entities(F.regexp_replace(raw, "<[^>]+>", " ")))


CARD_SELECTORS = {
    "item": r"(?s)<li>(.*?)</li>",
    "title": r'class="base-search-card__title"[^>]*>(.*?)</h3>',
    "company": r'class="base-search-card__subtitle"[^>]*>(.*?)</h4>',
    "location": r'class="job-search-card__location"[^>]*>(.*?)</span>',
    "date": r'datetime="([\d\-]+)"',
    "link": r'href="(https://[^"?]+/jobs/view/[^"?]+)',
    "id": r'data-entity-urn="urn:li:jobPosting:(\d+)"',
    "id_in_link": r"-(\d{6,})$",
    "link_template": "https://www.linkedin.com/jobs/view/",
    "prefix": "linkedin-",
    "source": "linkedin",
}


def html_cards(pages: DataFrame, run_ts: Column, selectors: dict | None = None) -> DataFrame:
    """Listing cards -> postings; cards without a title or an id are dropped."""
    s = {**CARD_SELECTORS, **(selectors or {})}
    cards = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(s["item"]), F.lit(1))).alias("pos", "card"))
    card = F.col("card")
    link = F.regexp_extract(card, s["link"], 1)
    tail = F.regexp_extract(link, s["id_in_link"], 1)
    job = F.coalesce(F.nullif(F.regexp_extract(card, s["id"], 1), F.lit("")), F.nullif(tail, F.lit("")), link)
    company = _inner(card, s["company"])
    df = cards.select("page_id", "pos", _inner(card, s["title"]).alias("title"), F.when(company != "", company).otherwise("Undisclosed").alias("company"),
                      _inner(card, s["location"]).alias("location_raw"), F.regexp_extract(card, s["date"], 1).alias("date"), link.alias("link"), job.alias("job"))
    df = df.where("title <> '' and job <> ''")
    url = F.when(F.col("link") != "", F.col("link")).otherwise(F.concat(F.lit(s["link_template"]), "job"))
    out = df.select(place_of(F.col("page_id"), F.col("pos")).alias("seq"), F.concat(F.lit(s["prefix"]), "job").alias("source_id"), "title", "company",
                    url.alias("url"), url.alias("apply_url"), "location_raw", posted_timestamp(F.col("date"), run_ts).alias("posted_at"),
                    F.lit(True).alias("is_remote"), F.col("job").alias("linkedin_job_id"), F.lit(True).alias("truncated_description"))
    return _stamped(out, s["source"])


def html_detail(pages: DataFrame) -> DataFrame:
    """(page_id, body, employment_type, seniority_tag, applicants, company_linkedin) of detail
    pages; a body counts when longer than 200 characters."""
    html = F.col("html")
    marked = r'(?s)class="(?:show-more-less-html__markup|description__text)[^"]*"[^>]*>(.*?)</div>'
    inner = F.regexp_extract(html, marked, 1)
    body = html_to_text(F.when(html.rlike(marked), inner).otherwise(html))
    pair = r"(?s)job-criteria-subheader[^>]*>(.*?)</h3>\s*<span[^>]*job-criteria-text[^>]*>(.*?)</span>"
    labels, values = (F.transform(F.regexp_extract_all(html, F.lit(pair), F.lit(g)), html_to_text) for g in (1, 2))
    facts = F.arrays_zip(F.transform(labels, F.lower).alias("k"), values.alias("v"))
    last = lambda word: F.coalesce(F.try_element_at(F.transform(F.filter(facts, lambda p: p["k"].contains(word)), lambda p: p["v"]), F.lit(-1)), F.lit(""))
    return pages.select(
        "page_id", F.when(F.length(body) > 200, body).otherwise("").alias("body"),
        last("employment type").alias("employment_type"), last("seniority").alias("seniority_tag"),
        strip_space(unescape_entities(F.regexp_extract(html, r"num-applicants__caption[^>]*>\s*([^<]+?)\s*<", 1))).alias("applicants"),
        F.regexp_extract(html, r'topcard__org-name-link[^>]*href="([^"?]+)', 1).alias("company_linkedin"))


def offer_pages(pages: DataFrame, run_ts: Column) -> DataFrame:
    """Aggregator offer pages: the posting block, with the location stated in the body first."""
    first = _first_posting(pages, F.col("kind") == "JobPosting")
    n = F.try_parse_json("body")
    read = lambda p: F.coalesce(F.try_variant_get(n, p, "string"), F.lit(""))
    df = pages.select("page_id", "url").join(first, "page_id").select(
        "page_id", "url", n.alias("node"), html_to_text(read("$.description")).alias("description"), read("$.title").alias("title"),
        read("$.hiringOrganization.name").alias("name"), read("$.hiringOrganization.sameAs").alias("site"), read("$.datePosted").alias("date"),
        F.coalesce(F.array_join(F.try_variant_get(n, "$.employmentType", "array<string>"), ", "), read("$.employmentType")).alias("emp"))
    stated = F.trim(F.regexp_extract("description", r"(?i)the offer is available from[:\s]*([^\n.]{2,200})", 1))
    raw = F.coalesce(F.try_variant_get("node", "$.jobLocation", "array<variant>"), F.array(F.try_variant_get("node", "$.jobLocation", "variant")))
    raw = F.when(F.try_variant_get("node", "$.jobLocation", "variant").isNotNull(), raw).otherwise(
        F.coalesce(F.try_variant_get("node", "$.applicantLocationRequirements", "array<variant>"),
                   F.array(F.try_variant_get("node", "$.applicantLocationRequirements", "variant"))))
    names = F.flatten(F.transform(raw, lambda e: F.array(F.try_variant_get(e, "$.name", "string"), F.try_variant_get(e, "$.address.addressCountry", "string"))))
    listed = F.array_join(F.array_distinct(F.filter(names, lambda x: x != "")), ", ")
    out = df.where("description <> ''").select(
        F.col("page_id").alias("seq"), F.concat(F.lit("jobgether-"), F.regexp_extract(url_path(F.col("url")), "([^/]*)$", 1)).alias("source_id"),
        "title", F.when(F.col("name") != "", F.col("name")).otherwise("Undisclosed").alias("company"), "url", F.col("url").alias("apply_url"), "description",
        F.when(stated != "", stated).when(F.coalesce(listed, F.lit("")) != "", listed).otherwise("Remote").alias("location_raw"),
        posted_timestamp(F.col("date"), run_ts).alias("posted_at"), F.initcap(F.replace("emp", F.lit("_"), F.lit(" "))).alias("employment_type_raw"),
        F.col("site").alias("company_website"), F.lit(True).alias("is_remote"), stated.alias("available_from"))
    return _stamped(out, "jobgether")


# -------------------------------------------------------------------------- threads


def thread_postings(comments: DataFrame, run_ts: Column) -> DataFrame:
    """comments(object_id, parent_id, story_id, comment_text, created_at, row_no): direct
    children of the thread with a real body become postings."""
    body = html_to_text(F.col("comment_text"))
    df = comments.where(F.col("parent_id") == F.col("story_id")).select("object_id", "row_no", "created_at", body.alias("body"))
    df = df.where(F.length("body") >= 120).withColumn("line", strip_space(F.split("body", "\n", 2)[0]))
    company = F.trim(F.split("line", r"\|", 2)[0])
    url = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("object_id").cast("string"))
    out = df.select(F.col("row_no").alias("seq"), F.concat(F.lit("hn-"), F.col("object_id").cast("string")).alias("source_id"),
                    F.col("line").alias("title"), F.when(company != "", company).otherwise("Undisclosed").alias("company"),
                    url.alias("url"), url.alias("apply_url"), F.col("body").alias("description"),
                    posted_timestamp(F.col("created_at"), run_ts).alias("posted_at"))
    return _stamped(out, "hackernews")
