"""RSS items -> postings, with per-feed conventions for employer and location."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import posted_timestamp
from ..functions.text import html_to_text, named_entity, strip_space, unescape_entities
from ..registry import feed, register_feed
from ..schema import place_of, to_postings


@dataclass(frozen=True)
class RssMap:
    title_style: str = "plain"  # plain | company_colon_role | role_at_employer
    remote: bool = True
    company_default: str = "Undisclosed"
    creator: bool = True  # employer, then location after a line break, in dc:creator
    needs_link: bool = True


for _name, _map in {
    "weworkremotely": RssMap("company_colon_role", True, "", False, False),
    "jobspresso": RssMap(company_default="", needs_link=False),
    "nodesk": RssMap("role_at_employer"),
    "euremotejobs": RssMap(),
    "cryptocurrencyjobs": RssMap(),
}.items():
    register_feed(_name, _map)


def repair_entities(xml: Column) -> Column:
    """Resolve named entities XML does not define; unknown names are dropped."""
    def piece(p):
        name = F.regexp_extract(p, r"^&([A-Za-z][A-Za-z0-9]*;)", 1)
        rest = F.regexp_replace(p, r"^&[A-Za-z][A-Za-z0-9]*;", "")
        return (F.when((name == "") | name.isin("amp;", "lt;", "gt;", "quot;", "apos;"), p)
                .otherwise(F.concat(F.coalesce(named_entity(name), F.lit("")), rest)))
    return F.when(xml.contains("&"), F.array_join(F.transform(F.split(xml, "(?=&)"), piece), "")).otherwise(xml)


def element(item: Column, tag: str) -> Column:
    """Text of one element: CDATA as is, otherwise with entities resolved."""
    inner = strip_space(F.regexp_extract(item, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1))
    cdata = F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return strip_space(F.when(inner.contains("<![CDATA["), cdata).otherwise(unescape_entities(inner)))


def rss_items(payloads: DataFrame) -> DataFrame:
    """(payload_id, pos, item) for every <item>."""
    items = F.regexp_extract_all(repair_entities(F.col("payload")), F.lit(r"(?s)(<item[\s>].*?</item>)"), F.lit(1))
    return payloads.select("payload_id", F.posexplode(items).alias("pos", "item"))


def creator_parts(c: Column) -> tuple[Column, Column]:
    parts = F.split(c, r"<br\s*/?>", 2)
    place = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    return html_to_text(parts[0]), strip_space(F.replace(html_to_text(place), F.lit("⚲"), F.lit("")))


def map_rss_feed(payloads: DataFrame, name: str, run_ts: Column) -> DataFrame:
    spec: RssMap = feed(name)
    i = F.col("item")
    df = rss_items(payloads).select(
        place_of(F.col("payload_id"), F.col("pos")).alias("row_no"),
        element(i, "title").alias("t"), element(i, "link").alias("link"), element(i, "guid").alias("guid"),
        element(i, "dc:creator").alias("creator"), element(i, "content:encoded").alias("encoded"),
        element(i, "description").alias("summary"), element(i, "pubDate").alias("date"), element(i, "category").alias("category"),
        F.coalesce(F.nullif(element(i, "region"), F.lit("")), element(i, "[A-Za-z]+:region")).alias("region"))
    if spec.needs_link:
        df = df.where("link <> ''")
    title, company, place = F.col("t"), F.lit(""), F.col("region")
    if spec.creator:
        company, place = creator_parts(F.col("creator"))
    if spec.title_style == "company_colon_role":
        role = strip_space(F.regexp_extract("t", r"(?s)^[^:]*:(.*)$", 1))
        split = F.regexp_extract("t", r"(?s)^[^:]*:(.+)$", 1) != ""
        company = F.when(split, F.trim(F.regexp_extract("t", "^([^:]*):", 1))).otherwise("")
        title = F.when(split & (role != ""), role).otherwise(F.col("t"))
    elif spec.title_style == "role_at_employer":
        role = F.trim(F.regexp_extract("t", "(?s)^(.*) at (.*)$", 1))
        employer = F.trim(F.regexp_extract("t", "(?s)^(.*) at (.*)$", 2))
        both = (role != "") & (employer != "")
        title = F.when(both, role).otherwise(title)
        company = F.when(both, employer).otherwise(company)
    key = F.coalesce(F.nullif("guid", F.lit("")), "link")
    body = F.col("summary") if name == "weworkremotely" else F.coalesce(F.nullif("encoded", F.lit("")), "summary")
    prefix = "wwr" if name == "weworkremotely" else name
    out = df.select(
        "row_no", F.col("row_no").alias("seq"), F.concat(F.lit(prefix + "-"), key).alias("source_id"), title.alias("title"),
        F.when(company != "", company).otherwise(spec.company_default).alias("company"), F.col("link").alias("url"),
        F.col("link").alias("apply_url"), html_to_text(body).alias("description"),
        F.when(place != "", place).otherwise("Remote" if spec.remote else "").alias("location_raw"),
        posted_timestamp(F.col("date"), run_ts).alias("posted_at"),
        (F.array_compact(F.array(F.nullif("category", F.lit("")))) if name == "weworkremotely" else F.array().cast("array<string>")).alias("tags"),
        F.lit(True if spec.remote else None).cast("boolean").alias("is_remote"))
    full = to_postings(out)
    return full.withColumn("source", F.lit(name)).withColumn("posting_id", F.col("source_id")).withColumn("row_no", F.col("seq"))


def platform_rss(payloads: DataFrame, run_ts: Column) -> DataFrame:
    """Feeds of discovered platforms: payload rows carry platform, label and country."""
    df = payloads.select("payload_id", "platform", "label", "country")
    i = F.col("item")
    items = rss_items(payloads).join(df, "payload_id").select(
        place_of(F.col("payload_id"), F.col("pos")).alias("seq"), "platform", "label", "country",
        element(i, "title").alias("title"), element(i, "link").alias("url"), element(i, "guid").alias("guid"),
        element(i, "dc:creator").alias("creator"), element(i, "description").alias("summary"), element(i, "pubDate").alias("date"))
    out = items.where("url <> ''").select(
        "seq", F.concat("platform", F.lit("-"), F.coalesce(F.nullif("guid", F.lit("")), "url")).alias("source_id"), "title",
        F.coalesce(F.nullif("creator", F.lit("")), "label").alias("company"), "url", F.col("url").alias("apply_url"),
        html_to_text(F.col("summary")).alias("description"), F.col("country").alias("location_raw"),
        posted_timestamp(F.col("date"), run_ts).alias("posted_at"), F.col("platform").alias("discovered_platform"))
    return to_postings(out).withColumn("source", F.lit("discovered_platforms")).withColumn("posting_id", F.col("source_id"))
