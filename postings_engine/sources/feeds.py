"""Feed-level jobs: corpus, union, per-feed dedupe, statistics, routing, mined boards, URL checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv
from ..functions.text import any_of, no, normalise, url_scheme
from ..operators.skew import salted_lookup
from ..schema import ROW_BITS, place_of, to_postings

CORPUS_DDL = ("id string, source string, title string, company string, location string, url string, description string, "
              "days_ago int, hours_ago int, employment_type string, salary_min double, salary_max double, "
              "salary_currency string, salary_raw string, apply_url string, company_website string, tags array<string>, "
              "extra struct<is_remote:boolean,truncated_description:boolean,applicants:string,direct_employer:boolean,company_linkedin:string>")


def read_corpus(spark, path: str, run_ts: Column) -> DataFrame:
    """A landed posting corpus (JSON array per file) with ages relative to the run."""
    df = spark.read.schema(CORPUS_DDL).option("multiLine", True).json(path)
    return corpus_postings(df, run_ts)


def corpus_postings(df: DataFrame, run_ts: Column) -> DataFrame:
    zero = F.lit(0)
    age = F.make_interval(zero, zero, zero, F.coalesce("days_ago", zero), F.coalesce("hours_ago", F.lit(3)))
    order = F.monotonically_increasing_id()
    df = df.select(
        "*", (run_ts - age).alias("posted_at"), order.alias("seq"),
        F.coalesce(F.nullif("apply_url", F.lit("")), "url").alias("_apply"))
    extra = ("is_remote", "truncated_description", "applicants", "direct_employer", "company_linkedin")
    return to_postings(df.select(
        F.coalesce("id", F.concat(F.lit("fixture-"), "seq")).alias("posting_id"), "seq",
        F.coalesce("source", F.lit("fixtures")).alias("source"),
        F.coalesce("id", F.concat(F.lit("fixture-"), "seq")).alias("source_id"), "title", "company", "url", "description",
        F.col("location").alias("location_raw"), F.col("_apply").alias("apply_url"), "posted_at",
        F.col("employment_type").alias("employment_type_raw"), "salary_raw", "salary_min", "salary_max", "salary_currency",
        "company_website", "tags", *[F.col(f"extra.{c}").alias(c) for c in extra]))


def tags_of(c: Column, kind: T.DataType) -> Column:
    """List, comma string or scalar -> array without nulls and blanks."""
    if isinstance(kind, T.ArrayType):
        return F.filter(F.transform(c, lambda x: x.cast("string")), lambda x: x.isNotNull() & (x != ""))
    if isinstance(kind, T.StringType):
        return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(c.isNotNull() & (c.cast("string") != "0"), F.array(c.cast("string")))


def as_tags(df: DataFrame, col: str, out: str = "tags") -> DataFrame:
    kind = df.schema[col].dataType
    return df.withColumn(out, F.coalesce(tags_of(F.col(col), kind), F.array().cast("array<string>")))


FAN_IN = 32


def union_feeds(feeds: dict[str, DataFrame], order: tuple[str, ...] = fv.FEED_ORDER) -> DataFrame:
    """One postings table. `source` is stamped, remote-only feeds default `is_remote`, and
    seq sorts by feed, then by the feed's own row order. A feed brings `row_no` (its stable
    order); without one the file order is used. No sort and no shuffle."""
    frames = []
    for name, df in feeds.items():
        at = order.index(name) if name in order else len(order)
        row = F.col("row_no") if "row_no" in df.columns else F.monotonically_increasing_id()
        df = df.select("*", place_of(F.lit(at).cast("long"), row, ROW_BITS, 63 - ROW_BITS).alias("_seq"))
        df = to_postings(df.drop("seq").withColumnRenamed("_seq", "seq"))
        if name in fv.REMOTE_ONLY_FEEDS:
            df = df.withColumn("is_remote", F.coalesce("is_remote", F.lit(True)))
        frames.append(df.withColumn("source", F.lit(name)))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.withColumn("posting_id", F.coalesce(F.nullif("posting_id", F.lit("")), F.concat_ws(":", "source", F.col("seq").cast("string"))))


def dedupe_by_id(df: DataFrame) -> DataFrame:
    """First row per feed and source_id (else url). A combinable minimum over (feed, key),
    then a semi-join on the unique seq: a key repeated very often is reduced before it is
    shuffled."""
    key = F.when(F.coalesce("source_id", F.lit("")) != "", F.col("source_id")).otherwise(F.col("url"))
    firsts = df.groupBy("source", key.alias("_key")).agg(F.min("seq").alias("seq")).select("seq")
    return df.join(firsts, "seq", "left_semi")


def source_stats(manifest: DataFrame, postings: DataFrame) -> DataFrame:
    """manifest(name, ok, error, elapsed): rows per feed, zero for failed ones."""
    counts = postings.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("_n"))
    return manifest.join(counts, "name", "left").select(
        "name", F.when(F.col("ok"), F.coalesce("_n", F.lit(0))).otherwise(0).cast("long").alias("raw_count"), "ok",
        F.coalesce("error", F.lit("")).alias("error"), F.round("elapsed", 1).alias("elapsed"))


def route_feeds(feeds: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """feeds(name, markets array): adds `serves`; false means skipped for market."""
    asked = F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>")
    open_to_all = F.size(F.coalesce("markets", F.array().cast("array<string>"))) == 0
    return feeds.withColumn("serves", open_to_all | F.lit(not wanted) | F.arrays_overlap("markets", asked))


def seed_boards(boards: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """Employers without a region, or whose region and a wanted country contain one another.
    The wanted list is the profile's, so the theta semi-join is a constant predicate."""
    region = normalise(F.col("region"))
    hits = [region.contains(w) | F.lit(w).contains(region) for w in wanted]
    return boards.where((region == "") | (any_of(hits) if wanted else F.lit(True)))


def board_tokens(postings: DataFrame, cap: int | None = None) -> DataFrame:
    """(kind, token) of employer boards linked from any URL, in system order, the first `cap` if one is given."""
    urls = postings.select(F.explode(F.array("url", "apply_url", "company_website")).alias("u")).where("u <> ''")
    def tokens(kind, pattern):
        return F.transform(F.regexp_extract_all("u", F.lit("(?i)" + pattern), F.lit(1)),
                           lambda t: F.struct(F.lit(kind).alias("kind"), F.lower(t).alias("token")))
    found = F.flatten(F.array(*[tokens(kind, pattern) for kind, pattern in fv.BOARD_TOKENS]))
    rows = urls.where(F.col("u").rlike("(?i)greenhouse|lever|ashby|workable|recruitee|smartrecruiters|teamtailor"))
    distinct = rows.select(F.explode(found).alias("t")).select("t.*").distinct()
    systems = {k: i for i, k in enumerate(dict.fromkeys(k for k, _ in fv.BOARD_TOKENS))}
    place = F.create_map(*[F.lit(x) for kv in systems.items() for x in kv])[F.col("kind")]
    ordered = distinct.select("kind", "token", place.alias("place")).orderBy("place", "token")
    return (ordered if cap is None else ordered.limit(cap)).select("kind", "token")


def with_market_code(df: DataFrame, col: str = "market") -> DataFrame:
    """Adds the market's feed code and default currency ('' when unknown)."""
    def table(d):
        return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    code = F.try_element_at(table(fv.MARKET_CODES), F.lower(F.trim(col)))
    df = df.withColumn("market_code", F.coalesce(code, F.lit("")))
    return df.withColumn("market_currency", F.coalesce(F.try_element_at(table(fv.MARKET_CURRENCY), F.col("market_code")), F.lit("")))


def url_objection(template: Column) -> Column:
    """Why a search URL template must not be used, '' when it is safe."""
    url = F.replace(template, F.lit("{query}"), F.lit("x"))
    netloc = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.regexp_replace(netloc, r":[^:]*$", "")
    port = F.regexp_extract(netloc, r":([^:]*)$", 1)
    return (F.when(~template.contains("{query}"), "no {query} placeholder")
            .when(url_scheme(url) != "https", "scheme is not allowed")
            .when(netloc.contains("@"), "credentials in the URL")
            .when((port != "") & ~port.rlike(r"^[0-9]{1,5}$"), "malformed port")
            .when((port != "") & (port.cast("int") > 65535), "malformed port")
            .when((port != "") & (port.cast("int") != 443), "port is not allowed")
            .when(~host.contains("."), "no public hostname").otherwise(""))


def screen_urls(candidates: DataFrame, cap: int | None = None, by: str = "country", col: str = "url_template") -> DataFrame:
    """Adds `reason`, and `kept` for the safe templates: all of them or, with a cap, the first `cap`
    of each group by seq. Groups are trimmed to `cap` in ever fewer hashed pieces, so no array
    holds more than FAN_IN times the cap."""
    df = candidates.withColumn("reason", url_objection(F.coalesce(col, F.lit(""))))
    safe = F.col("reason") == ""
    if cap is None:
        return df.withColumn("kept", safe)
    pieces, lows = 1 << 15, df.where(safe).select(by, "seq")
    while pieces:
        piece = F.pmod(F.xxhash64("seq"), F.lit(pieces))
        place = Window.partitionBy(by, "_piece").orderBy("seq")
        lows = lows.withColumn("_piece", piece).withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= cap).select(by, "seq")
        pieces //= FAN_IN
    return df.join(lows.select("seq", F.lit(True).alias("kept")), "seq", "left").withColumn("kept", F.coalesce("kept", no()))
