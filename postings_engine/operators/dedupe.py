"""Collapsing the same vacancy seen on several feeds.

Keys: a company-variant key, then a URL alias. Merge: an ordered fold of each group. The
fold is exact, yet no task ever holds a whole group: see `merge_plan` and `fold`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .fold import fold_groups
from .skew import salted_lookup

MIN_STEM = 5


def company_variants(pairs: DataFrame) -> DataFrame:
    """(title_slug, company_slug) -> the shortest other company slug, of at least five
    characters, that opens this one within the same title. Only changed pairs are returned.

    Every slug is cut into its own prefixes, which makes "starts with" an equality: the
    work is linear in the slugs' lengths and a popular title never pairs up its companies."""
    pairs = pairs.where("title_slug <> ''").select("title_slug", "company_slug").distinct()
    stems = pairs.where(F.length("company_slug") >= MIN_STEM).withColumnRenamed("company_slug", "stem")
    longer = pairs.where(F.length("company_slug") > MIN_STEM)
    cuts = longer.select("title_slug", "company_slug", F.explode(F.transform(
        F.sequence(F.lit(MIN_STEM), F.length("company_slug") - 1),
        lambda n: F.substring(F.col("company_slug"), F.lit(1), n))).alias("stem"))
    return (cuts.join(stems, ["title_slug", "stem"])
            .groupBy("title_slug", "company_slug")
            .agg(F.min_by("stem", F.length("stem")).alias("stem")))


def variant_key(df: DataFrame, out: str = "fingerprint") -> DataFrame:
    """Employers whose name one feed abbreviates share a fingerprint. Needs the key columns."""
    mapping = company_variants(df)
    joined = salted_lookup(df, mapping, ["title_slug", "company_slug"])
    slug = F.coalesce("stem", "company_slug")
    own = F.substring(F.sha1(F.concat(slug, F.lit("|"), F.col("title_slug"))), 1, 16)
    rest = [c for c in df.columns if c != out]
    return joined.select(*rest, own.alias(out))


def url_alias(df: DataFrame, key: str = "fingerprint", out: str = "merge_key") -> DataFrame:
    """Postings sharing a URL take the first one's key. The first key per URL is a
    map-side-combined minimum, looked up again by salted join, so a URL that a third of the
    postings carry is neither windowed nor joined in one task."""
    firsts = (df.where("url_key <> ''").groupBy("url_key")
              .agg(F.min_by(key, "seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
              .where("_n > 1").drop("_n"))
    joined = salted_lookup(df, firsts, ["url_key"])
    return joined.withColumn(out, F.coalesce("_first", key)).drop("_first")


# ---------------------------------------------------------------------------- merge

FILLED = ("public_email", "public_phone", "best_contact_name", "contact_role", "company_website", "careers_page")
_CHUNKS = (1 << 16, 1 << 32)


def _present(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def completeness() -> Column:
    """What decides which copy survives; compared as a struct, left to right."""
    paid = F.coalesce(F.nullif("salary_min", F.lit(0.0)), F.nullif("day_rate_min", F.lit(0.0))).isNotNull()
    link = F.col("application_url")
    return F.struct(
        _present(F.col("public_email")).alias("email"), _present(F.col("company_website")).alias("site"),
        paid.alias("paid"), (_present(link) & ~link.contains("remoteok")).alias("direct"),
        F.coalesce("match_score", F.lit(0)).alias("score"), F.length(F.coalesce("description", F.lit(""))).alias("size"))


def _has_salary(s) -> Column:
    return F.coalesce(F.nullif(s["salary_min"], F.lit(0.0)), F.nullif(s["salary_max"], F.lit(0.0))).isNotNull()


def _slim(df: DataFrame, key: str) -> DataFrame:
    """(merge_key, seq, own, tail): `own` is what a row brings to the fold, `tail` sums up
    rows already known to lose to it."""
    own = F.struct(
        F.col("seq").alias("winner_seq"), completeness().alias("rank"), F.unix_micros(F.col("posted_at").cast("timestamp")).alias("posted_at"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in FILLED],
        F.struct("salary_min", "salary_max", F.coalesce("salary_currency", F.lit("")).alias("salary_currency")).alias("salary"),
        (F.coalesce(F.nullif("day_rate_min", F.lit(0.0)))).isNotNull().alias("day_paid"))
    return df.select(F.col(key).alias("merge_key"), "seq", own.alias("own"), _no_losers().alias("tail"),
                     F.lit(1).cast("long").alias("copies"), F.array_compact(F.array(F.nullif("source", F.lit("")))).alias("sources"))


def _no_losers() -> Column:
    first = "struct<seq:bigint,v:string>"
    pay = "struct<seq:bigint,v:struct<salary_min:double,salary_max:double,salary_currency:string>>"
    return F.struct(F.lit(None).cast("long").alias("posted_at"),
                    *[F.lit(None).cast(first).alias(c) for c in FILLED], F.lit(None).cast(pay).alias("salary"))


def _compress(df: DataFrame, chunk: int) -> DataFrame:
    """Within each (key, range of seq) keep only rows that beat everything before them; fold
    every other row into the summary of the kept row it follows.

    Exact because completeness never falls during the fold: the surviving row is at least as
    complete as every row merged so far, so a row not strictly above all earlier rows can
    only lose. A loser gives three things: its date, and the first non-blank value of a
    field still blank, and the first salary. Those are a minimum and first-values, so they
    summarise."""
    df = df.withColumn("_chunk", F.floor(F.col("seq") / chunk))
    order = Window.partitionBy("merge_key", "_chunk").orderBy("seq")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_best", F.max("own.rank").over(past))
    df = df.withColumn("_kept", F.col("_best").isNull() | (F.col("own.rank") > F.col("_best")))
    df = df.withColumn("_segment", F.sum(F.col("_kept").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lost = ~F.col("_kept")

    def first_value(name):
        mine = F.when(lost & (F.col(f"own.{name}") != ""), F.struct(F.col("seq").alias("seq"), F.col(f"own.{name}").alias("v")))
        return F.min(F.array_min(F.array_compact(F.array(mine, F.col(f"tail.{name}"))))).alias(name)

    my_pay = F.when(lost & _has_salary(F.col("own.salary")), F.struct(F.col("seq").alias("seq"), F.col("own.salary").alias("v")))
    # the salary struct may hold nulls, so order by seq alone
    pay_seq = F.coalesce(my_pay["seq"], F.col("tail.salary.seq"))
    pay = F.coalesce(my_pay, F.col("tail.salary"))
    return (df.groupBy("merge_key", "_chunk", "_segment").agg(
        F.min("seq").alias("seq"), F.min_by("own", "seq").alias("own"),
        F.min(F.least(F.when(lost, F.col("own.posted_at")), F.col("tail.posted_at"))).alias("_d"),
        *[first_value(c) for c in FILLED], F.min_by(pay, pay_seq).alias("salary"), F.sum("copies").alias("copies"),
        # distinct source lists only, so bounded by the feeds and not by the rows
        F.array_distinct(F.flatten(F.collect_set("sources"))).alias("sources"))
        .select("merge_key", "seq", "own", "copies", "sources", F.struct(F.col("_d").alias("posted_at"), *FILLED, "salary").alias("tail")))


def merge_plan(df: DataFrame, key: str = "merge_key") -> DataFrame:
    """(merge_key, winner_seq, posted_at, FILLED, salary, copies, merged_sources, first_seq): which row
    survives each group, with the fields it ends up with. After two rounds of compression a group has
    only rows that each beat all before it; those stream through the fold."""
    slim = _slim(df, key)
    for chunk in _CHUNKS:
        slim = _compress(slim, chunk)
    order = Window.partitionBy("merge_key").orderBy("seq")
    alone = (F.col("copies") == 1) & F.lag("seq").over(order).isNull() & F.lead("seq").over(order).isNull()
    slim = written(slim.withColumn("alone", alone), "fold")
    single = slim.where("alone").select(
        "merge_key", "own.winner_seq", "own.posted_at", *(f"own.{c}" for c in FILLED), "own.salary.*",
        "copies", F.array_sort("sources").alias("merged_sources"), F.col("seq").alias("first_seq"))
    folded = fold_groups(slim.where("NOT alone").drop("alone"), FILLED)
    return single.unionByName(folded).withColumn("posted_at", F.timestamp_micros("posted_at"))


def merge_duplicates(df: DataFrame, key: str = "merge_key", full: DataFrame | None = None) -> DataFrame:
    """One row per group: the surviving copy with gaps filled, the earliest date, all
    sources, `copies` merged and `first_seq` of the group. Only slim columns go through the
    grouping; full rows are shuffled once, by their own unique seq. `full` may name the table
    to take them from, when `df` is a narrower or joined form of it."""
    full = df if full is None else full
    moved = [*FILLED, "salary_min", "salary_max", "salary_currency", "posted_at"]
    plan = merge_plan(df, key).select(
        F.col("winner_seq").alias("seq"), F.col("merge_key").alias("_key"), *(F.col(c).alias(f"_{c}") for c in moved), "copies", "merged_sources", "first_seq")
    joined = full.join(plan, "seq")
    taken = {**{c: F.col(f"_{c}") for c in moved}, "sources": F.col("merged_sources"), "fingerprint": F.col("_key")}
    kept = [taken.get(c, F.col(c)).alias(c) for c in full.columns if c not in ("merge_key",)]
    return joined.select(*kept, "copies", "first_seq")


def refresh_age(df: DataFrame, run_ts: Column, tz: str) -> DataFrame:
    """Dates can move earlier in a merge: recompute what derives from them."""
    from ..functions.dates import add_age
    return add_age(df.drop("posted_date", "job_age_days", "job_age_label"), run_ts, tz)


KEY_COLUMNS = ("seq", "fingerprint", "title_slug", "company_slug", "url_key")


def deduplicate(leads: DataFrame, run_ts: Column | None = None, tz: str = "UTC", materialise: bool = True) -> DataFrame:
    """Keys, then merge. The leads are read four times and the keys twice, so both are
    written first; without that every reader would screen and score again."""
    keep = (lambda df: written(df, "merge")) if materialise else (lambda df: df)
    leads = keep(leads)
    keys = keep(url_alias(variant_key(leads.select(*KEY_COLUMNS))).select("seq", "merge_key"))
    out = merge_duplicates(leads.join(keys, "seq"), full=leads)
    return refresh_age(out, run_ts, tz) if run_ts is not None else out


# ---------------------------------------------------------------------- other joins


def _stem_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (title_slug, left company, right company) where one opens the other."""
    slugs = lambda df: (df.where((F.col("title_slug") != "") & (F.length("company_slug") >= MIN_STEM))
                        .select("title_slug", "company_slug").distinct())
    cut = lambda df, name: df.select("title_slug", F.col("company_slug").alias(name), F.explode(F.transform(
        F.sequence(F.lit(MIN_STEM), F.length("company_slug")),
        lambda n: F.substring(F.col("company_slug"), F.lit(1), n))).alias("stem"))
    whole = lambda df, name: df.select("title_slug", F.col("company_slug").alias(name), F.col("company_slug").alias("stem"))
    a, b = slugs(left), slugs(right)
    on = ["title_slug", "stem"]
    forward = cut(a, "left_slug").join(whole(b, "right_slug"), on)
    backward = whole(a, "left_slug").join(cut(b, "right_slug"), on)
    return forward.unionByName(backward).select("title_slug", "left_slug", "right_slug").distinct()


def same_role_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """The columns of left and `same_role`, the number of rows of right that are the same vacancy
    under a longer or shorter employer name. Employers are paired as distinct slugs; pairs of rows,
    which a title that two long lists share has without bound, are never written out."""
    sizes = right.groupBy("title_slug", F.col("company_slug").alias("right_slug")).agg(F.count(F.lit(1)).alias("_m"))
    found = (_stem_pairs(left, right).join(sizes, ["title_slug", "right_slug"])
             .groupBy("title_slug", F.col("left_slug").alias("company_slug")).agg(F.sum("_m").alias("_n")))
    return left.join(found, ["title_slug", "company_slug"], "left").select(left["*"], F.coalesce("_n", F.lit(0)).alias("same_role"))


def drop_covered(prospects: DataFrame, qualified: DataFrame) -> DataFrame:
    """Prospects not already qualified: no equal fingerprint and no same employer and role.
    The prefix test is an anti-join on prefixes both ways, never a pair list."""
    done = qualified.select("fingerprint").distinct()
    out = prospects.join(done, "fingerprint", "left_anti")
    covered = _stem_pairs(out, qualified).select("title_slug", F.col("left_slug").alias("company_slug")).distinct()
    return out.join(covered, ["title_slug", "company_slug"], "left_anti")


def sheet_dedupe(df: DataFrame, by: tuple = (), order: tuple = ()) -> DataFrame:
    """First row per fingerprint, else per company and title, in `order` (seq when none is
    given); `by` adds e.g. the sheet. Chosen by a combinable minimum and fetched back by its
    unique seq."""
    key = F.when(F.coalesce("fingerprint", F.lit("")) != "", F.col("fingerprint")).otherwise(
        F.lower(F.concat(F.coalesce("company", F.lit("")), F.lit("|"), F.coalesce("title", F.lit("")))))
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("seq"))
    firsts = df.groupBy(*by, key.alias("_k")).agg(F.min(place)["seq"].alias("seq")).drop("_k")
    return df.join(firsts, [*by, "seq"], "left_semi")


def union_leads(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def set_aside(leads: DataFrame, moved: DataFrame) -> DataFrame:
    """Leads minus the moved ones, by row identity."""
    return leads.join(moved.select("posting_id"), "posting_id", "left_anti")
