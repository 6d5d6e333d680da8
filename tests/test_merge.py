"""Duplicate keys, the merge fold and the registry upsert against plain loops."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from postings_engine.operators import dedupe, skew, state

FILLED = dedupe.FILLED


def random_leads(rng, n, groups, hot=0.4):
    rows = []
    for seq in range(n):
        key = "hot" if rng.random() < hot else f"g{rng.randrange(groups)}"
        maybe = lambda v: v if rng.random() < 0.4 else ""
        rows.append(dict(
            seq=seq, merge_key=key, fingerprint=key, source=rng.choice(["a", "b", "c"]), posting_id=str(seq), match_score=rng.randrange(0, 6), description="x" * rng.randrange(0, 4),
            application_url=rng.choice(["", "https://remoteok.com/1", "https://own.com/1"]), salary_min=rng.choice([None, None, 0.0, 10.0, 20.0]), salary_max=rng.choice([None, None, 30.0]),
            salary_currency=maybe("GBP"), day_rate_min=rng.choice([None, None, None, 5.0]), posted_at=None if rng.random() < 0.3 else datetime(2024, 1, 1) + timedelta(hours=rng.randrange(500)),
            **{c: maybe(f"{c}{seq}") for c in FILLED}))
    return rows


def loop_merge(rows):
    def rank(r):
        return (bool(r["public_email"]), bool(r["company_website"]), bool(r["salary_min"] or r["day_rate_min"]),
                bool(r["application_url"]) and "remoteok" not in r["application_url"], r["match_score"], len(r["description"]))
    kept = {}
    for row in sorted(rows, key=lambda r: r["seq"]):
        row = dict(row)
        old = kept.get(row["merge_key"])
        if old is None:
            kept[row["merge_key"]] = row
            continue
        win, lose = (row, old) if rank(row) > rank(old) else (old, row)
        if win["posted_at"] and lose["posted_at"] and lose["posted_at"] < win["posted_at"]:
            win["posted_at"] = lose["posted_at"]
        for c in FILLED:
            win[c] = win[c] or lose[c]
        if not (win["salary_min"] or win["salary_max"]) and (lose["salary_min"] or lose["salary_max"]):
            win["salary_min"], win["salary_max"] = lose["salary_min"], lose["salary_max"]
            win["salary_currency"] = win["salary_currency"] or lose["salary_currency"]
        kept[row["merge_key"]] = win
    return kept


SCHEMA = ("seq bigint, merge_key string, fingerprint string, source string, posting_id string, match_score int, description string, application_url string, salary_min double, salary_max double, "
          "salary_currency string, day_rate_min double, posted_at timestamp, " + ", ".join(f"{c} string" for c in FILLED))
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def test_merge_equals_a_loop(spark, monkeypatch):
    # tiny chunks, so that one group spans many of them
    monkeypatch.setattr(dedupe, "_CHUNKS", (7, 40))
    rng = random.Random(5)
    rows = random_leads(rng, 600, 60)
    df = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], SCHEMA).withColumn("sources", F.array("source"))
    got = {r.fingerprint: r for r in dedupe.merge_duplicates(df).collect()}
    want = loop_merge(rows)
    assert got.keys() == want.keys()
    for key, w in want.items():
        g = got[key]
        assert g.posting_id == w["posting_id"], key
        for c in (*FILLED, "salary_min", "salary_max", "salary_currency", "posted_at"):
            assert (g[c] or None) == (w[c] or None), (key, c)
        assert g.copies == sum(r["merge_key"] == key for r in rows)
        assert g.sources == sorted({r["source"] for r in rows if r["merge_key"] == key})


def test_keys_equal_a_loop(spark):
    rng = random.Random(11)
    stems = ["bright", "brightspark", "brightsparkenergy", "volt", "voltworks", "acme", "acmewidgets"]
    rows = [(i, rng.choice(["dev", "sparky", ""]), rng.choice(stems), rng.choice(["", "x.com/1", "x.com/2", f"x.com/{i}"])) for i in range(300)]
    df = spark.createDataFrame(rows, "seq bigint, title_slug string, company_slug string, url_key string").withColumn(
        "fingerprint", F.substring(F.sha1(F.concat("company_slug", F.lit("|"), "title_slug")), 1, 16))
    got = {r.seq: (r.fingerprint, r.merge_key) for r in dedupe.url_alias(dedupe.variant_key(df)).collect()}

    import hashlib
    fp = lambda c, t: hashlib.sha1(f"{c}|{t}".encode()).hexdigest()[:16]
    own = {i: fp(c, t) for i, t, c, _ in rows}
    for title in {t for _, t, _, _ in rows if t}:
        group = sorted((r for r in rows if r[1] == title), key=lambda r: len(r[2]))
        for at, (i, _, short, _) in enumerate(group):
            if len(short) >= 5:
                for j, _, other, _ in group[at + 1:]:
                    if other != short and other.startswith(short):
                        own[j] = own[i]
    index, want = {}, {}
    for i, _, _, url in rows:
        key = own[i]
        if url and url in index:
            key = index[url]
        elif url:
            index[url] = key
        want[i] = (own[i], key)
    assert got == want


def test_registry_equals_a_loop(spark):
    rng = random.Random(3)
    seen = [(f"f{i}", "t", "c", "u", datetime(2024, 1, 1).date(), datetime(2024, 1, 2).date(), 2, 50, "Applied", "") for i in range(10)]
    leads = [(i, str(i), f"f{rng.randrange(20)}", rng.randrange(100), f"t{i}", "c", "u") for i in range(60)]
    registry, labelled = state.upsert_seen(
        spark.createDataFrame(seen, state.SEEN_SCHEMA),
        spark.createDataFrame(leads, "seq bigint, posting_id string, fingerprint string, match_score int, title string, company string, original_job_url string"), F.lit("2024-02-01").cast("date"))
    table = {s[0]: [s[6], s[7], s[1]] for s in seen}
    new = set()
    for seq, _, key, value, title, _, _ in leads:
        if key not in table:
            table[key], _ = [1, value, title], new.add(seq)
        else:
            table[key] = [table[key][0] + 1, max(table[key][1], value), title]
    assert {r.fingerprint: [r.times_seen, r.best_match_score, r.title] for r in registry.collect()} == table
    assert {r.seq for r in labelled.where("is_new").collect()} == new


def test_running_total(spark):
    df = spark.range(1000).select(F.col("id").alias("seq"), (F.col("id") % 7).cast("double").alias("v"))
    got = {r.seq: r.before for r in skew.running_total(df, F.col("v"), "seq", "before", chunk=64).collect()}
    total = 0.0
    for i in range(1000):
        assert got[i] == total
        total += i % 7


def test_a_group_of_a_million_rows(spark):
    """Rising score, and in a second group rising length: every row beats all before it."""
    n = 1_000_000
    df = spark.range(n).select(
        F.col("id").alias("seq"), F.lit("hot").alias("merge_key"), F.col("id").cast("int").alias("match_score"), F.lit("").alias("description"))
    m = 3_000
    df = df.unionByName(spark.range(n, n + m).select(
        F.col("id").alias("seq"), F.lit("long").alias("merge_key"), F.lit(7).alias("match_score"), F.repeat(F.lit("x"), (F.col("id") - n).cast("int")).alias("description")))
    at = F.when(F.col("seq") < n, F.col("seq")).otherwise(F.col("seq") - n)
    blank = F.lit("")
    df = df.select(
        "*", F.col("merge_key").alias("fingerprint"), F.lit("a").alias("source"), F.array(F.lit("a")).alias("sources"), F.col("seq").cast("string").alias("posting_id"), blank.alias("application_url"),
        F.when(at == 3, 10.0).alias("salary_min"), F.lit(None).cast("double").alias("salary_max"), F.when(at % 1000 == 9, F.lit("GBP")).otherwise(blank).alias("salary_currency"), F.lit(None).cast("double").alias("day_rate_min"),
        F.timestamp_seconds(1_700_000_000 + at).alias("posted_at"), blank.alias("public_email"), F.when(at % 1000 == 7, F.concat(F.lit("p"), at.cast("string"))).otherwise(blank).alias("public_phone"),
        blank.alias("best_contact_name"), blank.alias("contact_role"), blank.alias("company_website"), F.when(at == 5, F.lit("careers")).otherwise(blank).alias("careers_page"))
    got = {r.fingerprint: r for r in dedupe.merge_duplicates(df.where("merge_key = 'long'")).collect()}
    # the paid row 3 stays, as no later row is paid; the first phone and careers page fill it
    for key, first, size in (("long", n, m),):
        r = got[key]
        assert (r.posting_id, r.copies, r.public_phone, r.careers_page, r.salary_min, r.first_seq, r.sources) == (str(first + 3), size, "p7", "careers", 10.0, first, ["a"])
    unpaid = df.withColumn("salary_min", F.lit(None).cast("double"))
    plan = dedupe.merge_duplicates(unpaid)
    assert "collect_list" not in plan._jdf.queryExecution().optimizedPlan().toString()
    got = {r.fingerprint: r for r in plan.collect()}
    for key, first, size in (("hot", 0, n), ("long", n, m)):
        r = got[key]
        assert (r.posting_id, r.copies, r.public_phone, r.careers_page, r.posted_at) == (str(first + size - 1), size, f"p{size - 993}", "careers", dedupe_date(spark))


def dedupe_date(spark):
    return spark.range(1).select(F.timestamp_seconds(F.lit(1_700_000_000))).first()[0]
