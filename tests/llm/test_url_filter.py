from postings_engine.llm.queries import QUERIES, URL_RULES
from postings_engine.llm.url_filter import bloom_blocks, judge, rule_list

from .brute import LOWER


def expected(url, rules, unlisted="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[: min(ends, default=len(rest))]
    tail = rest[len(host):]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    host = host.translate(LOWER)
    best = max(((len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and host), default=None)
    return host, path, best and best[1], best[2] if best else unlisted


ODD = [None, "", "no scheme", "http://", "http://ORG/", "http://org", "https://a.org?x/", "http://a.Example.org/es/x#y", "http://example.org/es", "http://notexample.org/es/", "x://y.com/de/://z", "a://b://org/",
       "http://example.org/en/1", "http://example.org/en/12?q", "http://example.org/en/2", "http://a..org/x", "http://com/fr/", "http://x.com/FR/", "http://u@example.org:80/es/", "http://é.org/ü", "http://example.org\n/es/"]


def test_query_equals_plain_rules(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    want = sorted(((p.page_id, *expected(p.url, URL_RULES)) for p in pages), key=str)
    assert sorted(map(tuple, QUERIES["op6_url_filter"](spark, sf).collect()), key=str) == want


def test_odd_urls_repeats_and_clashing_columns(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(ODD + ODD[:6])] + [(None, ODD[4], "x", "y")]
    urls = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = sorted(map(tuple, judge(urls, rule_list(spark, URL_RULES)).collect()), key=str)
    assert got == sorted(((i, *expected(u, URL_RULES)) for i, u, _, _ in rows), key=str)
    assert judge(urls.limit(0), rule_list(spark, URL_RULES)).count() == 0


def test_repeated_and_null_entries_and_an_empty_list(spark):
    urls = spark.createDataFrame([(1, "http://a.b/c"), (2, "http://x.y/")], "page_id long, url string")
    rules = spark.createDataFrame([("b", "/", "allow"), ("b", "/", "block"), (None, "/", "block"), ("y", None, "block")], "host string, path string, verdict string")
    assert {(r.page_id, r.rule, r.verdict) for r in judge(urls, rules).collect()} == {(1, "b/", "block"), (2, None, "allow")}
    assert {r.verdict for r in judge(urls, rules.limit(0), unlisted="block").collect()} == {"block"}


def test_many_entries_and_few_false_positives(spark):
    entries = [(f"h{i}.net", f"/p{i % 7}/", "block") for i in range(3000)]
    urls = [(i, f"http://{'www.' if i % 2 else ''}h{i}.net/p{(i + i // 3000) % 7}/x") for i in range(6000)]
    got = {r.page_id: r.rule for r in judge(spark.createDataFrame(urls, "page_id long, url string"), rule_list(spark, entries)).collect()}
    assert got == {i: expected(u, [(h, p, v) for h, p, v in (entries[i: i + 1] or [("none", "/", "block")])])[2] for i, u in urls}
    from pyspark.sql import functions as F
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    blocks = bloom_blocks(keys, 3000).collect()
    ones = sum(bin(r[f"w{i}"] % 2**64).count("1") for r in blocks for i in range(8))
    assert 0 < ones <= 3000 * 6 and len(blocks) <= -(-3000 // 32)
