"""URL filter: a blocked Bloom filter of listed URLs in front of an exact join.

A listed entry is a host and a path prefix. A URL can be fitted by an entry of its own host or of a
domain above it, with a path that begins its own; so its keys are all host suffixes at dots, each
with the path prefixes of the lengths that occur in the list. A key is looked up in one block of the
Bloom filter; possible hits are joined exactly with the list, which removes the false positives, and
the longest entry that fits gives the verdict. What no entry fits is judged by the method: a URL
that is not on the list is allowed (`unlisted`).

The filter is a table of blocks and the list a table; Spark broadcasts either only if it is small.
Equal URLs are judged once.

Defined cases. The host stands between the first `://` and the next `/`, `?`, `#` or the end, A-Z
lower-cased; the path goes on up to `?`, `#` or the end. A null URL or one without `://` has an empty
host and path and is unlisted. Repeated entries count once; of entries with equal host and path, a
blocking one wins. Null entries are left out. Columns of pages other than the URL may have any name:
the result has only those that are asked for, and the new ones."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a block, and how many of them a key sets.
WORDS, PROBES = 8, 6
KEYS_PER_BLOCK = 32
SEED = 7


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_list(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows as the list of the filter."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _key(host: Column, path: Column) -> Column:
    return F.xxhash64(F.concat(host, F.lit("\n"), path))


def _bits(key: Column) -> list[Column]:
    """The places in a block that a key sets."""
    second = F.xxhash64(key, F.lit(SEED))
    return [F.pmod(F.shiftrightunsigned(second, 9 * i), F.lit(64 * WORDS)).cast("int") for i in range(PROBES)]


def bloom_blocks(listed: DataFrame, n_keys: int) -> DataFrame:
    """(block, w0..w7): the blocks of the filter that hold any of listed(key)."""
    blocks = max(1, -(-n_keys // KEYS_PER_BLOCK))
    bits = listed.select(F.pmod("key", F.lit(blocks)).alias("block"), F.explode(F.array(*_bits(F.col("key")))).alias("bit"))
    one = F.expr("shiftleft(1L, bit % 64)")
    return bits.groupBy("block").agg(*(F.bit_or(F.when(F.floor(F.col("bit") / 64) == i, one).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(WORDS)))


def judge(urls: DataFrame, rules: DataFrame, passed: tuple[str, ...] = ("page_id",), url: str = "url", unlisted: str = "allow") -> DataFrame:
    """urls(url, *passed) and rules(host, path, verdict) -> (*passed, host, path, rule, verdict), a row
    for each row. rule is the fitting entry's host and path together, or null."""
    listed = rules.where("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    listed = listed.withColumn("key", _key(F.col("host"), F.col("path")))
    n_keys = listed.count()
    lengths = sorted(r[0] for r in listed.select(F.length("path")).distinct().collect())  # at most as many as a path has characters
    blocks = max(1, -(-n_keys // KEYS_PER_BLOCK))

    rows = urls.select(*(F.col(p) for p in passed), F.col(url).alias("url"))
    named = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    places = named.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")]
    keys = (places.withColumn("domain", F.explode(domains)).withColumn("prefix", F.explode(F.array_compact(F.array(*fits))))
            .withColumn("key", _key(F.col("domain"), F.col("prefix"))).withColumn("block", F.pmod("key", F.lit(blocks))))
    # possible hits: every bit of the key is set in its block
    words = F.array(*(f"w{i}" for i in range(WORDS)))
    held = [F.call_function("shiftright", F.get(words, (bit / 64).cast("int")), bit % 64).bitwiseAND(F.lit(1)) == 1 for bit in _bits(F.col("key"))]
    possible = keys.join(bloom_blocks(listed.select("key"), n_keys), "block").where(reduce(and_, held))
    exact = possible.join(listed.select("key", F.col("host").alias("domain"), F.col("path").alias("prefix"), "verdict"), ["key", "domain", "prefix"])
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length(F.concat("domain", "prefix")).alias("size"), F.concat("domain", "prefix").alias("rule"), "verdict")).alias("best"))
    return named.join(best, ["host", "path"], "left").select(*passed, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(unlisted)).alias("verdict"))
