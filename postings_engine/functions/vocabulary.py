"""Matching a vocabulary of any size: an index of rare keys finds candidates, the texts decide.

A term is looked up by the rarest of its keys, counted over the postings. Keys are 64-bit hashes; what
two strings of one hash add is removed by the look at the text. A key that more than one in `KEYS` of all
rows hold is dealt over as many join keys as it holds such shares: there can be no more than `KEYS` of
these, whatever the size of the tables, so they are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_lookup
from ..session import written

KEYS = 10_000
#: Pieces are cut into blocks of this many characters before their short runs are listed.
BLOCK = 1_000


def _rarest(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, kind, key): of the keys of each row of wanted(term, kind, keys), the one that fewest rows
    of units(id, key) hold; no row for a term one of whose keys none holds."""
    asked = wanted.select("term", "kind", F.explode("keys").alias("key"))
    held = units.groupBy("key").agg(F.count("*").alias("rows"))
    held = held.join(asked.select("key").distinct(), "key", "left_semi")
    counted = salted_lookup(asked, held, ["key"], spread="term")
    rank = F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "key")
    return counted.groupBy("term", "kind").agg(F.min(rank).alias("r")).where("r.rows > 0").select("term", "kind", "r.key")


def _met(units: DataFrame, index: DataFrame) -> DataFrame:
    """(id, term, kind) of units(id, key) and index(term, kind, key) with equal keys."""
    held = units.groupBy("key").agg(F.count("*").alias("rows"))
    total = units.agg(F.count("*").alias("total"))
    share = F.ceil(F.col("rows") * KEYS / F.col("total")).cast("int")
    frequent = F.broadcast(held.join(F.broadcast(total)).where(F.col("rows") * KEYS > F.col("total")).select("key", share.alias("deals")))
    deals = F.coalesce("deals", F.lit(1))
    dealt = units.join(frequent, "key", "left").select("id", "key", F.pmod(F.xxhash64("id"), deals).cast("int").alias("deal"))
    copied = index.join(frequent, "key", "left").select("term", "kind", "key", F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"))
    return dealt.join(copied, ["key", "deal"]).select("id", "term", "kind")


def _by_token(df: DataFrame, text: Column, terms: DataFrame) -> DataFrame:
    """Candidates for terms that can only begin and end with whole tokens."""
    keys = lambda c: F.transform(F.array_distinct(F.regexp_extract_all(c, F.lit("([a-z0-9]+)"), F.lit(1))), lambda t: F.xxhash64(t))
    units = written(df.select(F.col("posting_id").alias("id"), F.explode(keys(text)).alias("key")))
    return _met(units, _rarest(units, terms.select("term", "kind", keys(F.col("term")).alias("keys"))))


def _runs(c: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))


def _by_piece(df: DataFrame, text: Column, terms: DataFrame) -> DataFrame:
    """Candidates for terms that may begin anywhere: the longest part of a term without a space lies
    inside one piece of the text. Short runs are listed of each different piece once, never of the texts."""
    pieces = F.filter(F.array_distinct(F.split(text, " ")), lambda p: p != "")
    units = written(df.select(F.col("posting_id").alias("id"), F.explode(pieces).alias("piece")))
    names = units.select("piece").distinct().select(F.xxhash64("piece").alias("id"), "piece")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length("piece") - 1) / BLOCK).cast("int")),
                         lambda i: F.substr("piece", i * BLOCK + 1, F.lit(BLOCK + 2)))
    cut = names.select("id", F.explode(blocks).alias("block"))
    runs = F.array_distinct(F.concat(*[_runs(F.col("block"), n) for n in (1, 2, 3)]))
    grams = cut.select("id", F.explode(F.transform(runs, lambda g: F.xxhash64(g))).alias("key"))
    longest = F.array_max(F.transform(F.split("term", " "), lambda p: F.struct(F.length(p).alias("n"), p.alias("part"))))["part"]
    parts = terms.select("term", "kind", longest.alias("part"))
    asked = parts.select("term", "kind", F.transform(F.array_distinct(_runs(F.col("part"), 3)), lambda g: F.xxhash64(g)).alias("keys"))
    grams = written(grams.join(asked.select(F.explode("keys").alias("key")).distinct(), "key", "left_semi").select("id", "key"))
    met = _met(grams, _rarest(grams, asked)).distinct()
    inside = (names.join(met, "id").join(parts, ["term", "kind"])
              .where(F.contains("piece", "part")).select("term", "kind", F.col("id").alias("key")))
    return _met(units.select("id", F.xxhash64("piece").alias("key")), inside).distinct()


def match_vocabulary(df: DataFrame, vocab: DataFrame, mode: str) -> DataFrame:
    """The form of `match_terms` for vocab(term, kind) of any size. A row that repeats counts once; null
    and blank terms match nothing."""
    title, body, term = F.col("n_title"), F.col("n_body"), F.col("term")
    text = F.concat_ws(" ", title, body)
    terms = written(vocab.select("term", "kind").where(F.trim(term) != "").distinct())
    if mode == "word":
        has_token = term.rlike("[a-z0-9]")
        found = _by_token(df, text, terms.where(has_token))
        signs = terms.where(~has_token)
        found = found if signs.isEmpty() else found.unionByName(_by_piece(df, text, signs))
        literal = F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        pattern = F.concat(F.lit("(?<![a-z0-9])"), literal, F.lit("(?![a-z0-9])"))
        in_title, n = F.regexp_like(title, pattern), F.regexp_count(body, pattern)
    else:
        found = _by_piece(df, text, terms)
        in_title = F.contains(title, term)
        n = F.floor((F.length(body) - F.length(F.replace(body, term, F.lit("")))) / F.length(term))
    checked = found.withColumnRenamed("id", "posting_id").join(df.select("posting_id", "n_title", "n_body"), "posting_id").select(
        "posting_id", "term", "kind", in_title.alias("in_title"), n.cast("long").alias("n"))
    return checked.select("posting_id", "term", "kind", "in_title", (F.col("n") > 0).alias("in_body"), "n").where("in_title OR in_body")
