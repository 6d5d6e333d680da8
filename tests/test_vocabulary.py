"""A vocabulary of any size, in both modes, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from postings_engine.functions import vocabulary
from postings_engine.functions.text import match_terms

SHAPE = "posting_id string, n_title string, n_body string"
WORDS = "string, ".join(("term ", "kind ")) + "string"


def plain(rows, terms, mode):
    out = set()
    for term, kind in terms:
        if not (term or "").strip(" "):
            continue
        whole = re.compile(rf"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])")
        count = (lambda t: len(whole.findall(t))) if mode == "word" else (lambda t: t.count(term))
        for key, title, body in rows:
            found = [count(t) if t and term in t else 0 for t in (title, body)]
            if any(found):
                out.add((key, term, kind, None if title is None else found[0] > 0, None if body is None else found[1] > 0, None if body is None else found[1]))
    return out


def got(df):
    rows = [tuple(r) for r in df.select("posting_id", "term", "kind", "in_title", "in_body", "n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


ROWS = [("1", "the c++ lead", "the aaaa & the net .net"), ("2", "", "x" * 2_500 + "needle" + "y" * 1_200), ("3", None, "données über"), ("4", "data  engineer", None),
        ("5", "a\nb", "data engineer, data engineer"), ("6", "", "")]
TERMS = [("the", "hot"), ("c++", "sign"), ("c", "letter"), ("&", "sign"), ("aa", "pair"), (".net", "dot"), ("net", "dot"), ("needle", "deep"), ("xneedley", "deep"), ("data engineer", "two"),
         ("data  engineer", "gap"), ("é", "accent"), ("ées", "accent"), ("über", "accent"), (" ", "blank"), ("", "blank"), (None, "null"), ("the", "hot"), ("the", "other"), (r"a\E", "quote"), ("a\nb", "feed"), (" lead", "space"), ("absent", "none")]


@pytest.mark.parametrize("mode", ["word", "substring"])
def test_odd_terms_and_texts(spark, mode):
    df, vocab = spark.createDataFrame(ROWS, SHAPE), spark.createDataFrame(TERMS, WORDS)
    assert got(match_terms(df, vocab, mode)) == plain(ROWS, TERMS, mode)
    assert not got(match_terms(df.limit(0), vocab, mode)) and not got(match_terms(df, vocab.limit(0), mode))


@pytest.mark.parametrize("mode", ["word", "substring"])
def test_hundred_thousand_terms(spark, mode):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 6)))
    stock = [word() for _ in range(60_000)]
    rows = [(str(i), "the " + rng.choice(stock), " ".join(["the"] * 3 + rng.sample(stock, 40))) for i in range(300)]
    terms = list({(w, "word") for w in stock} | {(f"the {w}", "pair") for w in stock[:50_000]} | {("the", "word"), ("he", "piece")})
    assert len(terms) > 100_000
    here = {w for _, t, b in rows for w in (t + " " + b).split()}
    if mode == "word":
        likely = [t for t in terms if set(t[0].split()) <= here]
    else:
        everything = "\n".join(t + "\n" + b for _, t, b in rows)
        likely = [t for t in terms if t[0] in everything]
    df = spark.createDataFrame(rows, SHAPE).repartition(4)
    assert got(match_terms(df, spark.createDataFrame(terms, WORDS), mode)) == plain(rows, likely, mode)


def test_a_frequent_key_is_dealt_by_its_share(spark, monkeypatch):
    monkeypatch.setattr(vocabulary, "KEYS", 100)
    units = spark.range(9_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).cast("long").alias("key"))
    index = spark.createDataFrame([("the", "hot", -1), ("rare", "cold", 4)], "term string, kind string, key long")
    met = vocabulary._met(units, index)
    assert met.count() == 3_001 and met.distinct().count() == 3_001
    parts = spark.range(9_000).select(F.pmod(F.xxhash64("id"), F.lit(34)).alias("deal")).where("id % 3 = 0").groupBy("deal").count()
    assert parts.agg(F.max("count")).first()[0] < 9_000 / 50


def test_short_runs_are_never_listed_of_whole_texts(spark):
    body = " ".join(f"w{i}" for i in range(200_000))
    df = spark.createDataFrame([("1", "", body), ("2", "", "q" * 300_000 + "z")], SHAPE)
    terms = [("w199999", "a"), ("9", "b"), ("qz", "c")]
    have = got(match_terms(df, spark.createDataFrame(terms, WORDS), "substring"))
    assert have == plain([("1", "", body), ("2", "", "q" * 300_000 + "z")], terms, "substring")
