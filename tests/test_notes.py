"""Substrings noted in one pass over a text, instead of a search for each."""

import random

from pyspark.sql import functions as F

from checks.projection import PROFILE, postings
from postings_engine.functions import text
from postings_engine.functions.notes import CUT, in_notes, noter
from postings_engine.operators import arrangement, classify

SF = "/root/testdata/sf0.001"
NEEDLES = ("a", "us", "remote", "remote only", "only", "emot", "é", "€50", "no sponsor", "x y", "日本", "\n- ")


def test_notes_hold_a_needle_just_where_the_text_does():
    rng, note = random.Random(4), noter(NEEDLES)
    texts = ["", "a", "us", "é", "日本語", "no remote only", "\n- x", CUT, "ab\0us"]
    texts += ["".join(rng.choice(["a", "u", "s", "remo", "te", " only", "é", "€5", "0", "no ", "sponsor", "x y", "日", "本", "\n", "- "]) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    for t in texts:
        kept = note(t)
        assert all((n in kept) == (n in t) for n in NEEDLES), t


def test_a_step_gives_the_same_in_notes(spark):
    """Null and empty texts included; a needle that is not learnt is looked for in the text."""
    df = spark.createDataFrame([(1, "us remote only"), (2, ""), (3, None), (4, "aus trading as"), (5, "REMOTE")], "k int, hay string")
    more = iter([["only"], ["trading"]])

    def step(d):
        hay = F.col("hay")
        return d.select("*", text.has_any(hay, ["remote only", "zzz", "q", "as"]).alias("x"), text.words_in(hay, ("us", "remote")).alias("y"),
                        text.matches_any(hay, (r"\b(?:us|uk|eu|ca|de|fr|it|es)\b", r"trad(?:ing|er)")).alias("z"))
    assert in_notes(df, "hay", step).collect() == step(df).collect()
    got = {r.k: r.w for r in in_notes(df, "hay", lambda d: d.withColumn("w", text.has_any(F.col("hay"), next(more)))).collect()}
    assert got == {1: False, 2: False, 3: None, 4: True, 5: False}
    for words in (["only"], ["only"], ["only", "trading"], ["trading"]):  # with a label
        again = in_notes(df, "hay", lambda d: d.withColumn("w", text.has_any(F.col("hay"), words)), "test").collect()
        assert again == df.withColumn("w", text.has_any(F.col("hay"), words)).collect()


def test_labels_and_evidence_search_the_text_a_few_times_only(spark):
    """Each plain substring was a search of the whole text: 193 for the labels, 86 for eligibility, 28 for the arrangement."""
    df = text.add_match_text(postings(spark, SF))
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "5000")
    try:
        for name, out in (("hay", classify.classify(df, PROFILE)), ("r_hay", arrangement.eligibility(df, PROFILE)), ("hay", arrangement.arrangement(df))):
            plan = out._jdf.queryExecution().analyzed().toString()
            searches = plan.count(f" Contains({name}#") + plan.count(f"(Contains({name}#") + plan.count(f" contains({name}#") + plan.count(f"(contains({name}#")
            assert searches <= 12, (name, searches)
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
