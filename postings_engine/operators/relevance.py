"""Is this posting the kind of work being searched for? Seven ordered gates, first
objection decides; verdicts are columns, nothing is dropped here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (first_match_text, has_any, has_any_word, has_word, no, settled, substring_count, terms,
                              word_count, words_in)
from ..profile import SearchProfile
from ..registry import rule, rules

_STR_ARRAY = "array<string>"


def _evidence(df: DataFrame, prof: SearchProfile) -> DataFrame:
    """The facts several gates read, computed once per row."""
    title, hay, tags = F.col("n_title"), F.col("hay"), F.col("n_tags")
    two = prof.secondary != prof.primary
    in_body = lambda term: has_word(hay, term) | tags.contains(term)
    return df.select(
        "*",
        has_word(title, prof.primary).alias("core_title"), in_body(prof.primary).alias("core_body"),
        (has_word(title, prof.secondary) if two else no()).alias("second_title"),
        (in_body(prof.secondary) if two else no()).alias("second_body"),
        has_any(title, prof.secondary_terms).alias("adjacent_title"),
        has_any(hay, prof.secondary_terms).alias("adjacent_body"),
        (substring_count(hay, prof.primary) + (word_count(hay, prof.secondary) if two else F.lit(0)))
        .alias("core_mentions"),
    )


EVIDENCE = ("core_title", "core_body", "second_title", "second_body", "adjacent_title",
            "adjacent_body", "core_mentions")


def _names_the_work(c):
    return c("core_title") | c("second_title") | c("adjacent_title")


@rule("relevance_gate", 10)
def excluded_title(c, prof):
    bad = F.get(words_in(c("n_title"), prof.hard_title_exclusions), F.lit(0))
    return F.concat(F.lit("Title is out of scope ("), bad, F.lit(")"))


@rule("relevance_gate", 20)
def any_signal(c, prof):
    seen = c("core_body") | c("second_body") | c("adjacent_title")
    return F.when(~seen, f"No {'/'.join(prof.core_terms)} or related signal")


@rule("relevance_gate", 30)
def hands_on_title(c, prof):
    if not prof.hands_on_title_tokens:
        return F.lit(None).cast("string")
    fine = c("core_title") | c("second_title") | has_any_word(c("n_title"), prof.hands_on_title_tokens)
    return F.when(~fine, "Title is not a hands-on role in this trade")


@rule("relevance_gate", 40)
def other_discipline(c, prof):
    other = first_match_text(c("n_title"), prof.title_exclusion_patterns)
    return F.when(~_names_the_work(c) & other.isNotNull(),
                  F.concat(F.lit("Title is a different discipline ("), other, F.lit(")")))


@rule("relevance_gate", 50)
def more_than_boilerplate(c, prof):
    thin = ~_names_the_work(c) & (c("core_mentions") < prof.min_body_core_mentions)
    return F.when(thin, F.concat(F.lit("Core terms mentioned only "), c("core_mentions").cast("string"),
                                 F.lit("x and not in the title")))


@rule("relevance_gate", 60)
def strong_enough(c, prof):
    strong = c("core_body") | c("second_body") | (c("adjacent_title") & c("adjacent_body"))
    return F.when(~strong, "Signal too weak")


@rule("relevance_gate", 70)
def competing_discipline(c, prof):
    if not prof.competing_stacks:
        return F.lit(None).cast("string")
    title = c("n_title")
    named = F.get(F.filter(terms(prof.competing_stacks), lambda t: title.contains(t)), F.lit(0))
    return F.when(~c("core_title"), F.concat(F.lit("Targets a different discipline ("), named, F.lit(")")))


def _verdict(passed, reason, details, concerns) -> Column:
    return F.struct(
        passed.alias("passed"), F.coalesce(reason, F.lit("")).alias("reason"),
        F.when(passed, "").otherwise("irrelevant").alias("category"),
        F.when(passed, details).otherwise(F.array().cast(_STR_ARRAY)).alias("details"),
        F.when(passed, concerns).otherwise(F.array().cast(_STR_ARRAY)).alias("concerns"))


def relevance(df: DataFrame, prof: SearchProfile, out: str = "relevance") -> DataFrame:
    """Needs add_match_text columns. Adds a verdict struct."""
    empty = F.array().cast(_STR_ARRAY)
    if not prof.core_terms:
        return df.withColumn(out, _verdict(F.lit(True), F.lit(""), empty, empty))
    original = df.columns
    df = _evidence(df, prof)
    df = df.withColumn("_objection", F.coalesce(*[r.fn(F.col, prof) for r in rules("relevance_gate")]))
    label, second = prof.primary.title(), prof.secondary.title()
    weak = ~(F.col("core_body") | F.col("second_body"))
    details = F.array_compact(F.array(
        F.when(F.col("core_title"), f"{label} named in the title")
        .when(F.col("core_body"), f"{label} named in the description"),
        F.when(weak, f"{prof.label} role matching the background"),
        F.when(F.col("second_title") | F.col("second_body"), f"{second} named in the posting")))
    notes = F.array_compact(F.array(F.when(weak, f"No {label} mention — adjacent role")))
    if prof.competing_stacks:
        others = F.filter(terms(prof.competing_stacks), lambda t: F.col("hay").contains(t))
        notes = F.concat(notes, F.when(F.col("core_title"), F.array().cast(_STR_ARRAY)).otherwise(
            F.transform(others, lambda t: F.concat(F.lit("Mentions "), t))))
    df = settled(df, **{out: _verdict(F.col("_objection").isNull(), F.col("_objection"), details, notes)})
    return df.select(*original, out)
