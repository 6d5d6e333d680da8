"""Classification: one label column per question, over the normalised haystack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import first_label, has_any, has_word, in_notes, matches_any, seen_in, terms
from ..profile import SearchProfile

HAY, TITLE = "hay", "n_title"


def employment_type(df: DataFrame, out: str = "employment_type") -> DataFrame:
    declared, hay = F.col("n_employment"), F.col(HAY)
    from_body = first_label(hay, fv.EMPLOYMENT, F.when(
        hay.contains("salary") | hay.contains("benefits"), "Full Time").otherwise("Unknown"))
    return df.withColumn(out, F.when(declared != "", first_label(
        declared, fv.DECLARED_EMPLOYMENT, from_body)).otherwise(from_body))


def contract_type(df: DataFrame, out: str = "contract_type") -> DataFrame:
    kind = F.col("employment_type")
    fallback = (F.when(kind.isin("Contract", "Freelance"), "Unspecified contract")
                .when(kind.isin("Full Time", "Part Time"), "Permanent").otherwise("N/A"))
    return df.withColumn(out, first_label(F.col(HAY), fv.CONTRACT_TYPE, fallback))


def title_seniority(title: Column) -> Column:
    """Null when the title names no level."""
    return first_label(title, fv.SENIORITY, F.lit(None).cast("string"))


def seniority(df: DataFrame, out: str = "seniority") -> DataFrame:
    hay = F.col(HAY)
    years = F.when(hay.contains("experience"), F.nullif(
        F.regexp_extract(hay, fv.SENIORITY_YEARS, 1), F.lit(""))).cast("int")
    by_years = (F.when(years >= 8, "Lead").when(years >= 4, "Senior").when(years >= 2, "Mid")
                .when(years.isNotNull(), "Junior"))
    return df.withColumn(out, F.coalesce(title_seniority(F.col(TITLE)), by_years,
                                         first_label(hay, fv.SENIORITY, "Unspecified")))


def years_asked(c: Column) -> Column:
    found = F.flatten(F.array(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in fv.YEARS]))
    usable = F.filter(F.transform(found, lambda x: x.cast("int")), lambda n: n.between(1, 25))
    return F.when(c.contains("year"), F.array_max(usable))


def required_years(df: DataFrame, out: str = "required_years") -> DataFrame:
    return df.withColumn(out, years_asked(F.col(HAY)))


def _level(label: Column) -> Column:
    out = None
    for name, level in fv.SENIORITY_TO_LEVEL.items():
        out = F.when(label == name, level) if out is None else out.when(label == name, level)
    return out


def experience_level(df: DataFrame, out: str = "experience_level") -> DataFrame:
    years, hay = F.col("required_years"), F.col(HAY)
    by_years = F.when(years <= 2, "Beginner").when(years <= 4, "Medium").when(years.isNotNull(), "Senior")
    by_phrase = F.when(matches_any(hay, fv.BEGINNER_PHRASES), "Beginner").when(matches_any(hay, fv.SENIOR_PHRASES), "Senior")
    return df.withColumn(out, F.coalesce(_level(title_seniority(F.col(TITLE))), by_years, by_phrase,
                                         _level(F.col("seniority")), F.lit("Not specified")))


def industry(df: DataFrame, out: str = "industry") -> DataFrame:
    return df.withColumn(out, first_label(F.col(HAY), fv.INDUSTRY, fv.DEFAULT_INDUSTRY))


def startup(df: DataFrame) -> DataFrame:
    """Adds startup_stage and is_startup."""
    hay = F.col(HAY)
    df = df.withColumn("_signal", has_any(hay, fv.STARTUP_SIGNALS))
    df = df.withColumn("startup_stage", first_label(
        hay, fv.STARTUP_STAGE, F.when(F.col("_signal"), "Unspecified stage").otherwise("N/A")))
    return df.withColumn("is_startup", (F.col("startup_stage") != "N/A") | F.col("_signal")).drop("_signal")


def size_label(c: Column) -> Column:
    chain = None
    for pattern, label in fv.COMPANY_SIZE:
        hit = matches_any(c, (pattern,))
        if label:
            value = F.lit(label)
        else:
            n = F.regexp_extract(c, pattern, 1).cast("int")
            value = F.when(n <= 10, "1-10").when(n <= 50, "11-50").when(n <= 200, "51-200").otherwise("201+")
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain.when(c.contains("startup") | c.contains("start-up"), "Startup (small)").otherwise("Unknown")


def company_size(df: DataFrame, out: str = "company_size") -> DataFrame:
    return df.withColumn(out, size_label(F.col(HAY)))


def partnership(df: DataFrame, out: str = "is_partnership") -> DataFrame:
    hay = F.col(HAY)
    seen = seen_in(hay, fv.PARTNERSHIP_SIGNALS)
    hits = F.size(F.filter(terms(fv.PARTNERSHIP_SIGNALS), lambda t: seen.contains(t)))
    strong = has_any(hay, fv.STRONG_PARTNERSHIP_SIGNALS) & F.col("employment_type").isin("Contract", "Freelance", "Unknown")
    return df.withColumn(out, (hits >= 2) | strong)


def opportunity_type(df: DataFrame, out: str = "opportunity_type") -> DataFrame:
    kind = F.col("employment_type")
    return df.withColumn(out, F.when(F.col("is_partnership"), "Partnership / Agency")
                         .when(kind == "Freelance", "Freelance Project").when(kind == "Contract", "Contract Role")
                         .when(F.col("is_startup"), "Startup Role").otherwise("Permanent Job"))


def skill_level(term: str) -> Column:
    hay = F.col(HAY)
    form = lambda patterns: [p.replace("{t}", term) for p in patterns]
    return (F.when(has_word(F.col(TITLE), term) | has_word(F.col("n_tags"), term), "Yes")
            .when(~has_word(hay, term), "No")
            .when(matches_any(hay, form(fv.CORE_REQUIRED)), "Yes")
            .when(matches_any(hay, form(fv.CORE_PREFERRED)), "Preferred").otherwise("Mentioned"))


def core_skill_level(df: DataFrame, prof: SearchProfile) -> DataFrame:
    first, second = ((skill_level(prof.primary), skill_level(prof.secondary)) if prof.core_terms
                     else (F.lit("No"), F.lit("No")))
    return df.select("*", first.alias("core_skill_required"), second.alias("secondary_skill_required"))


def classify(df: DataFrame, prof: SearchProfile) -> DataFrame:
    """All labels, in dependency order."""
    def labels(df: DataFrame) -> DataFrame:
        for step in (employment_type, contract_type, seniority, required_years, experience_level, industry,
                     startup, partnership, opportunity_type):
            df = step(df)
        if "company_size" not in df.columns:
            df = company_size(df)
        return core_skill_level(df, prof)
    return in_notes(df, HAY, labels, "labels")
