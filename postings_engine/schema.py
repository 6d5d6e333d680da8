"""The postings schema every feed maps to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSTINGS_DDL = """
posting_id string, seq bigint, source string, source_id string, title string, company string, url string,
description string, location_raw string, apply_url string, posted_at timestamp, employment_type_raw string,
salary_raw string, salary_min double, salary_max double, salary_currency string, company_website string,
company_logo string, tags array<string>, is_remote boolean, truncated_description boolean, applicants string,
direct_employer boolean, ats string, board_token string, company_linkedin string, linkedin_job_id string,
discovered_platform string, aggregated_by string, available_from string
"""
_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
          "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}
POSTINGS = T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in
                         (part.split() for part in POSTINGS_DDL.replace("\n", " ").split(",") if part.strip())])


#: A feed's rows are numbered below 2**58, its items within a payload or page below 2**20.
ROW_BITS, ITEM_BITS = 58, 20


def place_of(owner: Column, item: Column, bits: int = ITEM_BITS, owner_bits: int = ROW_BITS - ITEM_BITS) -> Column:
    """owner and item as one number that keeps their order. Numbers that do not fit raise an error:
    two rows must never share a place."""
    bad = (owner < 0) | (owner >= 1 << owner_bits) | (item < 0) | (item >= 1 << bits)
    return F.when(bad, F.raise_error(F.lit("a row number is too large to keep its place")).cast("long")).otherwise(owner * (1 << bits) + item)


def to_postings(df: DataFrame) -> DataFrame:
    """Project to the schema: missing columns are added, text is never null."""
    have = set(df.columns)
    out = []
    for field in POSTINGS.fields:
        value = F.col(field.name) if field.name in have else F.lit(None)
        value = value.cast(field.dataType)
        if isinstance(field.dataType, T.StringType) and field.name != "posting_id":
            value = F.coalesce(value, F.lit(""))
        elif isinstance(field.dataType, T.ArrayType):
            value = F.coalesce(value, F.array().cast("array<string>"))
        out.append(value.alias(field.name))
    return df.select(*out)
