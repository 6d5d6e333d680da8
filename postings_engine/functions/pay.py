"""Pay: parsing, merging published fields, conversion to annual USD, display text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .text import once

PAY_TYPE = ("salary_min double, salary_max double, day_rate_min double, day_rate_max double, "
            "currency string")


def detect_currency(c: Column) -> Column:
    upper = F.upper(c)
    out = F.lit("")
    for symbol, code in reversed(fv.CURRENCY_SYMBOLS):
        out = F.when(c.contains(symbol), code).otherwise(out)
    for code in reversed(fv.CURRENCY_CODES):
        out = F.when(upper.contains(code) & upper.rlike(rf"\b{code}\b"), code).otherwise(out)
    return out


def amounts(c: Column) -> Column:
    """Every amount with its multiplier applied; a bare 19xx/20xx is a year, not money."""
    pattern = F.lit("(?i)" + fv.AMOUNT)
    symbol, number, suffix = (F.regexp_extract_all(c, pattern, F.lit(g)) for g in (1, 2, 3))
    triples = F.arrays_zip(symbol.alias("s"), number.alias("n"), suffix.alias("x"))
    kept = F.filter(triples, lambda t: ~(F.regexp_replace(t["n"], ",", "").rlike(r"^(19|20)\d{2}$")
                                         & (t["s"] == "")))
    factor = lambda t: (F.when(F.lower(t["x"]) == "k", 1e3).when(F.lower(t["x"]) == "m", 1e6).otherwise(1.0))
    return F.transform(kept, lambda t: F.regexp_replace(t["n"], r"[,\s]", "").cast("double") * factor(t))


def parsed_pay(c: Column) -> Column:
    """Struct of annual and daily bounds read from free text."""
    none = F.lit(None).cast("double")
    low = F.lower(c)

    def pay(currency, smin, smax, dmin, dmax):
        return F.struct(smin.alias("salary_min"), smax.alias("salary_max"),
                        dmin.alias("day_rate_min"), dmax.alias("day_rate_max"), currency.alias("currency"))

    def read(found):
        values, currency = found["values"], found["currency"]
        within = lambda lo, hi: F.filter(values, lambda v: v.between(lo, hi))
        hourly, daily, annual = within(8, 500), within(80, 4000), within(12000, 1000000)
        per_day = lambda v: F.bround(v * 8, 0)
        return (F.when(found["hourly"] & (F.size(hourly) > 0),
                       pay(currency, none, none, per_day(F.array_min(hourly)), per_day(F.array_max(hourly))))
                .when(found["daily"] & (F.size(daily) > 0), pay(currency, none, none, F.array_min(daily), F.array_max(daily)))
                .otherwise(pay(currency, F.array_min(annual), F.array_max(annual), none, none)))

    found = F.struct(amounts(c).alias("values"), detect_currency(c).alias("currency"),
                     low.rlike(fv.HOURLY_WORDS).alias("hourly"), low.rlike(fv.DAY_RATE_WORDS).alias("daily"))
    return F.when(F.coalesce(c, F.lit("")) == "", F.from_json(F.lit('{"currency":""}'), PAY_TYPE)).otherwise(once(found, read))


def parse_pay(df: DataFrame, col: str, out: str = "pay") -> DataFrame:
    return df.withColumn(out, parsed_pay(F.col(col)))


def pay_lines(body: Column) -> Column:
    """The pay-bearing lines of a body, joined."""
    lines = F.filter(F.split(body, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"), lambda line: F.lower(line).rlike(
        "|".join(t.replace("$", r"\$") for t in fv.PAY_LINE_TOKENS)))
    return F.array_join(lines, " ")


def _truthy(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def resolve_pay(df: DataFrame) -> DataFrame:
    """Structured fields beat parsed text; the body is read only when nothing is published.
    Replaces salary_min/max/currency and adds day_rate_min/max."""
    posted_min, posted_max = _truthy(F.col("salary_min")), _truthy(F.col("salary_max"))
    df = df.withColumn("_field_pay", parsed_pay(F.col("salary_raw")))
    fp = F.col("_field_pay")
    silent = F.coalesce(posted_min, posted_max, fp["salary_min"], fp["salary_max"],
                        fp["day_rate_min"], fp["day_rate_max"]).isNull()
    # the text handed to the parser is empty unless nothing was published
    df = df.withColumn("_pay", F.when(silent, parsed_pay(
        F.when(silent, F.coalesce(pay_lines(F.col("description")), F.lit(""))))).otherwise(fp))
    p = F.col("_pay")
    smin, smax = F.coalesce(posted_min, p["salary_min"]), F.coalesce(posted_max, p["salary_max"])
    daily = (smin < fv.DAY_RATE_CEILING) & p["day_rate_min"].isNull()
    none = F.lit(None).cast("double")
    df = df.select(
        "*",
        F.when(daily, none).otherwise(smin).alias("_smin"), F.when(daily, none).otherwise(smax).alias("_smax"),
        F.when(daily, smin).otherwise(p["day_rate_min"]).alias("_dmin"),
        F.when(daily, smax).otherwise(p["day_rate_max"]).alias("_dmax"),
        F.coalesce(F.nullif(F.col("salary_currency"), F.lit("")), p["currency"], F.lit("")).alias("_cur"),
    )

    def ordered(lo, hi):
        swap = F.col(lo) > F.col(hi)
        return (F.when(swap, F.col(hi)).otherwise(F.col(lo)), F.when(swap, F.col(lo)).otherwise(F.col(hi)))

    (smin, smax), (dmin, dmax) = ordered("_smin", "_smax"), ordered("_dmin", "_dmax")
    keep = [c for c in df.columns if c not in ("salary_min", "salary_max", "salary_currency") and not c.startswith("_")]
    return df.select(*keep, smin.alias("salary_min"), smax.alias("salary_max"),
                     F.col("_cur").alias("salary_currency"),
                     dmin.alias("day_rate_min"), dmax.alias("day_rate_max"))


def usd(amount: Column, currency: Column, rates: dict | None = None) -> Column:
    """Static-table conversion as a map literal: unknown currency -> null, blank -> USD."""
    rates = rates or fv.CURRENCY_TO_USD
    table = F.create_map(*[F.lit(x) for kv in rates.items() for x in (kv[0], float(kv[1]))])
    code = F.upper(F.when(F.coalesce(currency, F.lit("")) == "", "USD").otherwise(currency))
    return _truthy(amount) * F.try_element_at(table, code)


def to_usd(df: DataFrame, amount: str, currency: str, rates: DataFrame | None = None, out: str = "usd") -> DataFrame:
    """With a rates table this is a lookup join; Spark broadcasts it when it is small."""
    if rates is None:
        return df.withColumn(out, usd(F.col(amount), F.col(currency)))
    code = F.upper(F.when(F.coalesce(F.col(currency), F.lit("")) == "", "USD").otherwise(F.col(currency)))
    looked_up = rates.select(F.col("currency").alias("_code"), F.col("usd").alias("_rate"))
    joined = df.withColumn("_code", code).join(looked_up, "_code", "left")
    return joined.withColumn(out, _truthy(F.col(amount)) * F.col("_rate")).drop("_code", "_rate")


def annual_usd(df: DataFrame) -> DataFrame:
    """Adds annual_usd and pay_basis."""
    top = lambda kind: F.coalesce(_truthy(F.col(f"{kind}_max")), _truthy(F.col(f"{kind}_min")))
    salary = usd(top("salary"), F.col("salary_currency"))
    daily = usd(top("day_rate"), F.col("salary_currency")) * fv.CONTRACT_DAYS_PER_YEAR
    return df.select(
        "*", F.coalesce(salary, daily).alias("annual_usd"),
        F.when(salary.isNotNull(), "salary").when(daily.isNotNull(), "day rate").otherwise("none").alias("pay_basis"))


def amount(c: Column) -> Column:
    """A published amount as a number; separators and symbols dropped, non-positive -> null."""
    number = F.trim(F.translate(c.cast("string"), ",$£€", "")).try_cast("double")
    return F.when(number > 0, number)


def to_amount(df: DataFrame, col: str, out: str = "amount") -> DataFrame:
    return df.withColumn(out, amount(F.col(col)))


def pay_summary_text() -> Column:
    code = F.upper(F.coalesce(F.col("salary_currency"), F.lit("")))
    symbol = (F.when(code == "GBP", "£").when(code == "USD", "$").when(code == "EUR", "€")
              .otherwise(F.concat(F.coalesce(F.col("salary_currency"), F.lit("")), F.lit(" "))))
    money = lambda v: F.concat(symbol, F.format_number(F.bround(v, 0), 0))

    def band(lo, hi, suffix=""):
        lo, hi = _truthy(F.col(lo)), _truthy(F.col(hi))
        return F.when(lo.isNotNull() & hi.isNotNull() & (lo != hi),
                      F.concat(money(lo), F.lit(" - "), money(hi), F.lit(suffix))) \
            .otherwise(F.concat(money(F.coalesce(lo, hi)), F.lit(suffix)))

    return F.coalesce(band("day_rate_min", "day_rate_max", "/day"),
                      band("salary_min", "salary_max"), F.lit("Not published"))


def pay_summary(df: DataFrame, out: str = "pay_summary") -> DataFrame:
    return df.withColumn(out, pay_summary_text())
