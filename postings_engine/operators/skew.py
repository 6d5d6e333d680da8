"""Joins and running totals that keep a key holding a large share of the rows spread out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def salted_lookup(big: DataFrame, small: DataFrame, keys: list[str], spread: str = "seq",
                  how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join `big` to a table with one row per key. Rows of one hot key are dealt over
    `salts` join keys, so no task has to take the whole key; the one-row-per-key side is
    what gets copied, and only where its key occurs more than a handful of times would
    that matter, since it is as small as the distinct keys."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def spread_blank(key: Column, by: str, salts: int = 4096) -> Column:
    """The key for a left join in which many rows have none: a null or blank key becomes one of many
    that match nothing, so that such rows are dealt over all tasks."""
    stand_in = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(by), F.lit(salts)).cast("string"))
    return F.coalesce(F.nullif(key, F.lit("")), stand_in)


def running_total(df: DataFrame, value: Column, order: str, out: str, chunk: int = 1 << 16, kind: str = "double") -> DataFrame:
    """Sum of `value` over all rows strictly before this one in `order` (a dense-ish
    integer). A decimal `kind` makes it exact, whatever order parts are added in. Chunks are summed in parallel, then blocks of `chunk` chunks; only block totals (a
    row for 2^32 numbers) are accumulated in one place, then each level runs its own short window."""
    df = df.select("*", F.floor(F.col(order) / chunk).alias("_chunk"), value.cast(kind).alias("_v"))
    zero = F.lit(0).cast(kind)
    totals = df.groupBy("_chunk").agg(F.sum("_v").alias("_t"))
    totals = totals.withColumn("_block", F.floor(F.col("_chunk") / chunk))
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.groupBy("_block").agg(F.sum("_t").alias("_b")).select(
        "_block", F.coalesce(F.sum("_b").over(past(Window.orderBy("_block"))), zero).alias("_before"))
    within = F.coalesce(F.sum("_t").over(past(Window.partitionBy("_block").orderBy("_chunk"))), zero)
    base = totals.withColumn("_w", within).join(blocks, "_block").select("_chunk", (F.col("_before") + F.col("_w")).alias("_base"))
    inside = Window.partitionBy("_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_in", F.coalesce(F.sum("_v").over(inside), zero))
    return df.join(base, "_chunk").withColumn(out, (F.col("_base") + F.col("_in")).cast(kind)).drop("_chunk", "_v", "_in", "_base")
