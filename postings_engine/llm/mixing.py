"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source's mean repetition rate is its target share of the output over its size. Each document's
number of copies is drawn from the Poisson distribution with that mean by inversion: a number in
[0, 1) from a hash of seed and id is compared with the distribution's cumulative probabilities. A
mean above MOST_MEAN is drawn as the sum of equal smaller parts with draws of their own, which has
the same distribution and keeps every table of probabilities short. The copies are then dealt out
in the order of another hash, which shuffles them globally.

Defined cases. A null or empty text counts as one byte. Rows with a null source are a source of
their own. Rows with equal doc_id draw equal numbers; a null doc_id draws like the word null. A
source without a weight, or with one of 0 or less, leaves no row. An empty table gives no rows.
Extra columns are carried, but for those named like the new ones (copy, n_copies, rate,
shuffle_key), which are replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh

MOST_MEAN = 16.0
#: Terms of a table of cumulative probabilities; the tail beyond is below 1e-20 at MOST_MEAN.
TERMS = 72


def draw(*parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a digest of the parts."""
    digest = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def size_of(text: Column) -> Column:
    return F.greatest(F.coalesce(F.octet_length(text), F.lit(0)), F.lit(1)).cast("long")


def source_rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5) -> DataFrame:
    """(source, rate): the mean repetition rates for which the output has the input's size and each
    source its share by weights(source, weight), or, without weights, by size ** temperature."""
    sizes = docs.groupBy("source").agg(F.sum(size_of(F.col("text"))).alias("size"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(temperature)))
    else:
        own = weights.select(F.col("source").alias("own"), F.col("weight").cast("double")).groupBy("own").agg(F.sum("weight").alias("weight"))
        weighted = sizes.join(own, F.col("source").eqNullSafe(F.col("own"))).drop("own").where("weight > 0")
    # decimals add up to the same in any order
    whole = weighted.agg(F.sum("size").alias("all_size"), F.sum(F.col("weight").cast("decimal(38,18)")).cast("double").alias("all_weight"))  # one row
    return weighted.crossJoin(F.broadcast(whole)).select("source", (F.col("weight") / F.col("all_weight") * F.col("all_size") / F.col("size")).alias("rate"))


def cumulative(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of the Poisson distribution, TERMS of them."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("sums"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, lambda at, k: F.struct(
        (at["p"] * mean / k).alias("p"), F.concat(at["sums"], F.array(F.element_at(at["sums"], -1) + at["p"] * mean / k)).alias("sums")), lambda at: at["sums"])


def poisson_copies(docs: DataFrame, rates: DataFrame, seed: int = 0) -> DataFrame:
    """docs(doc_id, source, ...) and rates(source, rate), one row for each source, -> the columns of
    docs with rate, n_copies, copy (from 1) and shuffle_key, a row for each copy. Not yet in order."""
    kept = [c for c in docs.columns if c not in ("copy", "n_copies", "rate", "shuffle_key")]
    parts = F.greatest(F.ceil(F.col("rate") / MOST_MEAN), F.lit(1)).cast("int")
    tables = rates.withColumn("parts", parts).withColumn("sums", cumulative(F.col("rate") / F.col("parts")))
    # both sides are one struct each, so that no column of docs can clash with a name used here
    row, table = fresh("row", docs.columns), fresh("table", docs.columns)
    rows = docs.select(F.struct(*kept).alias(row)).join(tables.select(F.struct("source", "rate", "parts", "sums").alias(table)), F.col(f"{row}.source").eqNullSafe(F.col(f"{table}.source")))
    # the number of cumulative probabilities that are not above the draw
    doc_id, sums = F.col(f"{row}.doc_id"), F.col(f"{table}.sums")
    inverted = F.transform(F.sequence(F.lit(1), F.col(f"{table}.parts")), lambda j: F.size(F.filter(sums, lambda c: c <= draw(F.lit(seed), doc_id, j))))
    counted = rows.select(row, F.col(f"{table}.rate").alias("rate"), F.aggregate(inverted, F.lit(0), lambda a, x: a + x).alias("n_copies")).where("n_copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    key = F.md5(F.concat_ws("|", F.lit(f"order {seed}"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.col("copy").cast("string")).cast("binary"))
    return copies.select(*(F.col(f"{row}.`{c}`").alias(c) for c in kept), "rate", "n_copies", "copy", key.alias("shuffle_key"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, seed: int = 0) -> DataFrame:
    """Replicates docs to the target weights and shuffles globally: partitions hold ranges of
    shuffle_key, rows stand in its order."""
    # a row for each source, written so that its size is known when the join with docs is planned
    rates = Scratch(docs.sparkSession, "mixing").save(source_rates(docs, weights, temperature), "rates")
    copies = poisson_copies(docs, rates, seed)
    return copies.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key")
