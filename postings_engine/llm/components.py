"""Connected components of a table of links, as alternating star contractions.

Each round replaces the links by links to a smaller neighbour and keeps what is connected; the
number of rounds grows with the logarithm of the longest path. A node with very many links is only
ever aggregated by a combinable minimum or joined, where Spark splits a skewed partition; no
neighbour list is built. Each round is written to the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """links(a, b): long pairs, any order, repeats and loops allowed; nulls link nothing. Returns
    (node, component): every node that has a link to another one, and the smallest node it reaches."""
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    now = scratch.save(pairs.distinct(), name)
    while not _stars(now):
        large = scratch.save(_large_star(now), name)
        scratch.drop(now)
        then = scratch.save(_small_star(large), name)
        scratch.drop(large)
        now = then
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _large_star(links: DataFrame) -> DataFrame:
    """What hangs on b moves to the smallest node next to b."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("b"), F.least("u", "m").alias("m"))
    return links.join(least, "b").select("a", F.col("m").alias("b")).distinct()


def _small_star(large: DataFrame) -> DataFrame:
    """The smaller neighbours of a, and a, move to the smallest of them."""
    lowest = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(lowest, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()


def _stars(links: DataFrame) -> bool:
    """Whether each node has one smaller neighbour and no node is both centre and leaf."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    roles = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return not roles.where("leaf + centre > 1 AND leaf > 0").limit(1).count()
