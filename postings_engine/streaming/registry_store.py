"""The seen registry as a log: each batch adds its own rows, and every few batches the log is compacted.

    root/delta/version=7/bucket=12/...   the rows that batch 7 changed, whole
    root/base/version=7/bucket=12/...    every row as it stood after batch 7

A row's bucket is a hash of its fingerprint, so a batch reads the buckets of its own fingerprints and no
other. Which base and deltas hold the state before a batch follows from the batch's number, so
nothing is listed; a batch overwrites its own delta and, where it is due, its own base, and reads only older
ones, so a replayed batch changes nothing. What no replay can ask for is removed."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import SEEN_COLUMNS, SEEN_SCHEMA, upsert_seen
from ..session import remove


@dataclass(frozen=True)
class RegistryStore:
    spark: SparkSession
    root: str
    #: Grows with the registry: a bucket of some 100 MB is read for a batch that touches it.
    buckets: int = 64
    #: Deltas between two compactions.
    every: int = 8

    def bucket(self, fingerprint: Column) -> Column:
        return F.pmod(F.xxhash64(fingerprint), F.lit(self.buckets)).cast("int")

    def _path(self, kind: str, version: int) -> str:
        return f"{self.root}/{kind}/version={version}"

    def _read(self, kind: str, version: int, wanted: list[int] | None) -> DataFrame:
        rows = self.spark.read.schema(f"{SEEN_SCHEMA}, bucket int").parquet(self._path(kind, version))
        if wanted is not None:
            rows = rows.where(F.col("bucket").isin(wanted))  # prunes folders
        return rows.withColumn("version", F.lit(version))

    def _write(self, rows: DataFrame, kind: str, version: int) -> None:
        placed = rows.select(*SEEN_COLUMNS).withColumn("bucket", self.bucket(F.col("fingerprint")))
        # a bucket's rows go out together, in a few files if they are many
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._path(kind, version))

    def _state(self, base: int, last: int, wanted: list[int] | None) -> DataFrame:
        """The rows of a base and of the deltas after it, the newest of each fingerprint."""
        parts = [self._read("delta", v, wanted) for v in range(base + 1, last + 1)]
        if base >= 0:
            parts.append(self._read("base", base, wanted))
        if not parts:
            return self.spark.createDataFrame([], SEEN_SCHEMA)
        log = reduce(DataFrame.unionByName, parts)
        if len(parts) == 1:
            return log.select(*SEEN_COLUMNS)
        rest = F.struct(*(c for c in SEEN_COLUMNS if c != "fingerprint"))
        # a fingerprint has a row for each version at most, so `every` and one
        return log.groupBy("bucket", "fingerprint").agg(F.max_by(rest, "version").alias("last")).select("fingerprint", "last.*")

    def before(self, batch: int, wanted: list[int] | None = None) -> DataFrame:
        """The registry as it stood before a batch, of the wanted buckets only."""
        return self._state(batch - batch % self.every - 1, batch - 1, wanted)

    def buckets_of(self, leads: DataFrame) -> list[int]:
        """The buckets that a batch touches, of which there are at most `buckets`."""
        return sorted(r[0] for r in leads.select(self.bucket(F.col("fingerprint"))).distinct().collect())

    def put(self, leads: DataFrame, batch: int, run_date: Column) -> None:
        """Adds a batch's leads: only rows of their fingerprints are written."""
        seen = self.before(batch, self.buckets_of(leads))
        own = seen.join(leads.select("fingerprint").distinct(), "fingerprint", "left_semi")
        self._write(upsert_seen(own, leads, run_date)[0], "delta", batch)
        if (batch + 1) % self.every == 0:
            self.compact(batch)

    def compact(self, batch: int) -> None:
        """Writes the base after a batch. The base before it and the deltas since then stay for a replay
        of this batch; what is older goes."""
        every = self.every
        self._write(self._state(batch - every, batch, None), "base", batch)
        for version in range(batch - 2 * every + 1, batch - every + 1):
            if version >= 0:
                remove(self.spark, self._path("delta", version))
        if batch - 2 * every >= 0:
            remove(self.spark, self._path("base", batch - 2 * every))
