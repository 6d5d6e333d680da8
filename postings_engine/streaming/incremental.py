"""Runs over arriving files: incremental screening with an idempotent state step, and
streaming de-duplication within the freshness horizon."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import add_keys
from ..operators.state import upsert_seen
from ..plans.screen import screen
from ..profile import SearchProfile
from ..schema import POSTINGS
from ..session import remove
from .registry_store import RegistryStore


def read_landed(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(POSTINGS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def screen_batch(prof: SearchProfile, run_ts: Column, store: RegistryStore, leads_path: str, run_date: Column) -> Callable:
    """A foreachBatch step: screen, label against the registry, write the leads, add them to the
    registry. A batch is screened once: the registry is fed from the leads as written, and so is the
    label. Outputs are named by the batch id and overwritten whole, so a replayed batch changes nothing."""
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stage = f"{store.root}/screened/batch={batch_id}"
        screen(batch, prof, run_ts).where("route in ('qualified', 'prospect')").write.mode("overwrite").parquet(stage)
        kept = spark.read.parquet(stage)
        seen = store.before(batch_id, store.buckets_of(kept))
        upsert_seen(seen, kept, run_date)[1].write.mode("overwrite").parquet(f"{leads_path}/batch={batch_id}")
        store.put(kept, batch_id, run_date)
        remove(spark, stage)
    return step


def stream_screen(spark: SparkSession, path: str, prof: SearchProfile, state: str, leads_path: str, checkpoint: str,
                  run_ts: Column | None = None, max_files: int | None = None, buckets: int = 64):
    """Starts the query over everything landed so far; run it again for what arrives later."""
    run_ts = F.current_timestamp() if run_ts is None else run_ts
    step = screen_batch(prof, run_ts, RegistryStore(spark, state, buckets), leads_path, F.to_date(run_ts))
    return (read_landed(spark, path, max_files).writeStream.foreachBatch(step)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_dedupe(stream: DataFrame, days: int) -> DataFrame:
    """First posting per fingerprint to arrive within the horizon; rows later than it are dropped and
    the state they would need is let go."""
    keyed = add_keys(stream) if "fingerprint" not in stream.columns else stream
    return keyed.withWatermark("posted_at", f"{days} days").dropDuplicatesWithinWatermark(["fingerprint"])


_STATE = "held binary"


def stream_first_seen(stream: DataFrame, key: str, at: str, order: str, horizon: timedelta, lateness: timedelta, buckets: int = 256) -> DataFrame:
    """The rows of a stream that are not repeats, by their own time and not by when they arrive: of a
    key's rows, in order of `at` and then `order`, one stays and those less than `horizon` after it go.
    A row waits until no earlier one can arrive, `lateness` after the newest; what comes later than that is dropped.

    Keys (of a plain type) are dealt to `buckets` by hash and a bucket is judged at once, so a batch costs a call for
    each bucket and not for each key. A bucket's state is the time of the last kept row of each of its keys, let go
    when the horizon has passed, and its rows that wait, so it is bounded by what the bucket has within horizon and
    lateness. Rows without a key or a time repeat nothing and stay."""
    whole = F.col(key).isNotNull() & F.col(at).isNotNull()
    span, columns = int(horizon / timedelta(microseconds=1)), stream.columns

    def step(_, frames, state):
        kept, waiting = pickle.loads(state.get[0]) if state.exists else ({}, None)
        rows = pd.concat([*([] if waiting is None else [waiting]), *(f[columns] for f in frames)], ignore_index=True)
        final = state.getCurrentWatermarkMs() * 1000
        times = rows[at].astype("datetime64[us]").astype("int64")
        done = rows.assign(_at=times)[times <= final].sort_values(["_at", order], kind="stable")
        stays = []
        for k, t in zip(done[key].tolist(), done["_at"].tolist()):
            last = kept.get(k)
            stays.append(last is None or t - last >= span)
            if stays[-1]:
                kept[k] = t
        left = rows[times > final]
        kept = {k: t for k, t in kept.items() if t + span > final}
        ends = [*([int(times[times > final].min())] if len(left) else []), *([min(kept.values()) + span] if kept else [])]
        if not ends:
            state.remove()
        else:
            state.update((pickle.dumps((kept, left if len(left) else None)),))
            state.setTimeoutTimestamp(max(-(-min(ends) // 1000), final // 1000 + 1))
        yield done[pd.Series(stays, index=done.index, dtype=bool)].drop(columns="_at")

    timed = stream.where(whole).withWatermark(at, f"{int(lateness / timedelta(milliseconds=1))} milliseconds")
    dealt = timed.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    kept = dealt.groupBy("_bucket").applyInPandasWithState(step, stream.schema, _STATE, "append", "EventTimeTimeout")
    return kept.unionByName(stream.where(~whole))
