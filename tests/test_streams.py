"""The registry as a log, and streaming de-duplication by event time."""

import glob
import os
import random
import tempfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from postings_engine.operators.state import SEEN_SCHEMA, upsert_seen
from postings_engine.streaming.incremental import stream_first_seen
from postings_engine.streaming.registry_store import RegistryStore

LEADS = "seq long, fingerprint string, match_score int, title string, company string, original_job_url string"


def test_the_log_equals_whole_rewrites_and_stays_short(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    store, rng = RegistryStore(spark, root, buckets=4, every=3), random.Random(2)
    plain = spark.createDataFrame([], SEEN_SCHEMA)
    for batch in range(8):
        names = [rng.randrange(12) for _ in range(5)] if batch != 4 else []  # one batch is empty
        leads = spark.createDataFrame([(100 * batch + i, f"f{n}", rng.randrange(100), f"t{batch}-{i}", "c", "u") for i, n in enumerate(names)], LEADS)
        day = F.lit(f"2024-01-{10 + batch}").cast("date")
        if batch in (2, 6):  # the batch runs twice, as after a crash behind its compaction
            store.put(leads, batch, day)
        store.put(leads, batch, day)
        touched = {int(os.path.basename(p).split("=")[1]) for p in glob.glob(f"{root}/delta/version={batch}/bucket=*")}
        assert touched == set(store.buckets_of(leads))
        plain = spark.createDataFrame(upsert_seen(plain, leads, day)[0].collect(), SEEN_SCHEMA)
        assert sorted(store.before(batch + 1).collect()) == sorted(plain.collect())
        wanted = store.buckets_of(leads)[:1]
        some = plain.where(store.bucket(F.col("fingerprint")).isin(wanted)).collect()
        assert sorted(store.before(batch + 1, wanted).collect()) == sorted(some)
    assert sorted(os.listdir(f"{root}/base")) == ["version=2", "version=5"]
    assert sorted(os.listdir(f"{root}/delta")) == [f"version={v}" for v in range(3, 8)]


def first_seen(rows, horizon):
    last, out = {}, set()
    for i, key, at in sorted((r for r in rows if r[1] and r[2]), key=lambda r: (r[2], r[0])):
        if key not in last or at - last[key] >= horizon:
            last[key] = at
            out.add(i)
    return out | {i for i, key, at in rows if not key or not at}


def test_first_seen_out_of_order_with_bounded_state(spark):
    root, rng, start = tempfile.mkdtemp(prefix="spark-"), random.Random(4), datetime(2024, 1, 1)
    horizon, lateness = timedelta(days=2), timedelta(hours=6)
    rows = [(i, f"k{rng.randrange(40)}", start + timedelta(minutes=rng.randrange(60 * 24 * 40))) for i in range(3000)]
    # keys of one burst each, whose state must go
    rows += [(3000 + i, f"once{i}", start + timedelta(minutes=15 * i)) for i in range(3000)]
    rows += [(6000, "k1", rows[0][2]), (6001, "k1", rows[0][2]), (6002, None, start), (6003, "k2", None), (6004, "end", start + timedelta(days=60))]
    arrival = lambda r: (r[2] or start) + timedelta(minutes=r[0] % 300)
    rows.sort(key=arrival)
    schema = "id long, k string, at timestamp"
    for a in range(0, len(rows), 700):
        spark.createDataFrame(rows[a:a + 700], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    query = (stream_first_seen(stream, "k", "at", "id", horizon, lateness).writeStream.format("parquet").option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start())
    query.awaitTermination()
    got = {r.id for r in spark.read.schema(schema).parquet(f"{root}/out").collect()}
    assert got == first_seen(rows, horizon) - {6004}  # the newest row waits
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # 4,041 keys in all; within horizon and lateness of a moment there are 40 and some 220, and a file spans a few days
    assert max(held) < 1200 and held[-1] < 20


def test_many_keys_share_the_calls_of_few_buckets(spark):
    root, start = tempfile.mkdtemp(prefix="spark-"), datetime(2024, 1, 1)
    horizon, lateness = timedelta(days=2), timedelta(hours=6)
    rows = [(i, f"k{i % 900}", start + timedelta(minutes=i)) for i in range(5400)]
    schema = "id long, k string, at timestamp"
    for a in range(0, len(rows), 2700):
        spark.createDataFrame(rows[a:a + 2700], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    query = (stream_first_seen(stream, "k", "at", "id", horizon, lateness, buckets=8).writeStream.format("parquet").option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start())
    query.awaitTermination()
    final = rows[-1][2] - lateness
    got = {r.id for r in spark.read.schema(schema).parquet(f"{root}/out").collect()}
    assert got == {i for i in first_seen(rows, horizon) if rows[i][2] <= final}
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) == 8
