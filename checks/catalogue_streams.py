"""Registered queries over arriving files: the incremental screen and the streaming de-duplication."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from postings_engine.session import shared_folder
from postings_engine.streaming.incremental import stream_first_seen, stream_screen
from postings_engine.streaming.registry_store import RegistryStore

from . import sql as S
from .catalogue import _ALL_SQL, PROFILE, query
from .catalogue_more import RUN_OF
from .projection import postings, read


@query("str_1_incremental_screen", f"""{_ALL_SQL}, {S.K} SELECT fingerprint, CAST(count(*) AS BIGINT) AS times_seen, max(match_score) AS best_match_score, 'Not Applied' AS application_status,
  CAST(1 AS BIGINT) AS n_new, CAST(count(*) AS BIGINT) AS n_leads FROM x JOIN kf USING (posting_id) WHERE route IN ('qualified', 'prospect') GROUP BY fingerprint""")
def _(spark, sf):
    """All postings in three arrivals: the registry after them, and how many of its leads were new."""
    root = f"{shared_folder(spark)}/str-1-{uuid.uuid4().hex}"
    posts, run_ts = postings(spark, sf), RUN_OF(spark, sf)
    for part in range(3):
        posts.where(F.col("seq") % 3 == part).write.mode("append").parquet(f"{root}/landed")
        stream_screen(spark, f"{root}/landed", PROFILE, f"{root}/state", f"{root}/leads", f"{root}/checkpoint", run_ts, buckets=16).awaitTermination()
    registry = RegistryStore(spark, f"{root}/state", 16).before(3)
    leads = spark.read.parquet(f"{root}/leads").groupBy("fingerprint").agg(F.count_if("is_new").alias("n_new"), F.count(F.lit(1)).alias("n_leads"))
    return registry.join(leads, "fingerprint", "left").select("fingerprint", "times_seen", "best_match_score", "application_status", "n_new", "n_leads")


HORIZON, LATENESS = timedelta(days=2), timedelta(hours=6)
_FIRST_SEEN = """WITH RECURSIVE e AS (SELECT event_id, user_id || ' ' || event_type AS k, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT event_id, k, ts, rn, ts AS kept_at, true AS stays FROM e WHERE rn = 1
  UNION ALL SELECT e.event_id, e.k, e.ts, e.rn, CASE WHEN e.ts - f.kept_at >= INTERVAL 2 DAY THEN e.ts ELSE f.kept_at END, e.ts - f.kept_at >= INTERVAL 2 DAY FROM f JOIN e ON e.k = f.k AND e.rn = f.rn + 1)
SELECT event_id, k, epoch_us(ts) AS at FROM f WHERE stays AND epoch_us(ts) <= (SELECT (epoch_ms(max(ts)) - 6 * 3600000) * 1000 FROM events)"""


def arriving_events(spark, sf, root, files=6):
    """Events in files that arrive one after another, each event up to five hours after its time."""
    events = read(spark, sf, "events").select("event_id", F.concat_ws(" ", "user_id", "event_type").alias("k"), F.col("ts").cast("timestamp").alias("ts"))
    arrival = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(5 * 3600)) * 1_000_000
    low, high = events.agg(F.min(arrival), F.max(arrival)).first()
    for i in range(files):
        own = F.least(F.floor((arrival - low) * files / (high - low + 1)), F.lit(files - 1)) == i
        events.where(own).coalesce(1).write.mode("append").parquet(f"{root}/landed")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/landed")


@query("str_2_first_seen", _FIRST_SEEN)
def _(spark, sf):
    """Events that repeat nothing of their user and type within two days, of those that are final when all files are in."""
    root = f"{shared_folder(spark)}/str-2-{uuid.uuid4().hex}"
    kept = stream_first_seen(arriving_events(spark, sf, root), "k", "ts", "event_id", HORIZON, LATENESS)
    kept.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{root}/out").select("event_id", "k", F.unix_micros("ts").alias("at"))
