"""Streams with keyed state: channel previews that are read again and again, and leases that run out.

State lies in the state store, one small value a key (and of a channel its known addresses, as long as they are kept), so no batch
reads what earlier ones wrote. A micro-batch's rows of one key are put in order of time before they are applied; their
number is bounded by the source's trigger options. A stream that is started again goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession):
    """The store that keyed state with timers and expiry needs, for streams started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _fields(**kinds) -> StructType:
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


def listing_hash(posts: Column, *, most: int = 20) -> Column:
    """Digest of the addresses of a listing's first posts; null where there are none."""
    return F.when(F.size(posts) > 0, F.sha2(F.array_join(F.transform(F.slice(posts, 1, most), lambda p: p["url"]), "\n"), 256))


class _Channel(StatefulProcessor):
    """The last listing and newest post of a channel, and its late addresses."""

    def __init__(self, known_for_days: int) -> None:
        self.known_for = known_for_days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _fields(hash=StringType(), url=StringType(), at=LongType()))
        self.known = handle.getMapState("known", _fields(url=StringType()), _fields(at=LongType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fetches = pd.concat(list(rows)).sort_values("fetched_at", kind="stable")
        before = self.last.get()
        last_hash, last_url, last_at = before or (None, None, None)
        out, new = [], {}
        for fetch in fetches.itertuples():
            posts, added, known, old = list(fetch.posts), [], 0, 0
            if posts and fetch.listing_hash == last_hash:
                known = len(posts)
            elif posts:
                for post in posts:
                    at = None if pd.isna(post["published_at"]) else int(pd.Timestamp(post["published_at"]).value // 1000)
                    if last_url and post["url"] == last_url:
                        known += 1
                        break
                    if post["url"] in new or (before and self.known.containsKey((post["url"],))):  # a channel seen first has no known addresses
                        known += 1
                    elif at is not None and last_at is not None and at <= last_at:
                        old += 1
                    else:
                        added.append(post)
                        new[post["url"]] = int(fetch.fetched_at.value // 1000)
                newest = posts[0]["published_at"]
                last_hash, last_url = fetch.listing_hash, posts[0]["url"]
                last_at = None if pd.isna(newest) else int(pd.Timestamp(newest).value // 1000)
            out.append((key[0], fetch.fetched_at, added, known, old))
        for url, at in new.items():
            self.known.updateValue((url,), (at,))
        if self.known_for:
            latest = int(fetches["fetched_at"].iloc[-1].value // 1000)
            for url, (at,) in list(self.known.iterator()):
                if at < latest - self.known_for:
                    self.known.removeKey(url)
        if before is None or tuple(before) != (last_hash, last_url, last_at):
            self.last.update((last_hash, last_url, last_at))
        yield pd.DataFrame(out, columns=["source_id", "fetched_at", "added", "skipped_known", "skipped_old"])


POST = "struct<url:string,title:string,text:string,published_at:timestamp>"


def channel_ingest(previews: DataFrame, *, known_for_days: int = 0) -> DataFrame:
    """(source_id, fetched_at, added, skipped_known, skipped_old) of each preview of a channel that a stream brings.

    ``previews``: source_id (long), fetched_at, posts (newest first). A listing that did not change is passed over; reading
    stops at the newest post of the time before; known addresses, and posts not newer than that post, are not added.
    ``known_for_days`` forgets addresses that were added so long before the latest listing (0: never); what is forgotten is still held back by its date.
    """
    keyed = previews.where("source_id IS NOT NULL").select("source_id", "fetched_at", F.expr(f"cast(posts as array<{POST}>)").alias("posts"), listing_hash(F.col("posts")).alias("listing_hash"))
    schema = f"source_id long, fetched_at timestamp, added array<{POST}>, skipped_known int, skipped_old int"
    return keyed.groupBy("source_id").transformWithStateInPandas(_Channel(known_for_days), schema, "append", "None")


class _Lease(StatefulProcessor):
    """One job: status, holder's token, when the lease runs out (ms), attempts, and counts of renewals and refusals."""

    def __init__(self, lease_ms: int, most: int) -> None:
        self.lease_ms, self.most = lease_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _fields(status=StringType(), token=StringType(), expires=LongType(), attempts=LongType(), renewed=LongType(), refused=LongType(), seq=LongType()))

    def _lost(self, job: list, now: int) -> bool:
        if job[0] != "running" or job[2] > now:
            return False
        job[0], job[1] = "queued" if job[3] < self.most else "failed", None
        return True

    def _row(self, key, job: list) -> pd.DataFrame:
        job[6] += 1
        self.job.update(tuple(job))
        return pd.DataFrame({"job_id": [key[0]], "seq": [job[6]], "status": [job[0]], "attempts": [job[3]], "renewed": [job[4]], "refused": [job[5]]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job, frames = list(self.job.get() or ("queued", None, 0, 0, 0, 0, 0)), list(rows)
        timer = job[2] if job[0] == "running" else None
        at, event, kinds, tokens = (np.concatenate([f[c].to_numpy() for f in frames]) for c in ("at", "event_id", "kind", "token"))
        order = np.lexsort((event, at))
        moments = at[order].astype("datetime64[ns]").astype("int64") // 1_000_000
        for now, kind, token in zip(moments.tolist(), kinds[order], tokens[order], strict=True):
            self._lost(job, now)
            if kind == "claim":
                if job[0] == "queued":
                    job[0], job[1], job[2], job[3] = "running", token, now + self.lease_ms, job[3] + 1
            elif job[0] != "running" or job[1] != token:
                job[5] += 1
            elif kind == "beat":
                job[2], job[4] = now + self.lease_ms, job[4] + 1
            else:
                job[0], job[1] = "ok" if kind == "finish" else "queued" if job[3] < self.most else "failed", None
        ends = job[2] if job[0] == "running" else None  # a running job has this one timer
        if timer != ends:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if ends is not None:
                self.handle.registerTimer(ends)
        yield self._row(key, job)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job = list(self.job.get() or ("queued", None, 0, 0, 0, 0, 0))
        if self._lost(job, expiredTimerInfo.getExpiryTimeInMs()):
            yield self._row(key, job)


def lease_lifetimes(events: DataFrame, *, lease_seconds: int = 600, most: int = 3) -> DataFrame:
    """(job_id, seq, status, attempts, renewed, refused): each job after every batch that touches it, and when its lease runs out.

    ``events``: job_id, event_id, at, kind (claim, beat, finish, fail), token. Only the holder of a lease that has not run out
    renews, finishes or fails it. A lost job is queued again, or failed when out of attempts. Time is that of the events: leases
    run out as the watermark passes. The row of the greatest ``seq`` is the job's latest state.
    """
    stamped = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", "0 seconds")
    schema = "job_id long, seq long, status string, attempts long, renewed long, refused long"
    return stamped.groupBy("job_id").transformWithStateInPandas(_Lease(lease_seconds * 1000, most), schema, "append", "EventTime")
