"""The job queue as tables: claims, leases, retries and sweeps as snapshot steps.

Spark has no row locks; a claim is a deterministic step over a snapshot, made by the
one job that writes the next snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import retry_delay


def claim(jobs: DataFrame, now: Column, *, per_queue: int = 1, lease_seconds: int = 600) -> DataFrame:
    """The snapshot after the oldest ready jobs of each queue were claimed."""
    ready = (F.col("status") == "queued") & (F.col("run_after").isNull() | (F.col("run_after") <= now))
    # only ready rows are ranked, so one queue's finished jobs never meet in a window
    order = Window.partitionBy("queue_name").orderBy("created_at", "id")
    taken = jobs.where(ready).select("queue_name", "created_at", "id").withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= per_queue).select("id", F.lit(True).alias("_taken"))
    joined = jobs.join(taken, "id", "left")
    mine = F.coalesce("_taken", F.lit(False))
    return joined.withColumns({
        "status": F.when(mine, "running").otherwise(F.col("status")),
        "attempts": F.col("attempts") + mine.cast("int"),
        "lease_expires_at": F.when(mine, now + F.make_dt_interval(secs=F.lit(float(lease_seconds)))).otherwise(F.col("lease_expires_at")),
    }).select(*jobs.columns)


def sweep(jobs: DataFrame, now: Column) -> DataFrame:
    """The snapshot after running jobs without a valid lease were queued again, or failed when out of attempts."""
    lost = (F.col("status") == "running") & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < now))
    again = lost & (F.col("attempts") < F.col("max_attempts"))
    return jobs.withColumns({
        "run_after": F.when(again, now + F.make_dt_interval(secs=retry_delay(F.col("attempts")))).otherwise(F.col("run_after")),
        "lease_expires_at": F.when(lost, F.lit(None)).otherwise(F.col("lease_expires_at")),
        "status": F.when(again, "queued").when(lost, "failed").otherwise(F.col("status")),
    }).select(*jobs.columns)


def heartbeat(jobs: DataFrame, beats: DataFrame, now: Column, *, lease_seconds: int = 600) -> DataFrame:
    """Renews leases that are still valid, for the (id, lease_token) rows of ``beats``."""
    held = jobs.join(beats.select("id", F.col("lease_token").alias("_token")).distinct(), "id", "left")
    good = F.coalesce((F.col("status") == "running") & (F.col("lease_token") == F.col("_token")) & (F.col("lease_expires_at") >= now), F.lit(False))
    return held.withColumn("lease_expires_at", F.when(good, now + F.make_dt_interval(secs=F.lit(float(lease_seconds)))).otherwise(F.col("lease_expires_at"))).select(*jobs.columns)


def batches(ids: DataFrame, size: int, id_col: str = "id") -> DataFrame:
    """Ids dealt into jobs of at most ``size``: ranges first, then consecutive groups within each partition."""
    ordered = ids.select(F.col(id_col).alias("id")).repartitionByRange("id").withColumn("_part", F.spark_partition_id())
    order = Window.partitionBy("_part").orderBy("id")
    numbered = ordered.withColumn("_job", F.floor((F.row_number().over(order) - 1) / size))
    return numbered.groupBy("_part", "_job").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("first_id"), "ids")


def _held(jobs: DataFrame, rows: DataFrame, extra: list[str]) -> DataFrame:
    """Jobs with the token, and further columns, that a worker brings for them."""
    brought = rows.dropDuplicates(["id"]).select("id", F.col("lease_token").alias("_token"), *[F.col(c).alias(f"_{c}") for c in extra])
    return jobs.join(brought, "id", "left")


def begin_finalize(jobs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose worker still holds the lease become ``finalizing``: from then on no sweep gives them to another."""
    mine = (F.col("status") == "running") & (F.col("lease_token") == F.col("_token")) & (F.col("lease_expires_at") > now)
    return _held(jobs, results, []).withColumn("status", F.when(F.coalesce(mine, F.lit(False)), "finalizing").otherwise(F.col("status"))).select(*jobs.columns)


def end_finalize(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Finalizing jobs become ``ok`` where ``applied`` is true, else they are running again."""
    mine = F.coalesce((F.col("status") == "finalizing") & (F.col("lease_token") == F.col("_token")), F.lit(False))
    return _held(jobs, results, ["applied"]).withColumn("status", F.when(mine & F.col("_applied"), "ok").when(mine, "running").otherwise(F.col("status"))).select(*jobs.columns)


def fail(jobs: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Jobs of ``failures`` (id, retry_seconds): queued again after the delay while attempts are left, else failed."""
    joined = jobs.join(failures.dropDuplicates(["id"]).select("id", F.lit(True).alias("_failed"), F.col("retry_seconds").alias("_delay")), "id", "left")
    hit = F.coalesce("_failed", F.lit(False))
    again = hit & F.col("_delay").isNotNull() & (F.col("attempts") < F.col("max_attempts"))
    return joined.withColumns({
        "status": F.when(again, "queued").when(hit, "failed").otherwise(F.col("status")),
        "run_after": F.when(again, now + F.make_dt_interval(secs=F.col("_delay").cast("double"))).otherwise(F.col("run_after")),
    }).select(*jobs.columns)


def claim_by_capability(jobs: DataFrame, have: list[str], now: Column, *, limit: int = 1) -> DataFrame:
    """Ids of the oldest ready jobs whose needs a worker has; jobs without needs fit every worker."""
    ready = (F.col("status") == "queued") & (F.col("run_after").isNull() | (F.col("run_after") <= now))
    fits = (F.size(F.coalesce("capabilities", F.array().cast("array<string>"))) == 0) | F.arrays_overlap("capabilities", F.array(*map(F.lit, have)))
    return jobs.where(ready & fits).orderBy("created_at", "id").limit(limit).select("id")
