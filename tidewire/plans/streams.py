"""Queries that stream the newsroom's tables through keyed state, in several runs from one checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.tables import new_folder
from tidewire.plans.register import Register
from tidewire.sources import pages as page_source
from tidewire.sources.newsroom import Newsroom
from tidewire.streaming import state

query = Register()
QUERIES, oracle_sql = query.queries, query.oracle_sql


def in_runs(slices: list[DataFrame], plan: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What a stream appends that is started once for each slice of its source, from one checkpoint."""
    spark = slices[0].sparkSession
    source, target, checkpoint = (new_folder(spark, f"{name}-{part}") for part in ("source", "target", "checkpoint"))
    schema = None
    for rows in slices:
        rows.write.mode("append").parquet(source)
        out = plan(spark.readStream.schema(rows.schema).parquet(source))
        schema = out.schema
        with state.state_store(spark):
            run = out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(schema).parquet(target)


@query("""
    SELECT conv_id AS source_id, concat('https://t.me/c', CAST(conv_id AS VARCHAR), '/', CAST(turn AS VARCHAR)) AS url, length(trim(regexp_replace(replace(text, chr(160), ' '), '\\s+', ' ', 'g'))) AS chars,
        CASE WHEN turn <= 2 THEN 1 ELSE 2 END AS fetch
    FROM conversations WHERE trim(regexp_replace(replace(text, chr(160), ' '), '\\s+', ' ', 'g')) <> ''""")
def channel_ingest(room: Newsroom) -> DataFrame:
    """New posts of channels of which a preview is read three times, the third time unchanged (SRC-12 to SRC-14, STR-12)."""
    turns = room.table("conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    shown = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    at = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 3600), "yyyy-MM-dd'T'HH:mm:ss")
    post = F.concat(F.lit('<div class="m" data-post="c'), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit('"><div class="tgme_widget_message_text js">'), shown, F.lit('</div><time datetime="'), at, F.lit('"></time></div>'))

    def preview(last_turn: int, fetch: int) -> DataFrame:
        pages = turns.where(F.col("turn") <= last_turn).groupBy(F.col("conv_id").alias("source_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", post.alias("p")))), lambda x: x["p"]), "").alias("html"))
        return pages.select("source_id", F.timestamp_seconds(F.lit(1_800_000_000 + fetch)).alias("fetched_at"), "html")

    def plan(stream: DataFrame) -> DataFrame:
        return state.channel_ingest(page_source.channel_previews(stream, limit=1000))

    found = in_runs([preview(2, 1), preview(1 << 40, 2), preview(1 << 40, 3)], plan, "channels")
    fetch = (F.unix_timestamp("fetched_at") - 1_800_000_000).cast("int")
    return found.select("source_id", F.explode("added").alias("p"), fetch.alias("fetch")).select("source_id", "p.url", F.length("p.text").alias("chars"), "fetch")


_STEPS = "SELECT user_id AS job_id, event_id, ts AS moment, CASE event_type WHEN 'signup' THEN 'claim' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' ELSE 'beat' END AS kind, CAST(event_id % 3 AS STRING) AS token FROM events WHERE user_id IS NOT NULL"


@query(f"""
    WITH e AS ({_STEPS}), listed AS (SELECT job_id, list({{'k': kind, 't': token, 's': '', 'h': '', 'x': epoch_ms(moment), 'a': 0::BIGINT, 'n': 0::BIGINT, 'r': 0::BIGINT}} ORDER BY moment, event_id) AS steps FROM e GROUP BY job_id),
    ended AS (SELECT job_id, list_append(steps, {{'k': 'end', 't': '', 's': '', 'h': '', 'x': (SELECT epoch_ms(max(moment)) FROM e), 'a': 0::BIGINT, 'n': 0::BIGINT, 'r': 0::BIGINT}}) AS steps FROM listed),
    done AS (SELECT job_id, list_reduce(steps, lambda j, e: list_reduce([{{'k': j.k, 't': j.t, 's': CASE WHEN j.s = 'running' AND j.x <= e.x THEN CASE WHEN j.a < 3 THEN 'queued' ELSE 'failed' END ELSE j.s END, 'h': j.h, 'x': j.x, 'a': j.a, 'n': j.n, 'r': j.r}}, e], lambda j, e:
        {{'k': '', 't': '',
          's': CASE WHEN e.k = 'claim' AND j.s = 'queued' THEN 'running' WHEN e.k IN ('finish', 'fail') AND j.s = 'running' AND j.h = e.t THEN CASE WHEN e.k = 'finish' THEN 'ok' WHEN j.a < 3 THEN 'queued' ELSE 'failed' END ELSE j.s END,
          'h': CASE WHEN e.k = 'claim' AND j.s = 'queued' THEN e.t ELSE j.h END,
          'x': CASE WHEN e.k = 'claim' AND j.s = 'queued' OR e.k = 'beat' AND j.s = 'running' AND j.h = e.t THEN e.x + 7776000000 ELSE j.x END,
          'a': j.a + CASE WHEN e.k = 'claim' AND j.s = 'queued' THEN 1 ELSE 0 END,
          'n': j.n + CASE WHEN e.k = 'beat' AND j.s = 'running' AND j.h = e.t THEN 1 ELSE 0 END,
          'r': j.r + CASE WHEN e.k IN ('beat', 'finish', 'fail') AND NOT (j.s = 'running' AND j.h = e.t) THEN 1 ELSE 0 END}}),
        {{'k': '', 't': '', 's': 'queued', 'h': '', 'x': 0::BIGINT, 'a': 0::BIGINT, 'n': 0::BIGINT, 'r': 0::BIGINT}}) AS j FROM ended)
    SELECT job_id, j.s AS status, j.a AS attempts, j.n AS renewed, j.r AS refused FROM done""")
def lease_lifetimes(room: Newsroom) -> DataFrame:
    """Jobs after their streamed claims, renewals, results and lost leases, the events in three runs by time (STR-3)."""
    events = room.sql(_STEPS).withColumn("at", F.col("moment").cast("timestamp")).drop("moment")
    first, last = events.agg(F.min("at"), F.max("at")).first()
    third = (last - first) / 3 if first else None
    part = F.when(F.col("at") < F.lit(first + third), 0).when(F.col("at") < F.lit(first + 2 * third), 1).otherwise(2) if first else F.lit(0)
    found = in_runs([events.where(part == i) for i in range(3)], lambda s: state.lease_lifetimes(s, lease_seconds=7_776_000), "leases")
    latest = found.groupBy("job_id").agg(F.max_by(F.struct("status", "attempts", "renewed", "refused"), "seq").alias("j"))
    return latest.select("job_id", "j.*")
