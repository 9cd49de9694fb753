"""Streams over the events file, read until all of it is processed."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from tidemark.plans.base import query, table
from tidemark.sources.io import scratch
from tidemark.streaming import ticks


def _run(spark, stream, mode: str):
    base = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    ticks.run_to_table(stream, f"{base}/out", f"{base}/checkpoint", mode)
    return spark.read.parquet(f"{base}/out")


@query("SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value, max(ts) AS ts FROM events GROUP BY user_id")
def stream_latest_state(spark, sf):
    stream = ticks.stream_files(spark, f"{sf}/events.parquet")
    return _run(spark, ticks.latest_by_key(stream, ["user_id"], ["ts", "event_id"], ["event_id", "value", "ts"]), "complete")


@query("""SELECT event_id, price FROM (SELECT event_id, floor(value / 25)::DOUBLE AS price, lag(floor(value / 25)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
          WHERE before IS NULL OR abs(price - before) > 0.0001""")
def stream_change_filter(spark, sf):
    rows = ticks.stream_files(spark, f"{sf}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.floor(F.col("value") / 25).cast("double").alias("price"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    with _rocks(spark):
        return _run(spark, ticks.change_filter(rows), "append").select(F.col("id").alias("event_id"), "price")


@contextmanager
def _rocks(spark):
    """The state store that stateful processors need, for as long as a stream runs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ticks.ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@query("""WITH f AS (SELECT user_id, event_id, [event_type, CASE WHEN event_id % 3 = 0 THEN '' ELSE (event_id % 50)::VARCHAR END, CASE WHEN event_id % 4 = 0 THEN (event_id % 7)::VARCHAR ELSE '' END] AS v FROM events),
    g AS (SELECT user_id, event_id, nullif(v[2], '') AS b, nullif(v[3], '') AS c, v[1] AS a FROM f)
    SELECT user_id || '_' || a AS frame, event_id, a AS kind, coalesce(last_value(b IGNORE NULLS) OVER w, '') AS bid, coalesce(last_value(c IGNORE NULLS) OVER w, '') AS ask FROM g WINDOW w AS (PARTITION BY user_id, a ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def stream_partial_frames(spark, sf):
    """Frames whose empty fields keep what the frames before them said."""
    e = ticks.stream_files(spark, f"{sf}/events.parquet")
    some = lambda c, v: F.when(c, v.cast("string")).otherwise("")
    fields = F.array(F.col("event_type"), some(F.col("event_id") % 3 != 0, F.col("event_id") % 50), some(F.col("event_id") % 4 == 0, F.col("event_id") % 7))
    rows = e.select(F.concat(F.col("user_id").cast("string"), F.lit("_"), "event_type").alias("key"), F.col("event_id").alias("id"), fields.alias("fields"))
    with _rocks(spark):
        out = _run(spark, ticks.merged_frames(rows), "append")
    return out.select(F.col("key").alias("frame"), F.col("id").alias("event_id"), *[F.col("fields")[i].alias(n) for i, n in enumerate(("kind", "bid", "ask"))])


@query("""WITH a AS (SELECT user_id, event_id, ts, value FROM events WHERE event_type <> 'error' AND value BETWEEN 20 AND 400 AND event_id % 17 <> 0),
    l AS (SELECT *, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), value) AS previous, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM a)
    SELECT user_id, event_id, value AS price, previous, round(value - previous, 2) AS change, CASE WHEN previous > 0 THEN round(round(value - previous, 2) / previous * 100, 4) ELSE 0 END::DOUBLE AS change_pct,
        greatest(0, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1000000.0::DOUBLE) AS age_seconds, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1000000.0::DOUBLE > 3600 AS expired FROM l WHERE nth = 1""")
def rate_cache(spark, sf):
    """The live cache: rates of the wrong kind, out of bounds or of the future never replace one."""
    e = table(spark, sf, "events").withColumnRenamed("value", "price")
    published = F.when(F.col("event_id") % 17 == 0, F.col("ts") + F.expr("interval 1 second")).otherwise(F.col("ts"))
    ok = ticks.cache_accepts(F.col("price"), F.lit("VALID"), published, F.col("ts"), F.col("event_type") != "error", 20, 400)
    out = ticks.cache_view(ticks.cached_rates(e, ["user_id"], ["ts", "event_id"], ok), F.lit("2024-02-01 00:00:00").cast("timestamp"), 3600.0, "ts")
    return out.select("user_id", "event_id", "price", "previous", "change", "change_pct", "age_seconds", "expired")
