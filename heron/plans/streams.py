"""Streams with timers and state in the order of time. Each runs in several parts, one after another from one checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heron.functions import text as T
from heron.plans.base import Plans, at, shared_root, table
from heron.sources import commits
from heron.streaming import ordered
from heron.streaming.events import run_to_table

PLANS = Plans()


def in_parts(spark: SparkSession, parts: list[DataFrame], process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream gives whose input comes in parts: the query is started anew for each, from its checkpoint."""
    folder = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    for i, part in enumerate(parts):
        part.write.parquet(f"{folder}/in/{i}")
        stream = spark.readStream.schema(part.schema).parquet(f"{folder}/in/*")
        out = run_to_table(process(stream), folder, timers=True)
    return out


def _plain(df: DataFrame, *times: str) -> DataFrame:
    """Timestamps without a zone, as the tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


_COST, _BEAT = 60, 90


@PLANS.query(
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, CAST(ts AS DATE) AS d, event_type = 'error' AS beat, event_id % 10 <> 0 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (
      SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS outcome, 100::BIGINT AS energy, min(d) AS d, NULL::TIMESTAMP AS sleep, []::STRUCT(event_id BIGINT, place BIGINT, ok BOOLEAN)[] AS buf,
        0::BIGINT AS en0, []::STRUCT(event_id BIGINT, place BIGINT, ok BOOLEAN)[] AS gone, 0::BIGINT AS had, NULL::TIMESTAMP AS slept FROM e GROUP BY user_id
      UNION ALL
      SELECT user_id, n, event_id, outcome, CASE outcome WHEN 'processed' THEN en1 - CASE WHEN beat THEN {_BEAT} ELSE {_COST} END ELSE en1 END, d,
        CASE WHEN outcome = 'buffered' THEN coalesce(sleep1, ts) ELSE sleep1 END,
        CASE WHEN outcome = 'buffered' THEN list_sort(list_append(rest, {{'event_id': event_id, 'place': n, 'ok': ok}})) ELSE rest END, en0, gone, had, slept
      FROM (SELECT *, CASE WHEN beat THEN CASE WHEN en1 >= {_BEAT} THEN 'processed' ELSE 'dropped' END WHEN en1 >= {_COST} THEN 'processed' ELSE 'buffered' END AS outcome, CASE WHEN len(rest) = 0 THEN NULL ELSE slept END AS sleep1 FROM (
        SELECT *, buf[1:k] AS gone, buf[k + 1:] AS rest, en0 - {_COST} * len(list_filter(buf[1:k], lambda x: x.ok)) AS en1, len(buf) AS had FROM (
          SELECT *, coalesce(list_filter(range(1, len(buf) + 1), lambda i: buf[i].ok)[en0 // {_COST} + 1] - 1, len(buf)) AS k FROM (
            SELECT e.user_id, e.n, e.event_id, e.ts, e.d, e.beat, e.ok, f.buf, f.sleep AS slept, CASE WHEN e.d > f.d THEN least(200, f.energy + 100 * (e.d - f.d)) ELSE f.energy END AS en0
            FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)))))
    SELECT user_id, event_id, outcome, NULL::BIGINT AS by_event, energy, len(buf)::BIGINT AS waiting, sleep AS sleep_since FROM f WHERE n > 0
    UNION ALL SELECT user_id, gone[i].event_id, CASE WHEN gone[i].ok THEN 'replayed' ELSE 'deleted' END, event_id, en0 - {_COST} * len(list_filter(gone[1:i], lambda x: x.ok)), had - i, slept FROM (SELECT *, unnest(range(1, len(gone) + 1)) AS i FROM f)"""
)
def spill_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their payloads, every tenth of them broken, in two halves of the month; errors stand for heartbeats."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withColumn("payload", F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")))
    half = F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp")
    out = in_parts(spark, [e.where(half), e.where(~half)], lambda s: ordered.budget_stream(s, F.col("event_type") == "error", F.col("payload"), _COST, _BEAT, days=10))
    return _plain(out, "sleep_since")


@PLANS.query(
    """WITH x AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after, (SELECT max(ts) FROM events WHERE event_type <> 'error') AS mark FROM events WHERE event_type <> 'error'),
    t AS (SELECT user_id, ts, after, mark, unnest(range(1, 7 + date_diff('minute', ts, coalesce(after, mark)) // 360)) AS idle FROM x),
    o AS (SELECT *, ts + to_minutes(CAST(CASE WHEN idle < 5 THEN 30 * pow(2, idle - 1) ELSE 480 + 360 * (idle - 5) END AS BIGINT)) AS tick_at FROM t)
    SELECT user_id, tick_at, idle, CAST(least(360, 30 * pow(2, least(idle - 1, 8))) AS BIGINT) AS minutes FROM o WHERE CASE WHEN after IS NULL THEN tick_at <= mark ELSE tick_at < after END"""
)
def heartbeat_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticks that each user's heartbeat makes by itself between the external events (all but errors), until the last."""
    e = table(spark, sf_dir, "events").where("event_type <> 'error'").withColumn("ts", F.col("ts").cast("timestamp"))
    half = F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp")
    return _plain(in_parts(spark, [e.where(half), e.where(~half)], lambda s: ordered.heartbeat_stream(s, days=10)), "tick_at")


@PLANS.query(
    """SELECT o_custkey AS person_id, o_orderkey AS alarm_id, o_orderdate AS trigger_at, greatest(o_orderdate, TIMESTAMP '1996-06-01 00:00:00') AS fired_at FROM orders
    WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1997-01-01 00:00:00' AND (o_orderkey % 7 > 0 OR o_orderdate <= TIMESTAMP '1996-08-01 00:00:00')"""
)
def timers_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms of orders, set in June 1996; after a restart every seventh is cancelled in August, and the year ends."""
    o = table(spark, sf_dir, "orders")
    stamp = lambda c: F.lit(c).cast("timestamp")
    shard = F.pmod(F.xxhash64("o_orderkey"), F.lit(4)).cast("int")
    row = lambda df, when, status: df.select(F.col("o_custkey").alias("person_id"), shard.alias("shard"), stamp(when).alias("changed_at"), F.col("o_orderkey").alias("alarm_id"), F.col("o_orderdate").cast("timestamp").alias("trigger_at"), status.cast("int").alias("status"))
    made = row(o, "1996-06-01 00:00:00", F.when(F.col("o_orderstatus") == "O", 0).otherwise(1))
    gone = row(o.where("o_orderkey % 7 = 0"), "1996-08-01 00:00:00", F.lit(2))
    end = spark.range(1).select(F.lit(0).cast("long").alias("person_id"), F.lit(0).alias("shard"), stamp("1997-01-01 00:00:00").alias("changed_at"), F.lit(None).cast("long").alias("alarm_id"), F.lit(None).cast("timestamp").alias("trigger_at"), F.lit(None).cast("int").alias("status"))
    return _plain(in_parts(spark, [made, gone.unionByName(end)], ordered.alarm_stream), "trigger_at", "fired_at").drop("shard")


_WINDOWS = """m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, length(text) // 4 AS t FROM conversations),
f AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS seq, 0::BIGINT AS n, 0::BIGINT AS used, false AS closed FROM m
  UNION ALL
  SELECT m.conv_id, m.seq, CASE WHEN f.closed THEN 1 ELSE f.n + 1 END, CASE WHEN f.closed THEN m.t ELSE f.used + m.t END, (CASE WHEN f.closed THEN 1 ELSE f.n + 1 END) >= 3 OR (CASE WHEN f.closed THEN m.t ELSE f.used + m.t END) > 100
  FROM f JOIN m ON m.conv_id = f.conv_id AND m.seq = f.seq + 1)"""


@PLANS.query(f"WITH RECURSIVE {_WINDOWS} SELECT conv_id, seq AS version, seq - n + 1 AS first_seq, n AS n_messages, used AS tokens, seq - n AS base FROM f WHERE closed")
def summary_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in four parts by their turns; a window that a part leaves open goes on in the next."""
    c = table(spark, sf_dir, "conversations")
    created = (at("2024-01-01 00:00:00") + F.make_dt_interval(hours=F.col("turn").cast("int"), mins=(F.col("conv_id") % 60).cast("int"))).cast("timestamp")
    m = c.select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "turn", "text", created.alias("created_at"))
    parts = [m.where("turn <= 1"), m.where("turn = 2"), m.where("turn in (3, 4)"), m.where("turn > 4")]
    return in_parts(spark, parts, lambda s: ordered.window_stream(s, T.estimated_tokens(F.col("text")), window=3, most_tokens=100))


@PLANS.query("SELECT 'orders' AS of, o_orderkey AS id, o_orderstatus AS value FROM orders UNION ALL SELECT 'totals', o_custkey, CAST(count(*) AS VARCHAR) FROM orders GROUP BY o_custkey, o_orderkey % 3")
def stream_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in three batches, each published as two tables at once; then all batches are delivered again, by a stream that
    has lost its checkpoint."""
    root = f"{shared_root(spark)}/published-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    done = commits.Commits(spark, f"{root}/tables")
    for k in range(3):
        o.where(f"o_orderkey % 3 = {k}").coalesce(1).write.parquet(f"{root}/in/{k}")
    tables = lambda df: {"orders": df.drop("o_custkey"), "totals": df.groupBy("o_custkey").agg(F.count("*").alias("n"))}
    for again in range(2):
        stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")
        commits.publish_stream(stream, done, "orders", tables, f"{root}/checkpoint-{again}").awaitTermination()
    orders, totals = done.read("orders"), done.read("totals")
    return orders.select(F.lit("orders").alias("of"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("value")).unionByName(totals.select(F.lit("totals").alias("of"), F.col("o_custkey").alias("id"), F.col("n").cast("string").alias("value")))
