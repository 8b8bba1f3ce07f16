"""Queries of keyed event processing, in batch and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heron.functions import scalars as S
from heron.operators import relational, runtime
from heron.plans.base import Plans, at, shared_root, table

PLANS = Plans()

_COST, _BEAT = 60, 90
_ENERGY = f"""e AS (SELECT user_id, event_id, CAST(ts AS DATE) AS d, event_type = 'error' AS beat, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (
  SELECT user_id, 0::BIGINT AS n, 100::BIGINT AS energy, min(d) AS d, 0::BIGINT AS waiting, 0::BIGINT AS p, 0::BIGINT AS b, 0::BIGINT AS x, 0::BIGINT AS r, NULL::BIGINT AS event_id FROM e GROUP BY user_id
  UNION ALL
  SELECT user_id, n, CASE WHEN beat AND en >= {_BEAT} THEN en - {_BEAT} WHEN NOT beat AND w = 0 AND en >= {_COST} THEN en - {_COST} ELSE en END, d,
    CASE WHEN NOT beat AND (w > 0 OR en < {_COST}) THEN w + 1 ELSE w END,
    p + CASE WHEN (beat AND en >= {_BEAT}) OR (NOT beat AND w = 0 AND en >= {_COST}) THEN 1 ELSE 0 END,
    b + CASE WHEN NOT beat AND (w > 0 OR en < {_COST}) THEN 1 ELSE 0 END, x + CASE WHEN beat AND en < {_BEAT} THEN 1 ELSE 0 END, r, event_id
  FROM (
    SELECT user_id, n, d, beat, event_id, en - least(waiting, en // {_COST}) * {_COST} AS en, waiting - least(waiting, en // {_COST}) AS w, p, b, x, r + least(waiting, en // {_COST}) AS r
    FROM (SELECT e.user_id, e.n, e.d, e.beat, e.event_id, CASE WHEN e.d > f.d THEN least(200, f.energy + 100 * (e.d - f.d)) ELSE f.energy END AS en, f.waiting, f.p, f.b, f.x, f.r
          FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)))"""


@PLANS.query(
    f"""WITH RECURSIVE {_ENERGY} SELECT user_id, energy, waiting, p AS n_processed, b AS n_buffered, x AS n_dropped, r AS n_replayed FROM f
    WHERE n = (SELECT max(n) FROM e WHERE e.user_id = f.user_id)"""
)
def energy_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors stand for heartbeats; costs are high enough here for energy to run short."""
    return runtime.energy_replay(table(spark, sf_dir, "events"), F.col("event_type") == "error", cost=_COST, heartbeat_cost=_BEAT)


@PLANS.query(
    f"""WITH RECURSIVE {_ENERGY}, o AS (SELECT f.*, s.ts, b - lag(b) OVER w AS db, x - lag(x) OVER w AS dx, lag(waiting) OVER w AS was, lag(r) OVER w AS r0 FROM f LEFT JOIN events s ON s.event_id = f.event_id WINDOW w AS (PARTITION BY f.user_id ORDER BY n)),
    m AS (SELECT *, last_value(CASE WHEN waiting > 0 AND was = r - r0 THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS slept FROM o WHERE n > 0)
    SELECT m.user_id, m.event_id, CASE WHEN m.db > 0 THEN 'buffered' WHEN m.dx > 0 THEN 'dropped' ELSE 'processed' END AS outcome, m.energy, m.waiting, m.r - m.r0 AS n_replayed, CASE WHEN m.waiting > 0 THEN m.slept END AS sleep_since, y.event_id AS replayed_by
    FROM m LEFT JOIN o y ON m.db > 0 AND y.user_id = m.user_id AND m.b > y.r0 AND m.b <= y.r"""
)
def energy_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that energy_replay counts, one by one."""
    out = runtime.energy_timeline(table(spark, sf_dir, "events"), F.col("event_type") == "error", cost=_COST, heartbeat_cost=_BEAT)
    return out.select("user_id", "event_id", "outcome", "energy", "waiting", "n_replayed", "sleep_since", "replayed_by")


def _now(text: str = "1997-01-01 00:00:00"):
    return at(text)


@PLANS.query("SELECT o_orderkey, o_orderdate AS trigger_at, o_orderdate <= TIMESTAMP '1997-01-01 00:00:00' AS fired FROM orders WHERE o_orderstatus = 'O'")
def timers_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("trigger_at"), "o_orderstatus")
    due, later = runtime.due_timers(orders, _now(), "trigger_at", F.col("o_orderstatus") == "O")
    return due.withColumn("fired", F.lit(True)).unionByName(later.withColumn("fired", F.lit(False))).drop("o_orderstatus")


@PLANS.query("SELECT event_id, CAST(least(360, 30 * pow(2, least(event_id % 12, 8))) AS INTEGER) AS minutes FROM events")
def heartbeat_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.backoff_minutes(F.col("event_id") % 12 + 1).alias("minutes"))


@PLANS.query(
    """WITH a AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    r AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1 AS c FROM r),
    s AS (SELECT *, max(CASE WHEN c >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) = 1 AS blocked FROM c)
    SELECT event_id, user_id, CAST(c AS INTEGER) AS cycle_count, blocked, NOT blocked AND c >= 2 AS warned FROM s"""
)
def cycle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower limits than the defaults, as runs are short here."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return runtime.signature_runs(events, "user_id", ["ts", "event_id"], F.col("event_type"), warn=2, block=3).select("event_id", "user_id", "cycle_count", "blocked", "warned")


@PLANS.query(
    """SELECT user_id, event_id FROM (
      SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    WHERE i <= CASE WHEN n > 30 THEN 10 ELSE n END"""
)
def bulk_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return runtime.bulk_shrink(events, "user_id", ["ts", "event_id"], limit=30, keep=10).select("user_id", "event_id")


@PLANS.query(
    """WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    d AS (SELECT *, i - coalesce(max(CASE WHEN event_type = 'signup' THEN i END) OVER (PARTITION BY user_id ORDER BY i), 0) AS distance FROM p)
    SELECT event_id, user_id, CAST(distance AS INTEGER) AS distance FROM d WHERE distance >= 10"""
)
def note_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups stand for notes."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return runtime.note_due(events, "user_id", ["ts", "event_id"], F.col("event_type") == "signup").select("event_id", "user_id", "distance")


@PLANS.query(
    """SELECT conv_id, turn FROM (SELECT *, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM conversations)
    WHERE used <= 500 OR i = 1"""
)
def note_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as notes of their conversation."""
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("size"))
    return runtime.trim_notes(d, "conv_id", ["turn"], F.col("size"), 500).select("conv_id", "turn")


@PLANS.query(
    """WITH ran AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'), k AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)
    SELECT 'work' AS of, o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN -1 WHEN 'O' THEN 1 ELSE 2 END AS status FROM orders
    UNION ALL SELECT 'draft', o_orderkey * 10, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM ran) THEN -1 ELSE 0 END FROM orders
    UNION ALL SELECT 'participant', c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM ran) THEN 0 ELSE 2 END FROM customer"""
)
def crash_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in progress are works that ran, each with a draft; customers take part in sessions of their nation."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("session_id"), F.col("c_custkey").alias("person_id"), F.lit(2).alias("status"))
    status = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    works = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("work_id"), F.col("o_custkey").alias("person_id"), (F.col("o_orderkey") * 10).alias("draft_id"), status.alias("status"))
    works = works.join(customers.select("person_id", "session_id"), "person_id")
    drafts = works.select("draft_id", F.lit(0).alias("status"))
    w, d, p = runtime.recovered(works, drafts, customers)
    parts = [x.select(F.lit(name).alias("of"), F.col(c).cast("long").alias("id"), F.col("status").cast("int").alias("status")) for name, x, c in (("work", w, "work_id"), ("draft", d, "draft_id"), ("participant", p, "person_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@PLANS.query(
    """WITH a AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'route' WHEN 1 THEN 'create' WHEN 2 THEN 'cancel' WHEN 3 THEN 'create_alarm' ELSE 'other' END AS type,
      event_type = 'error' AS beat, CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1 END AS et, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'do' END AS guidance, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'why' END AS reason,
      CASE WHEN event_id % 19 > 0 THEN CAST(1 + user_id % 2 AS INTEGER) ELSE 0 END AS work_type, CASE event_id // 5 % 5 WHEN 0 THEN NULL WHEN 1 THEN 'reply' WHEN 2 THEN 'send_to_session' WHEN 3 THEN 'create_and_send' ELSE 'x' END AS target, event_id % 3 AS session, event_id % 4 AS recipient,
      event_id % 13 > 0 AS timed, event_id % 17 > 0 AS said, event_id % 2 = 0 AS sends, event_id % 9 > 0 AS filled, user_id AS in_session, event_id // 5 % 40 AS target_work_id FROM events),
    w AS (SELECT DISTINCT user_id AS session_id, (event_id // 5) % 40 AS work_id FROM events WHERE event_id % 3 > 0),
    j AS (SELECT a.*, CASE WHEN w.work_id IS NULL THEN NULL WHEN w.work_id % 2 = 0 THEN 2 ELSE 1 END AS tt FROM a LEFT JOIN w ON w.session_id = a.in_session AND w.work_id = a.target_work_id)
    SELECT event_id, CASE type
      WHEN 'route' THEN CASE WHEN beat THEN 'not on a heartbeat' WHEN guidance = '' THEN 'no guidance' WHEN reason IS NULL THEN 'no reason' WHEN tt IS NULL THEN 'no such work' WHEN tt <> 2 THEN 'not a task' END
      WHEN 'cancel' THEN CASE WHEN beat THEN 'not on a heartbeat' WHEN guidance = '' THEN 'no guidance' WHEN reason IS NULL THEN 'no reason' WHEN tt IS NULL THEN 'no such work' END
      WHEN 'create' THEN CASE WHEN guidance = '' THEN 'no guidance' WHEN beat AND work_type <> 1 THEN 'chat only on a heartbeat' WHEN work_type = 2 THEN NULL
        WHEN coalesce(target, '') IN ('', 'reply') THEN CASE WHEN beat THEN 'no session to reply in' WHEN et <> 0 THEN 'no private message' END
        WHEN target = 'send_to_session' THEN CASE WHEN session = 0 THEN 'no session' END WHEN target = 'create_and_send' THEN CASE WHEN recipient = 0 THEN 'no recipient' END ELSE 'unknown target' END
      WHEN 'create_alarm' THEN CASE WHEN NOT timed THEN 'no time' WHEN NOT said THEN 'no message' WHEN sends AND NOT filled THEN 'no content' END
      ELSE 'unknown type' END AS error FROM j"""
)
def action_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An action of each event, with fields by its number; some have no kind of work."""
    e = table(spark, sf_dir, "events")
    i, n = F.col("event_id"), F.floor(F.col("event_id") / 5)
    pick = lambda x, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (x + 1).cast("int"))
    actions = e.select(
        "event_id",
        pick(i % 5, "route", "create", "cancel", "create_alarm", "other").alias("type"),
        F.when(F.col("event_type") == "error", "heartbeat").otherwise("event").alias("source"),
        F.when(F.col("user_id") % 2 == 0, 0).otherwise(1).alias("event_type"),
        F.when(i % 7 == 0, "").otherwise("do").alias("guidance"),
        F.when(i % 11 != 0, "why").alias("reason"),
        F.when(i % 19 > 0, (F.col("user_id") % 2 + 1).cast("int")).alias("work_type"),
        F.when(n % 5 != 0, pick(n % 5, "", "reply", "send_to_session", "create_and_send", "x")).alias("delivery_target"),
        (i % 3).alias("session_id"),
        (i % 4).alias("recipient_id"),
        F.when(i % 13 > 0, "soon").alias("trigger_at"),
        F.when(i % 17 > 0, "text").alias("message"),
        F.when(i % 2 == 0, "send_message").alias("alarm_action"),
        F.when(i % 9 > 0, "text").alias("alarm_content"),
        F.col("user_id").alias("in_session"),
        (n % 40).alias("target_work_id"),
    )
    works = e.where("event_id % 3 > 0").select(F.col("user_id").alias("session_id"), (n % 40).alias("work_id")).distinct().withColumn("work_type", F.when(F.col("work_id") % 2 == 0, 2).otherwise(1))
    return runtime.valid_actions(actions, works).select("event_id", "error")


@PLANS.query(
    """WITH r AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)
    SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id)::BIGINT AS idle,
      CAST(least(360, 30 * pow(2, least(greatest(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1, 0), 8))) AS INTEGER) AS minutes FROM r"""
)
def heartbeat_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors stand for heartbeats; all other events are external and reset the count."""
    idle = runtime.idle_ticks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") != "error")
    return idle.select("event_id", "idle", S.backoff_minutes(F.col("idle")).alias("minutes"))


@PLANS.query("SELECT event_id AS tick, event_id % 6 = 0 AS run_memory, true AS run_alarm, true AS run_work FROM events")
def periodic_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.checks_at(table(spark, sf_dir, "events").select(F.col("event_id").alias("tick")))


@PLANS.query(
    """WITH i AS (SELECT *, 1 + event_id % 3 AS kind FROM events WHERE user_id % 3 > 0), x AS (
      SELECT user_id, ts, event_id, 0 AS place, 'thinking' AS kind, NULL AS tool, event_type AS label FROM i WHERE kind = 2 AND event_type <> 'view'
      UNION ALL SELECT user_id, ts, event_id, CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END, 'tool_call', 'read', CASE WHEN event_id % 2 = 0 THEN 'f' || event_id ELSE 'q' || event_id END FROM i WHERE kind = 2
      UNION ALL SELECT user_id, ts, event_id, CASE WHEN event_type <> 'view' THEN 2 ELSE 1 END, 'tool_call', 'other', '' FROM i WHERE kind = 2
      UNION ALL SELECT user_id, ts, event_id, 0, 'guidance', NULL, 'go ' || event_type FROM i WHERE kind = 3)
    SELECT user_id AS session_id, ts AS "at", event_id AS interaction_id, CAST(place AS INTEGER) AS place, kind, tool, label FROM x"""
)
def activity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a request, a response with a thought (but for views) and two calls, or guidance; a user is a work,
    and every third one's is no task. A call's path is empty for odd events."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    text = i.cast("string")
    path = F.when(i % 2 == 0, F.concat(F.lit("f"), text)).otherwise(F.lit(""))
    call = lambda name, *args: F.struct(F.struct(F.lit(name).alias("name"), F.to_json(F.struct(*args)).alias("arguments")).alias("function"))
    calls = F.array(call("read", F.concat(F.lit("q"), text).alias("query"), path.alias("path")), call("other", path.alias("path"), F.lit("z").alias("query")))
    thought = F.when(F.col("event_type") != "view", F.concat(F.lit("\n\u2003"), "event_type", F.lit("\t\n"))).otherwise(F.lit(""))
    data = F.when(i % 3 == 1, F.to_json(F.struct(thought.alias("content"), calls.alias("tool_calls")))).otherwise(F.to_json(F.struct(F.concat(F.lit("go "), "event_type").alias("guidance"))))
    interactions = e.select(i.alias("interaction_id"), F.col("user_id").alias("work_id"), (i % 3 + 1).alias("kind"), data.alias("data"), F.col("ts").alias("created_at"))
    works = e.select(F.col("user_id").alias("work_id"), F.col("user_id").alias("session_id"), F.when(F.col("user_id") % 3 > 0, 2).otherwise(1).alias("work_type")).distinct()
    return runtime.activity_rows(interactions, works, {"read": ["path", "query"]})


@PLANS.query("SELECT event_id, 'open' AS bound FROM events WHERE event_id > 100 UNION ALL SELECT event_id, 'closed' FROM events WHERE event_id > 100 AND event_id <= 200")
def optional_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bound that is not positive is none."""
    e = table(spark, sf_dir, "events").select("event_id")
    return relational.id_range(e, "event_id", 100, 0).withColumn("bound", F.lit("open")).unionByName(relational.id_range(e, "event_id", 100, 200).withColumn("bound", F.lit("closed")))


@PLANS.query("SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 25 OFFSET 10")
def recent_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.page(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), [F.desc("ts"), "event_id"], 10, 25)


@PLANS.query("SELECT event_id, '[' || array_to_string(list_filter([user_id, event_id % 7, 3, user_id], lambda x: x <> 3), ',') || ']' AS ids FROM events")
def list_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id that is gone is taken out of every list."""
    e = table(spark, sf_dir, "events")
    lists = e.select("event_id", F.to_json(F.array("user_id", F.col("event_id") % 7, F.lit(3), "user_id")).alias("ids"))
    return relational.remove_from_lists(lists, "ids", 3)


# Streams: the tables are read as they stand; checkpoints go to the folder that the session names.


def _run(spark: SparkSession, stream: DataFrame, mode: str, timers: bool = False) -> DataFrame:
    from heron.streaming.events import run_to_table

    return run_to_table(stream, f"{shared_root(spark)}/stream-{uuid.uuid4().hex}", mode, timers)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; a glob makes a folder of the one file."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@PLANS.query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def dedupe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event delivered twice."""
    from heron.streaming.events import deduplicated

    s = _stream(spark, sf_dir)
    twice = s.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return _run(spark, deduplicated(twice, ["event_id"]).select("event_id", "user_id", "event_type"), "append")


@PLANS.query(
    """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 360 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 360 MINUTE AS "end", count(*) AS n FROM b GROUP BY user_id, s"""
)
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heron.streaming.events import sessions

    out = _run(spark, sessions(_stream(spark, sf_dir), gap="360 minutes"), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@PLANS.query(
    f"""WITH RECURSIVE {_ENERGY}, o AS (SELECT *, b - lag(b) OVER w AS db, x - lag(x) OVER w AS dx FROM f WINDOW w AS (PARTITION BY user_id ORDER BY n))
    SELECT user_id, event_id, CASE WHEN db > 0 THEN 'buffered' WHEN dx > 0 THEN 'dropped' ELSE 'processed' END AS outcome, energy, waiting FROM o WHERE n > 0"""
)
def energy_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heron.streaming.ordered import energy_gate

    return _run(spark, energy_gate(_stream(spark, sf_dir), F.col("event_type") == "error", _COST, _BEAT, days=10), "append", timers=True)
